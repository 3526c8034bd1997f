"""Display metadata of stored documents, from name and size alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions of the two special kinds.
SPREADSHEETS = ("csv", "tsv", "xls", "xlsx", "numbers", "ods")
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "avif", "bmp", "heic", "heif", "svg", "tif", "tiff")
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def extension(name: Column) -> Column:
    """Lower-case extension; none for dot files, trailing dots and odd suffixes."""
    return F.lower(F.regexp_extract(name, r"^.+\.([A-Za-z0-9]{1,8})$", 1))


def type_label(name: Column) -> Column:
    return F.upper(extension(name))


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin(*SPREADSHEETS), F.lit("spreadsheet"))
        .when(ext.isin(*IMAGES), F.lit("image"))
        .otherwise(F.lit("document"))
    )


def human_size(size: Column) -> Column:
    """Decimal units; one digit below ten, none from ten up."""
    out = None
    for i in range(len(SIZE_UNITS) - 1, 0, -1):
        value = size.cast("double") / F.lit(float(1000**i))
        small = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
        big = F.format_string("%.0f", F.floor(value + 0.5).cast("double"))
        text = F.concat(F.when(value >= 9.95, big).otherwise(small), F.lit(f" {SIZE_UNITS[i]}"))
        reached = size >= F.lit(1000**i)
        out = F.when(reached, text) if out is None else out.when(reached, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))
