"""Descriptions, tags, mentions, attachments and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mention directives and the attachment marker.
MENTION = r":(account|payee|tag|skill)\[([^\]]+)\](?:\{name=[^}]+\})?"
ATTACHMENT = "[[attachment]]"
TITLE_LENGTH = 60


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_description(description: Column) -> Column:
    """``struct<payee, note>`` around the first pipe."""
    pipe = F.locate("|", description)
    cut = lambda start, length: F.trim(F.substring(description, start, length))
    return F.struct(
        F.when(pipe == 0, F.trim(description)).otherwise(cut(F.lit(1), pipe - 1)).alias("payee"),
        F.when(pipe == 0, F.lit("")).otherwise(cut(pipe + 1, F.length(description))).alias("note"),
    )


def join_description(payee: Column, note: Column) -> Column:
    return F.when(F.coalesce(note, F.lit("")) == "", payee).otherwise(F.concat(payee, F.lit(" | "), note))


def tag_text(tag: Column) -> Column:
    return F.when(F.coalesce(tag["value"], F.lit("")) == "", tag["name"]).otherwise(
        F.concat(tag["name"], F.lit(": "), tag["value"])
    )


def tags_text(tags: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(tags, tag_text), sep)


def name_key(name: Column) -> Column:
    """Sort key that ignores case and accents."""
    return F.collate(name, "UNICODE_CI_AI")


def mentions(text: Column) -> Column:
    """``array<struct<type, label>>`` in order of appearance."""
    types = F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))
    labels = F.regexp_extract_all(text, F.lit(MENTION), F.lit(2))
    return F.zip_with(types, labels, lambda t, l: F.struct(t.alias("type"), l.alias("label")))


def mentions_plain(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, "$2")


def attachment_refs(text: Column) -> Column:
    """``array<struct<name, path, size>>``; a marker that does not parse is dropped.

    Parsed as variants so that a number where a name belongs is told from a string.
    """
    lines = F.filter(F.split(text, "\n"), lambda l: l.startswith(ATTACHMENT))
    docs = F.transform(lines, lambda l: F.try_parse_json(F.substring(l, F.lit(len(ATTACHMENT) + 1), F.length(l))))

    def field(doc, path, kind):
        return F.try_variant_get(doc, path, kind)

    def typed(doc, path):
        return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))

    refs = F.transform(
        docs,
        lambda d: F.struct(
            F.when(typed(d, "$.name") == "STRING", field(d, "$.name", "string")).alias("name"),
            F.when(typed(d, "$.path") == "STRING", field(d, "$.path", "string")).alias("path"),
            F.when(typed(d, "$.size") != "STRING", field(d, "$.size", "bigint")).alias("size"),
        ),
    )
    return F.filter(refs, lambda r: r["name"].isNotNull() & r["path"].isNotNull())


def without_attachments(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda l: ~l.startswith(ATTACHMENT))
    return trim_all(F.array_join(kept, "\n"))


def session_title(text: Column, image_names: Column | None = None) -> Column:
    """Readable text of a first message, else its file names, cut at 60 characters."""
    visible = trim_all(F.regexp_replace(mentions_plain(without_attachments(text)), r"\s+", " "))
    files = F.transform(attachment_refs(text), lambda r: r["name"])
    if image_names is not None:
        files = F.concat(files, F.coalesce(image_names, F.array().cast("array<string>")))
    title = F.when(visible != "", visible).otherwise(F.array_join(files, ", "))
    cut = F.concat(F.regexp_replace(F.substring(title, 1, TITLE_LENGTH), r"\s+$", ""), F.lit("…"))
    return F.when(title == "", F.lit(None)).when(F.length(title) > TITLE_LENGTH, cut).otherwise(title)


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws("\n", *parts))
