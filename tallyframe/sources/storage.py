"""Month-partitioned tables and the catalog of stored documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.functions.dates import in_window
from tallyframe.functions.files import extension, file_kind, human_size, type_label


def month_routed(df: DataFrame) -> DataFrame:
    """Two digits for the month, so that folders sort by name as they do by date."""
    return df.withColumns({"year": F.year("date"), "month": F.date_format("date", "MM")})


def read_months(
    spark: SparkSession, path: str, begin: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """A table written by month; date bounds prune folders before files are opened."""
    df = spark.read.parquet(path)
    serial = F.col("year") * 12 + F.col("month")
    if begin is not None:
        df = df.where(serial >= begin.year * 12 + begin.month)
    if end is not None:
        df = df.where(serial <= end.year * 12 + end.month)
    return df.where(in_window(F.col("date"), begin, end)).drop("year", "month")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def has_months(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds year folders as the sinks write them."""
    system, place = file_system(spark, path)
    return system.exists(place) and any(s.getPath().getName().startswith("year=") for s in system.listStatus(place))


#: Where a journal that is appended to in batches keeps one manifest per batch, written last.
MANIFESTS = "_batches"
MANIFEST = "number int, batch string, folder string"


def batches(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, batch, folder) of committed batches, None where there is no manifest folder.

    A manifest that a lost writer left half written parses to nothing and counts for nothing."""
    folder = f"{path.rstrip('/')}/{MANIFESTS}"
    system, place = file_system(spark, folder)
    if not system.exists(place):
        return None
    return spark.read.schema(MANIFEST).json(folder).where("folder is not null")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) below a folder; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "length")


def file_catalog(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with name, month, type, kind and readable size."""
    name = F.substring_index("path", "/", -1)
    month = r"/(\d{4})/(\d{2})/[^/]*$"
    return files.select(
        "path",
        name.alias("name"),
        F.regexp_extract("path", month, 1).alias("year"),
        F.regexp_extract("path", month, 2).alias("month"),
        extension(name).alias("extension"),
        type_label(name).alias("label"),
        file_kind(name).alias("kind"),
        human_size(F.col("length")).alias("size"),
    )
