"""Books stored in versions, by month.

A version is a manifest: for every frame and month, the folder that holds its rows.  A new
version writes the months it changes and points to the folders of the version before it for
all others, so an edit costs what it touches, old versions stay readable, and two versions
differ at most where their folders differ.

Manifests are numbered and created only if absent, so of two edits made on one version the
second is refused.  A manifest has one line per frame and month: it grows with the calendar,
not with the books, and is all the driver ever holds.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyframe.model import Ledger
from tallyframe.operators.edit import Edit, diff, edit_targets, rewrite
from tallyframe.operators.query import STATUS_NAMES
from tallyframe.operators.validate import validate
from tallyframe.sources.storage import file_system

#: Folder of the manifests, and the column that months are written by.
VERSIONS, MONTH = "_versions", "_month"
#: Month of rows without a date, and of frames that have none.
UNDATED = "undated"


class Conflict(ValueError):
    """Somebody else stored a version first, or left one unfinished."""


@dataclass(frozen=True)
class Version:
    """``folders`` by (frame, month); ``schemas`` by frame, as JSON."""

    number: int
    base: int
    schemas: dict[str, str]
    folders: dict[tuple[str, str], str]

    def months(self, frame: str, begin: dt.date | None = None, end: dt.date | None = None) -> list[str]:
        """Folders of a frame whose months meet [begin, end); rows without a date are in none of them."""
        low = f"{begin:%Y-%m}" if begin else ""
        high = f"{end - dt.timedelta(days=1):%Y-%m}" if end else "￿"
        dated = begin is not None or end is not None
        return [
            folder
            for (name, month), folder in sorted(self.folders.items())
            if name == frame and (low <= month <= high and month != UNDATED if dated else True)
        ]


def _month(frame: DataFrame) -> Column:
    if "date" not in frame.columns:
        return F.lit(UNDATED)
    return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(UNDATED))


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{VERSIONS}/{number:08d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    system, place = file_system(spark, f"{path.rstrip('/')}/{VERSIONS}")
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A stored version, the latest one unless a number is given."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    system, place = file_system(spark, _manifest(path, number))
    if not system.exists(place):
        raise ValueError(f"no version {number} in {path}")
    text = "\n".join(r.value for r in spark.read.text(_manifest(path, number), wholetext=True).collect())
    try:
        read = json.loads(text)
    except json.JSONDecodeError as broken:
        raise Conflict(f"version {number} is being written, or its writer was lost: see withdraw()") from broken
    folders = {(f, m): folder for f, m, folder in read["folders"]}
    return Version(number, read["base"], read["schemas"], folders)


def withdraw(spark: SparkSession, path: str, number: int) -> None:
    """Remove an unfinished manifest that a lost writer left; a finished one is kept and refused."""
    try:
        version(spark, path, number)
    except Conflict:
        system, place = file_system(spark, _manifest(path, number))
        system.delete(place, False)
        return
    raise ValueError(f"version {number} is complete")


def _publish(spark: SparkSession, path: str, new: Version) -> None:
    system, place = file_system(spark, _manifest(path, new.number))
    body = {"base": new.base, "schemas": new.schemas, "folders": [[*k, v] for k, v in sorted(new.folders.items())]}
    try:
        stream = system.create(place, False)  # fails where the file exists
    except Py4JJavaError as error:
        if system.exists(place):
            raise Conflict(f"version {new.number} exists already; read it and edit again") from error
        raise
    try:
        stream.write(bytearray(json.dumps(body).encode()))
    finally:
        stream.close()


def _write(frames: dict[str, DataFrame], path: str) -> tuple[dict[tuple[str, str], str], str]:
    """Rows of each frame below a new folder by month: the folders written, and their parent."""
    root = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    found = {}
    for name, frame in frames.items():
        spark = frame.sparkSession
        # sized by bytes: a crowded month is split, thin ones share a task
        routed = frame.withColumn(MONTH, _month(frame)).hint("rebalance", MONTH)
        routed.write.partitionBy(MONTH).parquet(f"{root}/{name}")
        system, place = file_system(spark, f"{root}/{name}")
        for status in system.listStatus(place):
            folder = status.getPath().getName()
            if folder.startswith(f"{MONTH}="):
                found[name, folder.partition("=")[2]] = f"{root}/{name}/{folder}"
    return found, root


def _drop(spark: SparkSession, folder: str) -> None:
    system, place = file_system(spark, folder)
    system.delete(place, True)


def create(ledger: Ledger, path: str) -> Version:
    """Store all frames the ledger has as version 1 of new books."""
    frames = {name: getattr(ledger, name) for name in Ledger.FRAMES}
    frames = {name: frame for name, frame in frames.items() if frame is not None}
    spark = ledger.transactions.sparkSession
    if _numbers(spark, path):
        raise Conflict(f"{path} holds versions already")
    folders, root = _write(frames, path)
    first = Version(1, 0, {name: frame.schema.json() for name, frame in frames.items()}, folders)
    try:
        _publish(spark, path, first)
    except Conflict:
        _drop(spark, root)
        raise
    return first


def _frame(spark: SparkSession, of: Version, name: str, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(of.schemas[name]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, of: Version, begin: dt.date | None = None, end: dt.date | None = None) -> Ledger:
    """The books of a version.

    With bounds only folders of months that meet [begin, end) are opened, and rows outside
    are left out; frames without dates are read whole."""

    def frame(name: str) -> DataFrame:
        if (begin is None and end is None) or '"date"' not in of.schemas[name]:
            return _frame(spark, of, name, of.months(name))
        rows = _frame(spark, of, name, of.months(name, begin, end))
        if begin is not None:
            rows = rows.where(F.col("date") >= F.lit(begin))
        return rows if end is None else rows.where(F.col("date") < F.lit(end))

    return Ledger(**{name: frame(name) for name in of.schemas})


def commit_edit(spark: SparkSession, path: str, edit: Edit, on: Version) -> Version:
    """Apply an edit to version ``on`` and store what comes of it as the next version.

    Only months with a row that changes are written.  An edit that changes nothing gives
    ``on`` back.  One that leaves the books invalid raises ValueError and one made on a
    version that is no longer the latest raises ``Conflict``; both leave nothing behind."""
    edit.check()
    if max(_numbers(spark, path), default=0) != on.number:
        raise Conflict(f"version {on.number} is no longer the latest")
    books = read(spark, on)
    name, column = {
        "change_account": ("postings", "account"), "change_payee": ("transactions", "payee"),
        "set_status": ("transactions", "status"),
    }[edit.action]
    after = rewrite(books, edit)
    rows = getattr(books, name)
    if edit.action == "set_status":
        holding = rows.where(~F.col(column).eqNullSafe(F.lit(STATUS_NAMES[edit.to])))
    else:
        holding = rows.where((F.col(column) == edit.old) & (F.col(column) != edit.to))
    hit = holding.join(edit_targets(books, edit), "tindex", "left_semi")
    months = [r[MONTH] for r in hit.select(_month(hit).alias(MONTH)).distinct().collect()]  # one row per month
    if not months:
        return on
    if not validate(after).isEmpty():
        raise ValueError("edit refused: the ledger would have errors")
    touched = _frame(spark, on, name, [on.folders[name, month] for month in months])
    # Targets are found in all books, rows are read and written in the months they are in.
    part = rewrite_rows(books, touched, name, edit)
    folders, root = _write({name: part}, path)
    new = Version(on.number + 1, on.number, on.schemas, {**on.folders, **folders})
    try:
        _publish(spark, path, new)
    except Conflict:
        _drop(spark, root)
        raise
    return new


def rewrite_rows(books: Ledger, rows: DataFrame, name: str, edit: Edit) -> DataFrame:
    """What an edit of ``books`` makes of some rows of one frame."""
    targets = edit_targets(books, edit)
    return getattr(rewrite(books.having(**{name: rows}), edit, targets), name)


def changed_folders(old: Version, new: Version, name: str) -> tuple[list[str], list[str]]:
    """Folders of a frame that only ``old`` or only ``new`` points to."""
    before, after = set(old.months(name)), set(new.months(name))
    return sorted(before - after), sorted(after - before)


def version_diff(spark: SparkSession, old: Version, new: Version, name: str) -> DataFrame:
    """Rows of a frame that only one version holds, as ``edit.diff`` tells them; months whose
    folder both versions share are not read."""
    before, after = changed_folders(old, new, name)
    return diff(_frame(spark, old, name, before), _frame(spark, new, name, after))
