"""Positions in sorted reports: right, whole, and without a window over the rows."""

from pyspark.sql import functions as F

from tallyframe.operators import positions


def _numbered(rows, order):
    return {r.id: r.position for r in positions.with_position(rows.orderBy(*order)).collect()}


def test_every_row_has_its_place(spark):
    rows = spark.range(5_000, numPartitions=7).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(977)))
    got = _numbered(rows, [F.col("key").desc(), "id"])
    want = sorted(rows.collect(), key=lambda r: (-r.key, r.id))
    assert got == {r.id: n for n, r in enumerate(want, 1)}


def test_one_key_holds_most_rows(spark):
    rows = spark.range(3_000, numPartitions=5).withColumn("key", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    got = _numbered(rows, ["key"])
    assert sorted(got.values()) == list(range(1, 3_001))
    assert max(p for i, p in got.items() if i % 3) == 2_000  # what the order does not tell apart stays together


def test_nulls_repeats_no_rows_and_an_old_position(spark):
    rows = spark.createDataFrame([(None, "x"), ("b", "y"), ("b", "y"), ("a", None)], "name string, position string")
    out = positions.with_position(rows.orderBy(F.col("name").asc_nulls_last()))
    assert out.columns == ["name", "position"] and out.schema["position"].dataType.simpleString() == "bigint"
    assert [r.name for r in out.orderBy("position").collect()] == ["a", "b", "b", None]
    assert positions.with_position(rows.where("false").orderBy("name")).count() == 0


def test_names_fold_case_and_accents(spark):
    from tallyframe.functions.text import name_key

    rows = spark.createDataFrame([("Zoo",), ("école",), ("Ecole",), ("apple",), ("Éclair",)], "name string")
    out = positions.with_position(rows.orderBy(name_key(F.col("name")), "name"))
    assert [r.name for r in out.orderBy("position").collect()] == ["apple", "Éclair", "Ecole", "école", "Zoo"]


def test_pages_cover_the_report_once(spark):
    rows = positions.with_position(spark.range(25).orderBy(F.desc("id")))
    pages = [[r.id for r in positions.page(rows, n, 10).collect()] for n in (1, 2, 3, 4)]
    assert pages == [list(range(24, 14, -1)), list(range(14, 4, -1)), list(range(4, -1, -1)), []]


def test_plan_sorts_no_rows_again(spark):
    """What is read back is joined with a row per partition; the only window spans those."""
    rows = positions.with_position(spark.range(1_000).orderBy("id"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Join") < plan.index("Window [") < plan.index("Aggregate")
