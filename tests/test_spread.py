"""Memory of a task that does not follow the input."""

import pytest

from tallyframe.operators import edit, totals
from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(totals, "TASK_BYTES", 64 << 10)


def text_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored_numbers(spark, tmp_path, name, expression):
    spark.range(100_000).selectExpr(*expression).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_rows_spread_by_the_bytes_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(totals, "TASK_BYTES", 8 << 10)
    rows = stored_numbers(spark, tmp_path, "rows", ["id AS tindex", "cast(id % 7 AS int) AS leg"])
    spread = totals.spread(rows, "tindex")
    assert spread.rdd.getNumPartitions() == totals.bytes_read(rows) // totals.TASK_BYTES > 8
    assert spread.count() == 100_000
    assert "Repartition" not in text_of(totals.spread(spark.range(3).toDF("tindex"), "tindex"))


def test_diff_counts_rows_after_they_met(spark, tmp_path, small_tasks):
    before = stored_numbers(spark, tmp_path, "before", ["id AS tindex", "if(id < 2, null, id % 3) AS leg"])
    after = before.where("tindex <> 5").union(before.where("tindex = 9")).union(before.where("tindex = 0"))
    changed = edit.diff(before, after)
    assert "RepartitionByExpression" in text_of(changed)
    assert sorted(map(tuple, changed.collect())) == [("after", 0, None, 1), ("after", 9, 0, 1), ("before", 5, 2, 1)]


@pytest.mark.parametrize("name", ["duplicates", "reg_hide_assertions"])
def test_joins_by_transaction_spread(spark, small_tasks, name):
    plain = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    assert "RepartitionByExpression" in text_of(catalog.QUERIES[name](spark, SF))
    totals.TASK_BYTES = 1 << 40
    assert "RepartitionByExpression" not in text_of(catalog.QUERIES[name](spark, SF))
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == plain
