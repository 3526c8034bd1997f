"""Lines of a journal are counted where they are read; shuffled ones are put in order first."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tallyframe.functions.journal import parse_amount, parsed_amounts
from tallyframe.sinks import journal as out
from tallyframe.sources import journal as src
from tests.sample import sample_ledger
from tests.test_text import JOURNAL


def found(ledger):
    return [sorted(map(str, df.collect())) for df in (ledger.transactions, ledger.postings, ledger.assertions, ledger.prices)]


@pytest.fixture
def journal(tmp_path):
    for name in ("a.journal", "b.journal"):
        (tmp_path / name).write_text(JOURNAL)
    return str(tmp_path)


def test_lines_are_not_shuffled(spark, journal, monkeypatch):
    plans, store = {}, src.materialize

    def seen(df, label, *codec):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, label, *codec)

    monkeypatch.setattr(src, "materialize", seen)
    whole = found(src.read_journal(src.journal_lines(spark, journal)))
    assert "Exchange" not in plans["lines"]
    # Headers are not joined to the lines below them: a line carries what its header says.
    assert "Exchange" not in plans["legs"].replace("BroadcastExchange", "")
    lines = src.journal_lines(spark, journal)
    assert found(src.read_journal(lines.repartition(5, "line"))) == whole


def test_compressed_journal_reads_back(spark, tmp_path):
    books, ledgers = sample_ledger(spark), []
    for codec in (None, "gzip"):
        path = str(tmp_path / str(codec))
        assert out.append_journal(books, path, "all", codec=codec)
        ledgers.append(src.read_journal(src.journal_lines(spark, path)))
    assert all(f.endswith(".txt.gz") for f in src.journal_lines(spark, path).select("file").distinct().toPandas()["file"])
    plain, packed = (sorted(map(str, x.postings.collect())) for x in ledgers)
    assert packed == plain and len(plain) > 5


def test_counts_begin_anew_with_each_split():
    """Of two splits of one file and a file in many batches; what a split came to is its last row."""
    head, other, posting, comment = src._HEADER, src._BREAK, src._POSTING, src._COMMENT
    rows = [("a", 0, k) for k in (posting, head, comment, posting, posting, other)] + [("a", 9, k) for k in (posting, posting)] + [("b", 0, head)]
    for size in (1, 2, 4, 20):
        batches = []
        for i in range(0, len(rows), size):
            file, block, kind = zip(*rows[i : i + size])
            day = [7 if k == head else src._NO_DAY for k in kind]
            columns = {"file": file, "block": pa.array(block, pa.int64()), "seq": np.arange(i, i + len(file)), "line": file, "kind": pa.array(kind, pa.int32()), "day": pa.array(day, pa.int32())}
            batches.append(pa.RecordBatch.from_pydict(columns))
        got = [r for b in src._counted(iter(batches)) for r in b.to_pylist()]
        legs = [(r["block"], r["heads"], r["leg"], r["day"], r["opened"]) for r in got if r["kind"] == posting]
        assert legs == [(0, 0, 1, None, False), (0, 1, 1, 7, True), (0, 1, 2, 7, True), (9, 0, 1, None, False), (9, 0, 2, None, False)]
        ends = [(r["file"], r["block"], r["number"], r["heads"], r["leg"], r["opened"]) for r in got if r["kind"] == src._SPLIT_END]
        assert ends == [("a", 0, 6, 1, 0, True), ("a", 9, 2, 0, 2, False), ("b", 0, 1, 1, 0, True)]
    with pytest.raises(ValueError, match="not in order"):
        list(src._counted([pa.RecordBatch.from_pydict({**columns, "seq": np.zeros(len(file), np.int64)})]))


def test_amounts_parsed_in_steps(spark):
    texts = ["-1,234.50 EUR", "$-5", "EUR5", '2 "SOL2"', "", "EUR", None, '"A-1" 3', "1.2.3 X", "- 4.", ".5 Y", "9" * 40 + " Z", "-0 EUR"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    got = parsed_amounts(rows, a=F.col("text"), c=F.lit("")).withColumn("want", parse_amount(F.col("text"))).collect()
    assert [r.a for r in got] == [r.want for r in got] and all(r.c is None for r in got)
    assert sum(r.a is not None for r in got) == 8
    plan = parsed_amounts(rows, a=F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # as functions of rows, not interpreted one by one
