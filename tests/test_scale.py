"""Operators that must not depend on the size of one key, against brute force."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import pricing, reports, totals
from tallyframe.operators.totals import running_totals
from tallyframe.streaming.once import once_stream


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(30), i, rng.randrange(-50, 50))
        for i in range(5000)
    ]
    df = spark.createDataFrame(rows, "k string, d int, i int, v int").repartition(7)
    found = running_totals(df, ["k"], ["d", "i"], {"total": F.col("v"), "n": F.lit(1)}, runs=23)
    got = {(r.k, r.i): (r.total, r.n) for r in found.collect()}
    sums, counts = defaultdict(int), defaultdict(int)
    for k, d, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] += v
        counts[k] += 1
        assert got[(k, i)] == (sums[k], counts[k])


def test_hot_key_is_spread_over_runs(spark):
    df = spark.range(4000).selectExpr("'hot' as k", "id", "cast(1 as decimal(28,8)) as v")
    found = running_totals(df, ["k"], ["id"], {"total": F.col("v")}, runs=16)
    assert found.where("total <> id + 1").isEmpty()
    # The window partitions on the run as well as on the key.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_run" in plan and "windowspecdefinition(_run" in plan


def test_many_runs_are_carried_in_two_levels(spark, monkeypatch):
    """A hot key, keys that fill no run, null keys and null amounts, over more runs than one window may hold."""
    rng = random.Random(3)
    rows = [
        (rng.choice(("hot", "hot", "hot", f"k{rng.randrange(60)}", None)), i, rng.choice((None, *range(-40, 40))))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    monkeypatch.setattr(totals, "ONE_LEVEL", 10)
    found = running_totals(df, ["k"], ["i"], {"total": F.coalesce("v", F.lit(0)), "known": F.col("v")}, runs=40)
    sums, known = defaultdict(int), defaultdict(int)
    want = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        sums[k] += v or 0
        known[k] += v or 0
        want[i] = sums[k]
    got = {r.i: r.total for r in found.collect()}
    some = {i for i, r in enumerate(rows) if rows[i][0] is not None}
    assert {i: got[i] for i in some} == {i: want[i] for i in some}
    numbered = running_totals(df, [], ["i"], {"n": F.lit(1)}, runs=40).collect()
    assert all(r.n == r.i + 1 for r in numbered)


def test_hundred_thousand_runs(spark):
    """No window over the runs of one key holds more than about their square root."""
    runs = 100_000
    per_run = spark.range(runs).select(F.col("id").cast("int").alias("_run"), F.lit("hot").alias("k"), F.lit(2).cast("long").alias("p"))
    carried = totals.brought_in(per_run, ["k"], ["p"], runs)
    assert carried.where("p_in <> 2 * _run").isEmpty() and carried.count() == runs - 1
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line for line in windows)


def test_runs_follow_from_bytes_read(spark, tmp_path, monkeypatch):
    spark.range(50_000).withColumn("v", F.rand(1)).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert totals.run_count(table) is None  # small: the configured number is enough
    monkeypatch.setattr(totals, "RUN_BYTES", size // 50)
    assert 48 <= totals.run_count(table) <= 52
    assert totals.run_count(table.alias("a").join(table.alias("b"), "id")) <= 104  # not multiplied


def test_numbering_without_keys(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"))
    numbered = running_totals(df, [], ["x"], {"n": F.lit(1)}, runs=9).orderBy("x").collect()
    assert [r.n for r in numbered] == list(range(1, 3001))


def test_hot_transaction_in_register_order(spark):
    """One transaction and day hold every row; only values break ties."""
    rows = [(dt.date(2026, 1, 1), 1, 1, Decimal(i % 17), "EUR") for i in range(2000)]
    df = spark.createDataFrame(rows, "date date, tindex int, leg int, v decimal(28,8), c string")
    found = running_totals(df, ["c"], ["date", "tindex", "leg", "v"], {"t": F.col("v")}, runs=12)
    totals, s = [], Decimal(0)
    for v in sorted(r[3] for r in rows):
        s += v
        totals.append(s)
    assert sorted(r.t for r in found.collect()) == totals


def price_rows(spark, rows):
    made = [(dt.date.fromisoformat(d), c, Decimal(p), t, s, n) for n, (d, c, p, t, s) in enumerate(rows)]
    return spark.createDataFrame(
        made, "date date, commodity string, price decimal(18,8), target string, source string, seq bigint"
    )


def test_price_paths_prefer_short_and_direct(spark):
    prices = price_rows(spark, [
        ("2026-01-01", "EUR", "1.1", "USD", "declared"),
        ("2026-01-01", "GBP", "1.2", "EUR", "declared"),
        ("2026-01-01", "USD", "40", "UAH", "declared"),
        ("2026-01-01", "PLN", "0.25", "EUR", "declared"),
        ("2026-01-01", "PLN", "10", "UAH", "declared"),
        ("2026-01-01", "USD", "0.9", "EUR", "declared"),
        ("2026-01-01", "CHF", "7", "XXX", "declared"),
        ("2026-01-02", "GBP", "1.3", "EUR", "inferred"),
        ("2026-01-02", "GBP", "1.4", "EUR", "declared"),
        ("2026-01-02", "GBP", "1.5", "EUR", "inferred"),
        ("2026-02-01", "GBP", "9", "EUR", "declared"),
    ])
    rates = {
        r.commodity: (round(r.rate, 8), r.hops, r.turns)
        for r in pricing.price_paths(pricing.latest_prices(prices, dt.date(2026, 1, 31)), "USD").collect()
    }
    assert rates == {
        "EUR": (1.1, 1, 0),  # the direct price, not one over USD's
        "UAH": (0.025, 1, 1),
        "GBP": (round(1.4 * 1.1, 8), 2, 0),  # declared beats inferred on one date
        "PLN": (round(0.25 * 1.1, 8), 2, 0),
    }


def test_base_commodity_prefers_declared(spark):
    rows = price_rows(spark, [("2026-01-01", "UAH", "0.02", "EUR", "declared"), ("2026-05-01", "W", "2", "USD", "inferred")])
    assert pricing.base_commodity(rows).first()[0] == "EUR"
    assert pricing.base_commodity(rows.where("source = 'inferred'")).first()[0] == "USD"
    assert pricing.base_commodity(rows.limit(0)).first()[0] is None


def test_price_asof_against_brute_force(spark):
    rng = random.Random(3)
    start = dt.date(2026, 1, 1)
    prices = [
        ((start + dt.timedelta(days=rng.randrange(60))).isoformat(), f"C{rng.randrange(3)}", str(rng.randrange(1, 99)), "EUR", "declared")
        for _ in range(40)
    ]
    asks = [(i, "C0" if i % 3 else f"C{rng.randrange(4)}", start + dt.timedelta(days=rng.randrange(-5, 70))) for i in range(300)]
    found = pricing.price_asof(
        spark.createDataFrame(asks, "i int, commodity string, date date"), price_rows(spark, prices)
    )
    got = {r.i: (r.price, r.price_date) for r in found.collect()}
    for i, commodity, day in asks:
        known = [(dt.date.fromisoformat(d), n, Decimal(p)) for n, (d, c, p, _, _) in enumerate(prices) if c == commodity]
        best = max((k for k in known if k[0] <= day), default=None)
        assert got[i] == ((best[2], best[0]) if best else (None, None))


def test_sums_keep_every_place(spark):
    """Quantities far beyond one machine's books keep eight decimals."""
    df = spark.range(1000).selectExpr(
        "id as tindex", "'EUR' as c", "cast(123456789012345678.12345678 as decimal(28,8)) as v"
    )
    total = running_totals(df, ["c"], ["tindex"], {"t": F.col("v")}, runs=5).agg(F.max("t")).first()[0]
    assert total == Decimal("123456789012345678.12345678") * 1000


def test_once_only_stream(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, 7, "install"), (2, 7, "install"), (3, 8, "install"), (4, 7, "open")], "event_id int, user_id int, event_type string"
    )
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = (
        once_stream(stream).writeStream.format("memory").queryName("once")
        .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    )
    query.processAllAvailable()
    events.write.mode("append").parquet(source)  # everything again, in a later batch
    query.processAllAvailable()
    query.stop()
    assert {(r.user_id, r.event_type) for r in spark.table("once").collect()} == {(7, "install"), (8, "install"), (7, "open")}
    assert spark.table("once").count() == 3


def test_reports_ignore_partitioning(spark):
    from tests.sample import sample_ledger

    ledger = sample_ledger(spark)
    spread = ledger.having(postings=ledger.postings.repartition(13))
    assert set(reports.balance_sheet(ledger).collect()) == set(reports.balance_sheet(spread).collect())


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from tallyframe.scratch import scratch_path, scratch_root

    def session(master, root):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: root),
            sparkContext=SimpleNamespace(master=master),
        )

    with pytest.raises(ValueError):
        scratch_root(session("spark://host:1", None))
    assert scratch_root(session("spark://host:1", "/shared")) == "/shared"
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
