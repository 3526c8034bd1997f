"""What reading large arrays leaves on disk."""

import datetime as dt
import gzip
import json
from pathlib import Path

from tallyframe.plans import catalog
from tallyframe.scratch import scratch_root
from tallyframe.sources import json_reports as js
from tallyframe.sources.tables import SCHEMAS
from tests.test_text import amount, leg, txn


def stored(spark, label):
    return {str(p) for p in Path(scratch_root(spark).removeprefix("file:")).glob(f"{label}-*") if any(p.iterdir())}


def test_chunks_go_once_they_are_cut(spark, tmp_path):
    entries = [txn(i, "2026-01-01", "a | b", leg("x", amount(i))) for i in range(40)]
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(entries).encode()))
    before, elements = stored(spark, "chunks"), stored(spark, "elements")
    documents = js.json_array_documents(spark, str(tmp_path))
    assert stored(spark, "chunks") == before and len(stored(spark, "elements")) == len(elements) + 1
    assert sorted(r.tindex for r in js.read_transactions(documents).transactions.collect()) == list(range(40))


def test_arrays_are_written_compressed(spark, monkeypatch, tmp_path):
    keys = [*range(1, 40), 5, 99_999, 100_000, 250_000]  # three files, one key twice
    rows = [(k, 7, "F", 10.5 + k, dt.datetime(1996, 1, 2), "1-URGENT") for k in keys]
    spark.createDataFrame(rows, SCHEMAS["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    sizes, read = [], js.json_array_documents

    def seen(spark, place):
        files = [f for f in Path(place.removeprefix("file:")).rglob("part-*")]
        assert files and all(f.name.endswith(".gz") for f in files)
        texts = [gzip.decompress(f.read_bytes()).decode() for f in files]
        assert all(json.loads(t) for t in texts)
        sizes.append(sum(len(json.loads(t)) for t in texts))
        return read(spark, place)

    monkeypatch.setattr(catalog.js, "json_array_documents", seen)
    rows = catalog.read_transactions_array(spark, str(tmp_path)).collect()
    assert sizes == [sum(k % 13 != 0 for k in keys)]
    assert {r.tindex for r in rows} == {k for k in keys if k % 13 and k % 11}
