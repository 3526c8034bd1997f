import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import amounts as A, files, text as X
from tallyframe.functions.dates import is_iso_date, period_start, preset_range
from tallyframe.model import AMOUNT


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def amount(quantity, commodity="EUR", precision=2):
    return F.struct(
        F.lit(Decimal(quantity)).cast("decimal(28,8)").alias("quantity"),
        F.lit(commodity).alias("commodity"),
        F.lit(precision).alias("precision"),
    ).cast(AMOUNT)


def figure(*items):
    return F.array(*[amount(*i) for i in items]) if items else F.array().cast(f"array<{AMOUNT}>")


@pytest.mark.parametrize(
    "mode, given, expected",
    [
        ("value", ("35185.862", "EUR", 3), "35,185.86 EUR"),
        ("value", ("0.165", "BTC", 3), "0.165 BTC"),
        ("native", ("1", "BTC", 8), "1.00 BTC"),
        ("native", ("0.12345679", "BTC", 12), "0.12345679 BTC"),
        ("native", ("24", "GOOG", 0), "24 GOOG"),
        ("native", ("5", "", 0), "5"),
        ("native", ("0.125", "EUR", 2), "0.13 EUR"),
        ("native", ("-0.125", "EUR", 2), "-0.13 EUR"),
        ("native", ("-0.001", "EUR", 2), "-0.00 EUR"),
        ("native", ("2.5", "EUR", 1), "2.5 EUR"),
    ],
)
def test_amounts(spark, mode, given, expected):
    assert one(spark, A.fmt_amount(amount(*given), mode)) == expected


@pytest.mark.parametrize(
    "native, value, base, expected",
    [
        ([("1408.26", "UAH"), ("100", "USD")], [("333534.3", "EUR")], None, "~334K EUR"),
        ([("2736",)], [("2736",)], None, "2.7K EUR"),
        ([("988.54",)], [("988.54",)], None, "989 EUR"),
        ([("2537.5",), ("2050", "UAH"), ("-50", "USD"), ("2", "WRLD", 0)],
         [("3033.5",), ("2050", "UAH"), ("-50", "USD"), ("2", "WRLD", 0)], "EUR", "~3K EUR +3"),
        ([("5000", "UAH"), ("1200",)], [("5000", "UAH"), ("1200",)], "EUR", "1.2K EUR +1"),
        ([("1200",), ("5000", "UAH")], [("1200",), ("5000", "UAH")], None, "1.2K EUR +1"),
        ([("-1200",), ("5000", "UAH")], [("-1200",), ("5000", "UAH")], "EUR", "-1.2K EUR +1"),
        ([("42", "", 0)], [("42", "", 0)], None, "42"),
        ([("999999",)], [("999999",)], None, "1M EUR"),
        ([("0.01234",)], [("0.01234",)], None, "0.012 EUR"),
        ([("12345678901",)], [("12345678901",)], None, "12B EUR"),
    ],
)
def test_compact(spark, native, value, base, expected):
    got = one(spark, A.fmt_compact(figure(*native), figure(*value), F.lit(base).cast("string")))
    assert got == expected


def test_value_lead(spark):
    native = figure(("10",), ("20", "UAH"))
    value = figure(("10",), ("5", "USD"))
    lead = one(spark, A.value_lead(native, value, F.lit("USD")))
    assert (lead.lead, lead.tail) == ("~5.00 USD", "10.00 EUR")
    whole = one(spark, A.value_lead(native, native, F.lit("CHF")))
    assert (whole.lead, whole.tail) == ("10.00 EUR, 20.00 UAH", "")
    assert one(spark, A.fmt_compact(figure(), figure(), F.lit("EUR"))) == ""


@pytest.mark.parametrize(
    "preset, today, first, last",
    [
        ("last-7-days", "2026-03-04", "2026-02-26", "2026-03-04"),
        ("last-30-days", "2026-01-15", "2025-12-17", "2026-01-15"),
        ("this-month", "2028-02-10", "2028-02-01", "2028-02-29"),
        ("last-month", "2026-01-10", "2025-12-01", "2025-12-31"),
        ("this-year", "2026-05-05", "2026-01-01", "2026-12-31"),
        ("last-year", "2026-05-05", "2025-01-01", "2025-12-31"),
    ],
)
def test_presets(preset, today, first, last):
    found = preset_range(preset, dt.date.fromisoformat(today))
    assert found == (dt.date.fromisoformat(first), dt.date.fromisoformat(last))


@pytest.mark.parametrize(
    "text, good",
    [("2026-02-28", True), ("2026-02-31", False), ("2026-13-45", False), ("2026-2-3", False), ("x", False), (None, False)],
)
def test_iso_dates(spark, text, good):
    assert one(spark, is_iso_date(F.lit(text).cast("string"))) is good


def test_weeks_start_on_monday(spark):
    assert one(spark, period_start(F.lit(dt.date(2026, 3, 14)), "weekly")) == dt.date(2026, 3, 9)


@pytest.mark.parametrize(
    "text, title",
    [
        ("  add   5\nEUR  ", "add 5 EUR"),
        ("from :payee[Rewe] to :tag[trip]", "from Rewe to trip"),
        ('[[attachment]]{"name":"a.pdf","path":"files/a.pdf"}', "a.pdf"),
        ('[[attachment]]{"name":5,"path":"x"}', None),
        ("x" * 61, "x" * 60 + "…"),
        ("", None),
    ],
)
def test_titles(spark, text, title):
    assert one(spark, X.session_title(F.lit(text))) == title


def test_mentions_are_strict(spark):
    text = F.lit("10:30 key:value :foo[x] :account[a:b]{name=q} :skill[s]")
    assert [tuple(m) for m in one(spark, X.mentions(text))] == [("account", "a:b"), ("skill", "s")]
    assert one(spark, X.mentions_plain(text)) == "10:30 key:value :foo[x] a:b s"


def test_attachments(spark):
    text = F.lit('hi\n[[attachment]]{"name":"a","path":"p","size":12}\n[[attachment]]{bad\nthere\n[[attachment]]{"name":"b","path":"q","size":"1"}')
    refs = one(spark, X.attachment_refs(text))
    assert [(r.name, r.path, r.size) for r in refs] == [("a", "p", 12), ("b", "q", None)]
    assert one(spark, X.without_attachments(text)) == "hi\nthere"


def test_description(spark):
    assert tuple(one(spark, X.split_description(F.lit(" Shop | a | b ")))) == ("Shop", "a | b")
    assert tuple(one(spark, X.split_description(F.lit(" Shop ")))) == ("Shop", "")


@pytest.mark.parametrize(
    "size, text",
    [(532, "532 B"), (245_000, "245 KB"), (1_200_000, "1.2 MB"), (1_000, "1 KB"), (9_960, "10 KB"), (5_000_000_000_000_000, "5000 TB")],
)
def test_sizes(spark, size, text):
    assert one(spark, files.human_size(F.lit(size))) == text


@pytest.mark.parametrize(
    "name, label, kind",
    [("a.PDF", "PDF", "document"), ("a.tar.xlsx", "XLSX", "spreadsheet"), (".env", "", "document"),
     ("x.", "", "document"), ("p.heic", "HEIC", "image"), ("a.b c", "", "document")],
)
def test_file_kinds(spark, name, label, kind):
    assert one(spark, files.type_label(F.lit(name))) == label
    assert one(spark, files.file_kind(F.lit(name))) == kind
