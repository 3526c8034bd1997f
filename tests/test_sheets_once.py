"""Sheets are parsed once, however often their rows are read."""

from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


def text_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_are_parsed_once(spark):
    assert "parse_json" not in text_of(catalog.QUERIES["read_balance_sheet_json"](spark, SF)).lower()
