import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark, sf):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    line = "one two three four five six seven eight nine ten"
    rows = [
        (1, None), (2, ""), (3, line), (4, line), (4, line), (None, line), (None, None), (5, "x" * 30_000),
        (6, "word " * 6_000), (7, "É😀 Ünï " * 40), (8, "\n\n\n"), (9, "a"), (10, line + "\n" + line + " ten"),
    ]
    return spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in rows], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark, sf):
    return spark.createDataFrame([], COLUMNS)
