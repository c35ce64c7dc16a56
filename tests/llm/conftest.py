import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "lorem ipsum dolor " * 4000 + "a" * 30000
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "the cat sat on the mat and the dog ran off " * 8, "en", "b", 1), (4, "the cat sat on the mat and the dog ran off " * 8, "en", "b", 1),
        (None, "the cat sat on the mat", "en", "b", 1), (None, None, None, None, None), (7, long, "en", "c", 1), (8, long, "en", "c", 1), (9, "der Hund und die Katze sind nicht im Haus " * 5, "de", "a", 1),
        (10, "Ünïcode ß 日本語 <|endoftext|> x", "de", "", 1), (11, "12345 !!! ###", "en", "d", 1), (12, "one", "en", "d", 1), (13, "one two", "en", "d", 1), (14, "the cat sat on the mat and the dog ran off " * 8, "en", "b", 1),
    ]
    clashing = ["h", "t", "row", "n", "keep_id", "target", "key", "fp", "rep", "size", "component_id", "a"]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, c in enumerate(clashing):
        df = df.selectExpr("*", f"{k} as {c}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
