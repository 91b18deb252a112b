import pytest

#: Names that operators use inside.
CLASH = ("cid", "token", "n", "label", "p", "r", "l", "c", "w", "bucket", "n_tokens", "component_id", "t", "first_id", "batch", "kind", "key", "rate", "copies", "bit", "prefix", "gone", "pos")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(60_000))
    line = "this line has more than ten words and it is repeated in other texts"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1), (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1), (3, None, None, None, None),
        (4, "", "de", "s", 0), (5, " \n\t ", "de", None, 4), (6, long, "en", "s", len(long)), (7, long, "fr", "t", None), (8, "one", "xx", "t", 3), (8, "one", "xx", "t", 3), (9, "One", "es", "t", 3),
        (None, "a row without an id", "en", "s", 9), (10, f"first\n{line}\nlast", "en", "s", 5), (11, f"{line}\n\nother", "en", "s", 5), (12, f"{line}", "en", "s", 5), (13, "é <|endoftext|> ΑΣ 日本 🎉", "fr", "s", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'x' as {c}" for c in CLASH))


@pytest.fixture(scope="session")
def big(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
