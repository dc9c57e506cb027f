import pytest

#: Columns that clash with names used inside the operators.
CLASH = {c: "string" for c in "shard slot score key bucket row th kept found segments hits verdict host rank component_id spans s bin grp _row _text _found draw range id b".split()}


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source with nulls, empty and long texts, ties and repeated rows."""
    word = "the quick brown fox jumps over the lazy dog and runs away from it "
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [
        (1, word * 6, "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, " \n\t ", "de", None), (5, long, "en", "s1"),
        (6, word * 6, "en", "s1"), (7, word * 6, "en", "s1"), (7, word * 6, "en", "s1"), (None, "a null id " * 30, "fr", "s3"),
        (8, "é" * 40, "fr", "s3"), (9, "漢字 🎉 ▁x", "zh", "s3"), (10, long + " tail", "en", "s1"), (11, "9" * 5000, None, None),
        (-5, "negative id", "en", "s2"), (12, "+" * 3000 + "@" * 3000 + "." * 3000, "en", "s2"), (None, None, None, None),
    ]
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash").cast(t) for c, t in CLASH.items() if c not in df.columns})


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return with_clashes(df.selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
