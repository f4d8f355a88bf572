import pytest


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty and long texts, ties, repeats and clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    text = lambda seed, n: " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + str((i * seed) % 5) for i in range(n))
    near = text(3, 120)
    rows = [
        (1, text(1, 60), "en", "a"),
        (2, text(1, 60), "en", "a"),
        (3, near, "en", None),
        (4, near.replace("alpha", "ALPHA") + " tail", None, "b"),
        (5, near[:200] + " token = 'abcdef123456' " + near[200:], "fr", "b"),
        (6, "", "en", "b"),
        (7, None, "en", "b"),
        (8, " \n\t ", None, "c"),
        (9, "one two", "de", "c"),
        (10, "ONE\ttwo", "de", "c"),
        (11, text(5, 9000), "fr", "c"),
        (12, "12345 67890 !!", None, "c"),
        (9, "one two", "de", "c"),
        (None, text(6, 30), "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("id", "k", "n", "score", "group", "path", "spans", "rep")}
    return df.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).withColumns(extra)
