"""Odd documents shared by the tests."""

LONG = "un mot très long " * 4000 + "x" * 20000


def make(spark, rows, extra=True):
    """documents with odd cases; extra columns clash with names that operators use."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("ids", "keep", "fp", "part", "__text", "key"):
            df = df.withColumn(name, df["doc_id"])
    return df
