"""Odd tables that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    """Null and empty texts, a very long one, repeats of rows and texts, null in other columns."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n", "en", None, 3),
        (4, "a b c d e f g", "en", "s", 13),
        (4, "a b c d e f g", "en", "s", 13),
        (5, "a b c d e f g", None, "s", 13),
        (6, "lorem ipsum dolor " * 20_000, "en", "s", 360_000),
        (7, "x" * 300_000, "fr", "s", 300_000),
        (8, "ünïcode 😀 text é", "fr", "s", 17),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """``df`` with columns named as the operators' own are."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in ("id", "fp", "key", "component", "node", "n", "bucket", "spans", "_a", "toxic", "words", "score", "row", "cuts", "piece", "rank")])
