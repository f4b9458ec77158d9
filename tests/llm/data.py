"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 101}" for i in range(150))

TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("alpha7 ", "alpha7x "), "en", "b"), (4, BASE.upper(), "en", "b"),
    (5, "", "en", "a"), (6, None, "en", None), (7, "one", "de", "c"), (8, "one two", "de", "c"), (9, "   \t\n ", None, "a"), (10, LONG, "fr", "b"),
    (11, LONG + " tail", "fr", "b"), (12, "ÄÖÜ straße naïve — 你好 \u00a0x", "de", None), (13, "!!! ??? 123", "en", "a"),
    (7, "one", "de", "c"), (None, "no id here at all", "en", "a"), (14, "Some  spaces   and \n \n lines \x0b\x0c end ", "en", "z"),
]


def documents(spark, rows=None):
    """``doc_id, text, lang, source`` and columns whose names operators use inside."""
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"id": F.lit("x"), "fp": F.lit("y"), "n": F.lit(0), "t": F.lit("z"), "key": F.lit(1), "h": F.lit(2), "size": F.lit(3)})


def empty(df):
    return df.limit(0)
