"""Rows that every operator must bear, and helpers of the tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"
WORDS = "river stone garden winter morning paper window light market silver forest letter bridge copper summer candle harbor meadow signal velvet anchor basket cellar dragon ember falcon glacier hollow island jungle kettle lantern marble needle orchard pepper quarry ribbon saddle temple".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, repeated and missing ids, odd characters."""
    long = sentence(rng, 30_000)
    return [
        (None, None), (None, "a text without an id"), (None, "another text without an id"), (1, None), (2, ""), (3, "   \t\n "), (4, "word"), (5, "two words"), (6, "?! ... --"), (7, long), (8, long), (9, "same row"), (9, "same row"), (10, "one id"), (10, "another text of one id"),
        (11, "Ünïcödé ñandú 漢字 𝒳 é   wörter"), (12, "x" * 70_000), (13, "<|endoftext|> it's $5 @you 1d10t"), (14, "\x00\x01 control"), (15, sentence(rng, 80)), (16, sentence(rng, 80)), (-3, "negative id"),
    ]


def clashing(df):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("d", "r", "fp", "root", "_row", "_hits", "hits", "items", "spans", "cuts", "n_words", "score", "_toxicity", "component_id", "row", "count", "key", "part")
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
