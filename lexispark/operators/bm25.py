"""BM25 scores and top-k, for one query or a batch of them in one job."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.local import local_rows
from .postings import Stats, idf, saturation

#: Contributions are summed as whole multiples of 2**-40, so a sum doesn't depend on the order of its parts: equal corpora give equal scores however they are stored.
SCALE = float(1 << 40)


def exact_sum(x: Column) -> Column:
    return F.sum(F.round(x * F.lit(SCALE)).cast("long")).cast("double") / F.lit(SCALE)


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "query") -> DataFrame:
    """(qid, term): distinct terms; how often a query repeats a word doesn't count."""
    return queries.select(F.col(qid).alias("qid"), F.explode_outer(tokens(F.col(text))).alias("term")).where("term is not null").distinct()


def terms_of(spark: SparkSession, queries: Iterable[str]) -> DataFrame:
    return query_terms(local_rows(spark, enumerate(queries), "qid int, query string"))


def contributions(posts: DataFrame, lex: DataFrame, terms: DataFrame, stats: Stats) -> DataFrame:
    """(qid, row, term, tf, df, c): the part of each query term in each document. Only postings and lexicon rows of query terms are joined on."""
    wanted = terms.join(lex, "term").select("qid", "term", "df")
    return posts.join(wanted, "term").select("qid", "row", "term", "tf", "df", (idf("df", stats) * saturation("tf", "dl", stats)).alias("c"))


def scores(posts: DataFrame, lex: DataFrame, terms: DataFrame, stats: Stats) -> DataFrame:
    """(qid, row, score) of all documents that hold a query term."""
    return contributions(posts, lex, terms, stats).groupBy("qid", "row").agg(exact_sum(F.col("c")).alias("score"))


def weighted_scores(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """As `scores`, from materialised weights."""
    return weights.join(terms, "term").groupBy("qid", "row").agg(exact_sum(F.col("w")).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", tie: str = "row", positive: bool = True, digits: int | None = None) -> DataFrame:
    """The k best of each query with their rank; ties go by `tie`. `positive`: without scores of 0 or less."""
    if digits is not None:
        scored = scored.withColumn(by, F.round(by, digits))
    if positive:
        scored = scored.where(F.col(by) > 0)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), tie)).cast("long"))
    return ranked.where(F.col("rank") <= max(k, 0))  # Spark keeps k rows of a query in each task before the shuffle


def top_k_single(scored: DataFrame, k: int, by: str = "score", tie: str = "row") -> DataFrame:
    """The k best of a single query: one bounded sort, no window."""
    return scored.where(F.col(by) > 0).orderBy(F.desc(by), tie).limit(max(k, 0))


def zero_filled(rows: DataFrame, scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Exactly min(k, rows) results of a single query: rows without a score stand behind with 0. Nothing if no query term is known."""
    full = rows.select("row").join(scored.select("row", "score"), "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if digits is not None:
        full = full.withColumn("score", F.round("score", digits))
    return full.orderBy(F.desc("score"), "row").limit(max(k, 0))


_paths = threading.local()


def topk_stats(reset: bool = False) -> dict[str, int]:
    """Which ways this thread's approximate selections have taken: calls, approx (a threshold from the sample), exact (a sample too small), fallback (too few candidates), cand (candidates counted, up to k a call)."""
    counts = _paths.__dict__.setdefault("counts", dict.fromkeys(("calls", "approx", "exact", "fallback", "cand"), 0))
    out = dict(counts)
    if reset:
        counts.update(dict.fromkeys(counts, 0))
    return out


def _took(**more: int) -> None:
    topk_stats()
    for k, v in more.items():
        _paths.counts[k] += v


def approximate_top_k(scored: DataFrame, k: int, share: float = 1 / 32, slack: float = 0.98) -> DataFrame:
    """The k best of a single query behind a threshold from a sample; falls back to the exact way where the sample holds too few. Scores are exact. `scored` is read up to three times: hand over a kept table."""
    sampled = scored.where((F.col("score") > 0) & (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20))))
    least = max(1, int(k * share) + 1)
    best = [r["score"] for r in sampled.orderBy(F.desc("score")).limit(least).collect()]
    if len(best) < least:
        _took(calls=1, exact=1)
        return top_k_single(scored, k)
    candidates = scored.where(F.col("score") >= best[-1] * slack)
    held = len(candidates.limit(k).collect())
    if held < k:
        _took(calls=1, fallback=1, cand=held)
        return top_k_single(scored, k)
    _took(calls=1, approx=1, cand=held)
    return top_k_single(candidates, k)


def hits(ranked: DataFrame, chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """Ranked rows with docid, file, line and, for these few only, text."""
    columns = ["row", "docid", "file", "line", *(["text"] if with_text else [])]
    return ranked.join(chunks.select(*columns), "row").select("qid", "rank", "score", *(c for c in columns if c != "row"))
