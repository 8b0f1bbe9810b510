"""Attribution of a score to its terms, and diagnosis of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .bm25 import exact_sum
from .postings import Stats, idf, saturation

COMMON = 0.5


def term_counts(queries: DataFrame, qid: str = "qid", text: str = "query") -> DataFrame:
    """(qid, term, q_count): how often a query repeats each term."""
    return queries.select(F.col(qid).alias("qid"), F.explode_outer(tokens(F.col(text))).alias("term")).where("term is not null").groupBy("qid", "term").agg(F.count("*").alias("q_count"))


def explain(posts: DataFrame, lex: DataFrame, counts: DataFrame, rows: DataFrame, stats: Stats) -> DataFrame:
    """(qid, row, term, q_count, status, tf, df, idf, contribution) for each query term and each asked (qid, row).

    status: `ok`, `no_tf` (known term that the document lacks) or `oov`. tf, idf (`oov` only) and contribution are 0 where there is nothing. The contributions of a document add up to
    its score, as both use live documents only.
    """
    asked = rows.select("qid", "row").join(counts, "qid").join(lex, "term", "left")
    found = posts.join(rows.select("row").distinct(), "row", "left_semi").select("row", "term", "tf", "dl")
    joined = asked.join(found, ["row", "term"], "left")
    status = F.when(F.col("df").isNull(), "oov").when(F.col("tf").isNull(), "no_tf").otherwise("ok")
    return joined.select("qid", "row", "term", "q_count", status.alias("status"), F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("df", F.lit(0)).alias("df"), F.coalesce(idf("df", stats), F.lit(0.0)).alias("idf"), F.coalesce(idf("df", stats) * saturation("tf", "dl", stats), F.lit(0.0)).alias("contribution"))


def explained_scores(explained: DataFrame) -> DataFrame:
    """(qid, row, score) from explanations."""
    return explained.where("status = 'ok'").groupBy("qid", "row").agg(exact_sum(F.col("contribution")).alias("score"))


def diagnose_terms(lex: DataFrame, counts: DataFrame, stats: Stats) -> DataFrame:
    """(qid, term, q_count, in_vocab, df, df_ratio, idf), ratios and idf rounded to 6 places."""
    joined = counts.join(lex, "term", "left")
    df = F.coalesce("df", F.lit(0))
    return joined.select(
        "qid", "term", "q_count", F.col("df").isNotNull().alias("in_vocab"), df.alias("df"),
        F.round(df.cast("double") / F.lit(float(max(stats.n_live, 1))), 6).alias("df_ratio"),
        F.when(F.col("df").isNotNull(), F.round(idf("df", stats), 6)).alias("idf"),
    )


def diagnose_status(queries: DataFrame, terms: DataFrame, by_score: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, n_tokens, n_oov, n_positive, max_score, status); status in the order no_tokens, all_oov, no_positive, partial_oov, ok. `by_score`: (qid, n_positive, max_score), as `batch.positive` gives."""
    by_term = terms.groupBy("qid").agg(F.sum("q_count").alias("n_tokens"), F.count("*").alias("n_terms"), F.count_if(~F.col("in_vocab")).alias("n_oov"))
    out = queries.select(F.col(qid).alias("qid")).join(by_term, "qid", "left").join(by_score, "qid", "left").na.fill(0, ["n_tokens", "n_terms", "n_oov", "n_positive"])
    status = (
        F.when(F.col("n_tokens") == 0, "no_tokens").when(F.col("n_oov") == F.col("n_terms"), "all_oov").when(F.col("n_positive") == 0, "no_positive").when(F.col("n_oov") > 0, "partial_oov").otherwise("ok")
    )
    return out.select("qid", "n_tokens", "n_oov", "n_positive", F.coalesce("max_score", F.lit(0.0)).alias("max_score"), status.alias("status"))


def diagnosis(query: str, terms: list, n_positive: int, max_score: float, n_live: int, k: int) -> dict:
    """The report of one query: terms, vocabulary and score figures, status and messages. `terms`: rows of `diagnose_terms`."""
    n_tokens = sum(t["q_count"] for t in terms)
    missing = sorted(t["term"] for t in terms if not t["in_vocab"])
    status = "no_tokens" if not n_tokens else "all_oov" if len(missing) == len(terms) else "no_positive" if not n_positive else "partial_oov" if missing else "ok"
    notes = []

    def note(level: str, what: str, evidence: object, action: str) -> None:
        notes.append({"level": level, "what": what, "evidence": evidence, "action": action})

    if not n_tokens:
        note("error", "no_tokens", query, "Ask with at least one word.")
    if not n_live:
        note("error", "no_documents", 0, "Add documents first.")
    if missing:
        note("error" if status == "all_oov" else "warning", "out_of_vocabulary", missing, "Check the spelling, or add documents that hold these terms.")
    if n_tokens and status == "no_positive":
        note("warning", "no_positive", 0, "No live document holds a term of the query.")
    common = sorted(t["term"] for t in terms if t["df_ratio"] >= COMMON)
    if common:
        note("info", "low_discrimination", common, "These terms are in half of the documents or more and hardly rank them.")
    if n_positive > k:
        note("info", "more_hits", n_positive, f"Only the first {k} are shown.")
    return {
        "query": query, "tokens": sorted(t["term"] for t in terms), "terms": [t.asDict() if hasattr(t, "asDict") else dict(t) for t in terms],
        "vocab": {"known": len(terms) - len(missing), "missing": missing}, "scores": {"n_positive": n_positive, "max": max_score}, "status": status, "messages": notes,
    }
