"""The index as tables: postings, lexicon, corpus numbers, weights.

A posting carries its document's length, so scoring needs no join by row. Statistics count live documents only; the vocabulary never shrinks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Tokens that a Python worker counts at a time.
COUNTED = 2_000_000


@dataclass(frozen=True)
class Stats:
    """Numbers of a corpus: physical rows, live rows, their tokens, and the parameters of the formula."""

    n_rows: int
    n_live: int
    sum_dl: int
    k1: float = K1
    b: float = B

    @property
    def avgdl(self) -> float:
        return self.sum_dl / max(self.n_live, 1)


def tokenized(docs: DataFrame, row: str = "row", text: str = "text", tokenize=tokens) -> DataFrame:
    """(row, toks, dl); a document without tokens stays, with length 0."""
    return docs.select(F.col(row).alias("row"), tokenize(F.col(text)).alias("toks")).select("row", "toks", F.size("toks").cast("long").alias("dl"))


def doc_lengths(docs: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    return docs.select(F.col(row).alias("row"), F.size(tokens(F.col(text))).cast("long").alias("dl"))


def postings(docs: DataFrame, row: str = "row", text: str = "text", tokenize=tokens, terms: list[str] | None = None) -> DataFrame:
    """(row, dl, term, tf); with `terms` only of these, which are picked before anything is counted or dealt. A document lies in one task, so the partial count is the full one and the shuffle moves postings, not tokens.

    The outer explode keeps Catalyst from testing the tokens' size in a filter of its own, which would tokenise twice.
    """
    exploded = tokenized(docs, row, text, tokenize).select("row", "dl", F.explode_outer("toks").alias("term")).where("term is not null")
    if terms is not None:
        exploded = exploded.where(F.col("term").isin(terms))
    return exploded.groupBy("row", "dl", "term").agg(F.count("*").alias("tf"))


def _counts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Postings of documents (row, dl, toks), by term and row."""
    table = pa.Table.from_batches(batches).combine_chunks()
    toks = table.column("toks").combine_chunks()
    doc = np.repeat(np.arange(len(toks), dtype=np.int64), pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False))
    coded = toks.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = table.column("row").to_numpy()
    by_row = np.argsort(row, kind="stable")
    rank = np.empty(len(row), np.int64)
    rank[by_row] = np.arange(len(row))
    found, tf = np.unique(place[coded.indices.to_numpy()] * max(len(row), 1) + rank[doc], return_counts=True)
    term, at = order[found // max(len(row), 1)], by_row[found % max(len(row), 1)]
    return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(table.column("dl").to_numpy()[at]), coded.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64))], ["row", "dl", "term", "tf"])


def counted(docs: DataFrame, row: str = "row", text: str = "text", tokenize=tokens) -> DataFrame:
    """`postings` of documents that are a row each, without a shuffle: Arrow batches are counted where they are, and come in runs that are sorted by term and row."""

    def work(batches):
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                held.append(part)
                n += pc.sum(part.column("dl")).as_py() or 0
                if n >= COUNTED:
                    yield from _pieces(_counts(held))
                    held, n = [], 0
        if n:
            yield from _pieces(_counts(held))

    return tokenized(docs, row, text, tokenize).select(F.col("row").cast("long").alias("row"), "dl", "toks").mapInArrow(work, "row long, dl long, term string, tf long")


def _pieces(batch: pa.RecordBatch, n: int = 50_000):
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def asked(docs: DataFrame, terms: list[str], row: str = "row", text: str = "text") -> DataFrame:
    """(row, dl, hits): each document with its length and, of `terms` only, its (term, tf). One row a document: no shuffle, and one pass that both scores and corpus numbers can be taken from."""
    found = tokenized(docs, row, text).select("row", "dl", F.filter("toks", lambda t: t.isin(terms) if terms else F.lit(False)).alias("own"))
    return found.select("row", "dl", F.transform(F.array_distinct("own"), lambda t: F.struct(t.alias("term"), F.size(F.filter("own", lambda x: x == t)).cast("long").alias("tf"))).alias("hits"))


def asked_postings(held: DataFrame) -> DataFrame:
    """(row, dl, term, tf) of `asked`."""
    return held.select("row", "dl", F.explode("hits").alias("h")).select("row", "dl", "h.term", "h.tf")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) straight from texts: the shuffle carries a partial count for each term, not a row for each posting."""
    return docs.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def lexicon(posts: DataFrame) -> DataFrame:
    """(term, df): live documents that hold each term."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def row_count(docs: DataFrame, k1: float = K1, b: float = B) -> Stats:
    """Numbers for idf alone, which asks for no lengths: a count, without reading a text."""
    n = docs.count()
    return Stats(n, n, 0, k1, b)


def corpus_stats(lengths: DataFrame, dead: DataFrame | None = None, k1: float = K1, b: float = B) -> Stats:
    """Numbers of a corpus from (row, dl); `dead`: (row)."""
    live = lengths if dead is None else lengths.join(dead.select("row").distinct(), "row", "left_anti")
    n = lengths.count() if dead is not None else None
    got = live.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("s")).first()
    return Stats(n if n is not None else got["n"], got["n"], got["s"], k1, b)


def idf(df: Column | str, stats: Stats) -> Column:
    df = F.col(df).cast("double") if isinstance(df, str) else df
    return F.log((F.lit(float(stats.n_live)) - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def norm(dl: Column | str, stats: Stats) -> Column:
    """The document's part of the formula."""
    dl = F.col(dl) if isinstance(dl, str) else dl
    return F.lit(stats.k1) * (F.lit(1.0 - stats.b) + F.lit(stats.b) * dl.cast("double") / F.lit(stats.avgdl or 1.0))


def saturation(tf: Column | str, dl: Column | str, stats: Stats) -> Column:
    tf = (F.col(tf) if isinstance(tf, str) else tf).cast("double")
    return tf * F.lit(stats.k1 + 1.0) / (tf + norm(dl, stats))


def live(posts: DataFrame, dead: DataFrame) -> DataFrame:
    """Postings of rows that are not tombstoned."""
    return posts.join(dead.select("row").distinct(), "row", "left_anti")


def weights(posts: DataFrame, lex: DataFrame, stats: Stats) -> DataFrame:
    """(term, row, w): materialised contributions, valid for one state of the corpus and its parameters only."""
    return posts.join(lex, "term").select("term", "row", (idf("df", stats) * saturation("tf", "dl", stats)).alias("w"))


def closed(posts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings whose term is in a closed vocabulary; lengths go on counting all tokens."""
    return posts.join(vocabulary.select("term"), "term", "left_semi")


def unknown_terms(posts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term): terms that a closed vocabulary lacks."""
    return posts.select("term").distinct().join(vocabulary.select("term"), "term", "left_anti")


def reconcile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(term, stored_df, stored_tf, df, tf): terms whose numbers in stored postings differ from those in fresh ones; null where one side lacks the term."""
    a, b = (x.groupBy("term").agg(F.count("*").alias(f"{p}df"), F.sum("tf").alias(f"{p}tf")) for x, p in ((stored, "stored_"), (fresh, "")))
    return a.join(b, "term", "full_outer").where(~(F.col("stored_df").eqNullSafe(F.col("df")) & F.col("stored_tf").eqNullSafe(F.col("tf")))).select("term", "stored_df", "stored_tf", "df", "tf")
