"""Scores of many queries in blocks of documents, against the join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import batch, bm25, postings
from lexispark.sources.local import local_rows


def corpus(spark, seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    texts += texts[:40]  # ties
    return local_rows(spark, [(i * 7, t) for i, t in enumerate(texts)], "row long, text string"), [" ".join(rng.sample(words, rng.randrange(1, 9))) for _ in range(30)] + ["w0", "zzz", "", "w39 zzz"]


def joined(docs, terms):
    posts = postings.postings(docs)
    return bm25.scores(posts, postings.lexicon(posts), terms, postings.corpus_stats(postings.doc_lengths(docs)))


@pytest.mark.parametrize("block", [500, 1_000_000])
def test_best_of_blocks_are_those_of_the_join(spark, block, monkeypatch):
    monkeypatch.setattr(batch, "PAIRS", 40)  # several parts of queries
    docs, queries = corpus(spark, block)
    terms = bm25.terms_of(spark, queries)
    asked = batch.asked(docs, terms, block=block)
    found = batch.best(asked, 5)
    blocks = asked.posts.rdd.getNumPartitions()
    assert (blocks > 3) == (block == 500)
    assert found.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5 * blocks  # the join has a row for each document
    expected = joined(docs, terms)
    ranked = lambda x: sorted(map(tuple, bm25.top_k(x, 5, digits=6).select("qid", "rank", "row", "score").collect()))
    assert ranked(found) == ranked(expected)
    count = expected.where("score > 0").groupBy("qid").agg(F.count("*").alias("n_positive"), F.max("score").alias("max_score"))
    assert sorted(map(tuple, batch.positive(asked).collect())) == sorted(map(tuple, count.collect()))


def test_dead_documents_and_no_documents(spark):
    docs, queries = corpus(spark, 3)
    terms, dead = bm25.terms_of(spark, queries), docs.where("row % 3 = 0").select("row")
    ranked = lambda x: sorted(map(tuple, bm25.top_k(x, 5, digits=6).select("qid", "rank", "row", "score").collect()))
    assert ranked(batch.best(batch.asked(docs, terms, dead), 5)) == ranked(joined(docs.where("row % 3 <> 0"), terms))
    assert batch.best(batch.asked(docs.where("false"), terms), 5).collect() == []
    assert batch.best(batch.asked(docs, bm25.terms_of(spark, ["zzz"])), 5).collect() == []


def test_what_rounding_leaves_open_is_kept():
    unit = bm25.SCALE / 1e6
    sums = np.array([3.4, 5.49999999, 5.5, 5.4, 5.2, 9.0, 5.3]) * unit
    assert batch._chosen(np.arange(7), sums.astype(np.int64), 2).tolist() == [1, 2, 3, 5]
    assert batch._chosen(np.arange(7), sums.astype(np.int64), 7).tolist() == list(range(7))


@pytest.mark.parametrize("runs", [20, 10_000_000])
def test_counted_postings(spark, runs, monkeypatch):
    docs, _ = corpus(spark, 1)
    docs = docs.unionByName(local_rows(spark, [(-1, None), (-2, "中文检索 a a"), (-3, "Ä ä")], "row long, text string"))
    monkeypatch.setattr(postings, "COUNTED", runs)
    found = [tuple(r) for r in postings.counted(docs.repartition(3)).select("row", "dl", "term", "tf").collect()]
    assert sorted(found) == sorted(map(tuple, postings.postings(docs).select("row", "dl", "term", "tf").collect()))
    plan = postings.counted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
