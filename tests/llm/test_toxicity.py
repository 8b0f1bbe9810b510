"""Toxicity: the calibration against a plain fit, held-out ranking, odd texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import LABELS, clashing, documents, odd_rows, sentence

from lexispark.llm import toxicity as tox


def auc(scores, labels):
    p, n = (np.array([s for s, y in zip(scores, labels) if y == k]) for k in (1, 0))
    return (p[:, None] > n[None]).mean() + 0.5 * (p[:, None] == n[None]).mean()


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_fit_is_the_least_squares_one(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 15, 60).astype(float), (rng.random(60) < 0.4).astype(float)
    knots, values = tox.isotonic(x, y)
    fitted = np.interp(x, knots, values)
    # min-max formula over the distinct places
    at = np.unique(x)
    total, count = (np.array([f(y[x == a]) for a in at]) for f in (np.sum, len))
    mean = lambda i, j: total[i : j + 1].sum() / count[i : j + 1].sum()
    wanted = {a: max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k, a in enumerate(at)}
    assert np.allclose(fitted, [wanted[a] for a in x])


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    model = tox.Boosted(x[:400], y[:400])
    assert auc(model.margin(x[400:]), y[400:]) > 0.98


def test_stand_ins_are_read_as_letters():
    data, offs = tox.layout(pa.array(["moron m0r0n M0R0N 12345 st@ple", None]))
    w = tox.Loose(data, offs, 0, 2)
    whole = w.terms()[0]
    assert whole[0] == whole[1] == whole[2] != whole[3]
    assert w.mixed.tolist() == [False, True, True, False, True]
    assert w.first.tolist() == [0, 5, 5]


def fixture(n=600):
    rng = random.Random(4)
    bad = ["grubble", "snarkface", "blitherer", "vexling"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = sentence(rng, rng.randrange(20, 200)).split()
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(bad) if rng.random() < 0.7 else rng.choice(bad).upper().replace("E", "3")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = fixture()
    out = tox.score_documents(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    truth = {d: t for d, _, t in labels}
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held_out"]]
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = fixture(300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    a, b = (sorted(tox.score_documents(documents(spark, rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows_and_reject(spark):
    rows, labels = fixture(400)
    odd = [(None if d is None else d + 10_000, t) for d, t in odd_rows(random.Random(5))]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (10_001, None, None), (99_999, 1, 1), (labels[0][0], 0, labels[0][2])], LABELS)
    docs = clashing(documents(spark, rows + odd))
    out = tox.score_documents(docs, marks).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["predicted"] for r in out if r["doc_id"] is None or r["doc_id"] > 9_000} == {0}
    kept = tox.reject(docs, marks)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == sum(1 - r["predicted"] for r in out)
    assert all(r["_toxicity"] == "own _toxicity" for r in left)


def test_without_labels_or_rows(spark):
    rows, _ = fixture(20)
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in tox.score_documents(documents(spark, rows), none).collect()} == {(0.0, 0)}
    one_kind = spark.createDataFrame([(d, 1, 0) for d, _ in rows], LABELS)
    assert {r["predicted"] for r in tox.score_documents(documents(spark, rows), one_kind).collect()} == {0}
    assert tox.score_documents(documents(spark, []), none).collect() == []
    assert tox.reject(documents(spark, []), none).collect() == []


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    out = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in out)
