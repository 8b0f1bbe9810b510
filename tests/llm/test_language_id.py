"""Language identification: the chain's marginals against full enumeration, held-out accuracy, odd texts."""

import itertools
import random
import zlib

import numpy as np
import pytest
from cases import clashing, documents, odd_rows

from lexispark.llm import language_id as li

WORDS = {"en": "the of and house water with that".split(), "de": "der und das haus wasser mit dass".split(), "fr": "le des et maison avec eau que".split()}


def text_of(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths, n = [3, 1, 5], 3
    first = np.append(0, np.cumsum(lengths))
    em, start = rng.normal(size=(first[-1], n)), rng.dirichlet(np.ones(n))
    moves = rng.dirichlet(np.ones(n), n)
    gamma, both = li.forward_backward(em, first, start, moves)
    pairs = np.zeros((n, n))
    for a, size in zip(first, lengths):
        marginal, own, total = np.zeros((size, n)), np.zeros((n, n)), 0.0
        for path in itertools.product(range(n), repeat=size):
            p = start[path[0]] * np.exp(sum(em[a + i, t] for i, t in enumerate(path))) * np.prod([moves[x, y] for x, y in zip(path, path[1:])])
            total += p
            for i, t in enumerate(path):
                marginal[i, t] += p
            for x, y in zip(path, path[1:]):
                own[x, y] += p
        assert np.allclose(gamma[a : a + size], marginal / total)
        pairs += own / total
    assert np.allclose(both, pairs)


def test_held_out_accuracy_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op3_language_id"](spark, sf).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in out if r["held_out"] and truth[r["doc_id"]][0]]
    assert len(held) > 30 and sum(held) / len(held) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang), lang) for i, lang in enumerate(list(WORDS) * 40)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    a = li.identify(documents(spark, rows)).collect()
    wrong = [(i, t, "xx" if i in held else x) for i, t, x in rows]
    b = li.identify(documents(spark, wrong)).collect()
    assert sorted(a) == sorted(b)
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in a) >= len(rows) - 2


def test_words_of_mixed_text_are_labelled(spark):
    rng = random.Random(2)
    model = li.Model(sorted(WORDS))
    langs = [x for x in WORDS for _ in range(60)]
    model.fit([text_of(rng, x) for x in langs], langs)
    import pyarrow as pa

    data, offs = li.layout(pa.array([" ".join([text_of(rng, "en", 15), text_of(rng, "de", 15), text_of(rng, "fr", 15)])]))
    best = model.words(li.Letters(data, offs, 0, 1)).argmax(axis=1)
    wanted = np.repeat([model.langs.index(x) for x in ("en", "de", "fr")], 15)
    assert (best == wanted).mean() > 0.95


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(1000 + i, text_of(rng, lang), lang) for i, lang in enumerate(list(WORDS) * 40)] + [(2000, text_of(rng, "en"), None)] + odd_rows(rng) + [(3000, "1234 5678 !?"), (3001, "“”…"), (3002, "é"), (3003, "²³")]
    out = li.identify(clashing(documents(spark, rows))).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for d in (1, 2, 3, 6, 3000, 3001, 3003):
        assert (by_id[d]["lang_pred"], by_id[d]["score"]) == ("und", 0.0), d
    assert by_id[3002]["lang_pred"] != "und" and by_id[2000]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    assert all(r["lang_pred"] in {*WORDS, "und"} for r in out)


def test_one_language_none_and_no_rows(spark):
    rng = random.Random(4)
    one = li.identify(documents(spark, [(i, text_of(rng, "de"), "de") for i in range(10)])).collect()
    assert {(r["lang_pred"], round(r["score"], 9)) for r in one} == {("de", 1.0)}
    none = li.identify(documents(spark, [(i, text_of(rng, "de"), None) for i in range(4)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert li.identify(documents(spark, [])).collect() == []
