"""Decontamination against a search window by window; the FM-index against a plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import clashing, documents, odd_rows, rows_of, sentence

from lexispark.llm import decontaminate
from lexispark.llm.fm_index import Bits, FMIndex, Wavelet

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(docs, bench, **more):
    return rows_of(decontaminate.contamination(docs, bench, **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


@pytest.fixture
def planted(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.choice([12, 15, 40]))) for i in range(12)] + [(20, "short item"), (21, ""), (22, None), (23, "short item"), (24, "!!"), (25, "word"), (7, "a second text of an item id that stands twice in the table of items")]
    rows = [(100 + i, sentence(rng, 30) + " " + items[i % 12][1].upper().replace(" ", ", ") + " " + sentence(rng, 30)) for i in range(20)]
    rows += [(200 + i, items[i][1] + " " + items[i][1]) for i in range(4)] + [(300, "here is a short item, see"), (301, "short. Item")] + [(400 + i, sentence(rng, 200)) for i in range(5)]
    return rows + odd_rows(rng), items


def test_matches_brute_force(spark, planted):
    rows, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(documents(spark, rows), bench) == brute(rows, items)


def test_parts_of_the_benchmark_give_the_same(spark, planted):
    rows, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(documents(spark, rows), bench, part_bytes=900) == brute(rows, items)


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows_of(QUERIES["op6_decontamination"](spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_decontaminate_cuts_all_hits_and_nothing_else(spark, planted):
    rows, items = planted
    bench = spark.createDataFrame([i for i in items if i[0] < 12], "item_id long, text string")
    docs = clashing(documents(spark, rows))
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    left = out.collect()
    assert all(r["items"] == "own items" and (r["text"] is None or r["n_chars"] == len(r["text"])) for r in left)
    hit = {r[0] for r in brute(rows, [i for i in items if i[0] < 12]) if r[-1]}
    clean = sorted(((d, t) for d, t in rows if d not in hit), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in left if r["doc_id"] not in hit), key=repr) == clean
    again = brute([(r["doc_id"], r["text"]) for r in left], [i for i in items if i[0] < 12])
    assert not any(r[-1] for r in again)
    assert 200 not in {r["doc_id"] for r in left}  # nothing is left of it
    assert {100 + i for i in range(20)} <= {r["doc_id"] for r in left}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert found(documents(spark, []), bench) == []
    assert found(documents(spark, [(1, "some words")]), bench) == brute([(1, "some words")], [])
    assert decontaminate.decontaminate(documents(spark, [(1, "some words")]), bench).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_finds_what_a_plain_search_finds(seed):
    rng = np.random.default_rng(seed)
    symbols = int(rng.integers(1, 40))
    segments = [rng.integers(1, symbols + 1, int(rng.integers(1, 60))) for _ in range(int(rng.integers(1, 30)))] + [np.full(50, 1), np.full(50, 1)]
    text = np.concatenate([np.append(s, 0) for s in segments])
    index = FMIndex(text, symbols)
    for n in (1, 2, 3, 7):
        patterns = np.concatenate([[s[i : i + n] for s in segments for i in range(max(0, len(s) - n + 1))][:40] or np.zeros((0, n), np.int64), rng.integers(1, symbols + 1, (20, n))])
        lo, hi = index.search(patterns.astype(np.int64))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            places = sorted(index.locate(np.arange(a, b)).tolist())
            assert places == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]


def test_bits_and_wavelet_rank():
    rng = np.random.default_rng(1)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (Bits(bits).rank(at) == np.append(0, np.cumsum(bits))).all()
    seq = rng.integers(0, 37, 1000)
    tree = Wavelet(seq, 6)
    assert (tree.get(np.arange(1000)) == seq).all()
    for c in (0, 5, 36):
        assert (tree.rank(np.full(1001, c), at) == np.append(0, np.cumsum(seq == c))).all()


@pytest.mark.parametrize("part_bytes", [16 << 20, 200])
def test_items_without_an_id(spark, planted, part_bytes):
    """A null item_id is the empty name; all such items are one."""
    rows, items = planted
    rng = random.Random(9)
    nameless = [sentence(rng, 14) for _ in range(2)]
    rows = rows + [(500 + i, f"{sentence(rng, 20)} {t} {sentence(rng, 20)}") for i, t in enumerate(nameless)] + [(510, " ".join(nameless))]
    bench = spark.createDataFrame(items + [(None, t) for t in nameless] + [(None, None)], "item_id long, text string")
    assert found(documents(spark, rows), bench, part_bytes=part_bytes) == brute(rows, items + [("", t) for t in nameless])
