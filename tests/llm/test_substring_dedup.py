"""Substring dedup: the chains against a quadratic search, planted passages, and texts that must stay."""

import random

import numpy as np
import pytest
from cases import clashing, documents, odd_rows, rows_of, sentence

from lexispark.llm import substring_dedup as sd


def best_chain(fragments, k, gap):
    """Largest score of a chain, by trying every predecessor."""
    order = sorted(range(len(fragments)), key=lambda i: fragments[i][0])
    score = {}
    for i in order:
        x1, x2, y1, _ = fragments[i]
        score[i] = x2 - x1 + k
        for j in score:
            if j == i:
                continue
            u1, u2, v1, _ = fragments[j]
            v2 = v1 + u2 - u1
            if u2 < x1 and v2 < y1:
                score[i] = max(score[i], x2 - x1 + k + score[j] - gap * (x1 - u2 - k + y1 - v2 - k))
    return max(score.values())


@pytest.mark.parametrize("seed", range(20))
def test_chain_score_is_the_best(seed):
    rng = random.Random(seed)
    fragments = [(x := rng.randrange(200), x + rng.randrange(20), rng.randrange(200), rng.randrange(1, 4)) for _ in range(rng.randrange(2, 40))]
    found = sd.chain(fragments, 5, 0.125)
    assert sorted(i for c in found for i in c) == list(range(len(fragments)))
    first = found[0]
    for a, b in zip(first, first[1:]):
        assert fragments[a][1] < fragments[b][0] and fragments[a][2] + fragments[a][1] - fragments[a][0] < fragments[b][2]
    total = sum(fragments[i][1] - fragments[i][0] + 5 for i in first)
    for a, b in zip(first, first[1:]):
        total -= 0.125 * (fragments[b][0] - fragments[a][1] - 5 + fragments[b][2] - (fragments[a][2] + fragments[a][1] - fragments[a][0]) - 5)
    assert total == pytest.approx(best_chain(fragments, 5, 0.125))


def test_fenwick_gives_prefix_maxima():
    rng = random.Random(1)
    tree, plain = sd.Fenwick(50), [(float("-inf"), -1)] * 50
    for i in range(300):
        at, value = rng.randrange(50), (rng.random(), i)
        tree.put(at, value)
        plain[at] = max(plain[at], value)
        n = rng.randrange(51)
        assert tree.top(n) == max(plain[:n], default=(float("-inf"), -1))


@pytest.mark.parametrize("seed", range(10))
def test_segments_are_similar_and_disjoint(seed):
    equal = np.random.default_rng(seed).random(300) < 0.75
    out = sd.segments(equal)
    for (a, b), nxt in zip(out, [*out[1:], (301, 0)]):
        assert b <= nxt[0] and equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-9


def passage_rows(rng):
    """Documents with passages that an earlier one holds: exact, edited, many times over; and what of each document must go."""
    exact, fuzzy, popular = sentence(rng, 70), sentence(rng, 90).split(), sentence(rng, 60)
    edited = list(fuzzy)
    for i in range(12, 90, 19):
        edited[i] = "changed"
    del edited[50]
    edited.insert(30, "inserted")
    rows = [(i, f"{sentence(rng, 40)} {p} {sentence(rng, 40)}") for i, p in enumerate([exact, " ".join(fuzzy), popular])]
    rows += [(10, f"{sentence(rng, 50)} {exact} {sentence(rng, 30)}"), (11, f"{sentence(rng, 20)} {' '.join(edited)} {sentence(rng, 30)}")]
    rows += [(100 + i, f"{sentence(rng, 25)}. {popular}! {sentence(rng, 25)}") for i in range(40)]
    rows += [(200 + i, sentence(rng, 150)) for i in range(20)]
    gone = {10: exact.split(), 11: edited} | {100 + i: popular.split() for i in range(40)}
    return rows, gone


def test_planted_passages_are_found(spark):
    rows, gone = passage_rows(random.Random(7))
    out = sd.repeated_passages(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in out} == gone.keys()
    for r in out:
        assert r["source_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and abs(r["end"] - r["start"] - len(gone[r["doc_id"]])) <= 3
        assert abs(r["source_end"] - r["source_start"] - len(gone[r["doc_id"]])) <= 4
    assert {r["source_doc_id"] for r in out if r["doc_id"] >= 100} == {2}


def test_planted_passages_go_and_the_rest_stays(spark):
    rows, gone = passage_rows(random.Random(8))
    docs = clashing(documents(spark, rows))
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert left.keys() == {d for d, _ in rows}
    for d, text in rows:
        new = left[d]["text"]
        assert left[d]["d"] == "own d" and left[d]["n_chars"] == len(new)
        if d in gone:
            assert len(new.split()) < len(text.split()) - len(gone[d]) + 6
            assert set(new.split()[:15]) <= set(text.split())
        else:
            assert new == text


def test_copies_go_but_the_first(spark):
    rng = random.Random(9)
    text = sentence(rng, 200)
    rows = [(5 + i, text) for i in range(30)] + [(1, sentence(rng, 100))]
    assert sorted(r["doc_id"] for r in sd.remove_repeats(documents(spark, rows)).collect()) == [1, 5]
    out = sd.repeated_passages(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in out) == [(5 + i, 5, 0, 200) for i in range(1, 30)]


def test_short_matches_and_repeats_within_a_document_stay(spark):
    rng = random.Random(10)
    short = sentence(rng, 30)
    own = sentence(rng, 80)
    rows = [(1, f"{sentence(rng, 50)} {short}"), (2, f"{short} {sentence(rng, 50)}"), (3, f"{own} and again {own}")]
    assert sd.repeated_passages(documents(spark, rows)).collect() == []
    assert rows_of(sd.remove_repeats(documents(spark, rows)).select("doc_id", "text")) == sorted(rows)


def test_odd_rows(spark):
    rows = odd_rows(random.Random(11))
    out = sd.repeated_passages(documents(spark, rows)).collect()
    assert [(r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in out] == [(8, 7, 0, 30_000)]
    left = sd.remove_repeats(documents(spark, rows)).select("doc_id", "text")
    assert rows_of(left) == sorted((r for r in rows if r[0] != 8), key=repr)


def test_empty_table(spark):
    assert sd.repeated_passages(documents(spark, [])).collect() == []
    assert sd.remove_repeats(documents(spark, [])).collect() == []


def test_query_finds_every_long_exact_repeat(spark, sf):
    """Every run of 60 words or more that an earlier document holds too lies in a reported passage."""
    from lexispark.llm.queries import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = {}
    for r in QUERIES["op1_substring_dedup"](spark, sf).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    import re

    seen, missed, total = set(), 0, 0
    for d, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i : i + 60]) for i in range(len(words) - 59)]
        for i, g in enumerate(grams):
            if g in seen:
                total += 1
                missed += not any(a <= i + 2 and i + 58 <= b for a, b in found.get(d, []))
        seen.update(grams)
    assert total > 100 and missed == 0


def test_a_replaced_clause_does_not_hide_a_passage():
    """40 equal words, 5 replaced, 15 equal are 0.92 alike over 60 words, though no part of it that scores best has 45."""
    noise = [False] * 30
    equal = np.array([*noise, *[True] * 40, *[False] * 5, *[True] * 15, *noise])
    assert sd.segments(equal, 0.8, 45) == [(30, 90)]
    own, other = np.arange(120, dtype=np.uint32), np.arange(120, dtype=np.uint32) + 1000 * (~equal).astype(np.uint32)
    hit = {"slice": other.astype(np.uint32).tobytes(), "base": 0, "r": 1, "frags": [30, 60, 30]}
    assert [(p["start"], p["end"]) for p in sd.aligned(own, [hit], 45, 0.8)] == [(30, 90)]


@pytest.mark.parametrize("seed", range(10))
def test_segments_miss_no_stretch(seed):
    """Where there is a stretch of 45 columns or more that is 0.8 alike, begins and ends equal, one is found that meets it."""
    equal = np.random.default_rng(seed).random(200) < np.repeat(np.random.default_rng(seed + 50).choice([0.5, 0.75, 0.85, 0.95], 10), 20)
    out = sd.segments(equal, 0.8, 45)
    assert all(equal[a] and equal[b - 1] and b - a >= 45 and equal[a:b].mean() >= 0.8 - 1e-9 for a, b in out)
    for a in np.flatnonzero(equal):
        for b in np.flatnonzero(equal) + 1:
            if b - a >= 45 and equal[a:b].mean() >= 0.8:
                assert any(a < d and c < b for c, d in out)


def composite_rows(rng, trials):
    """Passages of pieces that different earlier documents hold, in two later documents; the last of them must lose all of it."""
    rows, gone = [], {}
    for t in range(trials):
        pieces = [sentence(rng, n) for n in ((30, 30) if t % 2 else (20, 20, 20))]
        rows += [(100 * t + i, f"{sentence(rng, 40)} {p} {sentence(rng, 40)}") for i, p in enumerate(pieces)]
        rows += [(100 * t + i, f"{sentence(rng, 30)} {' '.join(pieces)} {sentence(rng, 30)}") for i in (50, 51)]
        gone[100 * t + 51] = 100 * t + 50
    return rows, gone


def test_passages_of_pieces_held_elsewhere(spark):
    rows, gone = composite_rows(random.Random(13), 40)
    out = sd.repeated_passages(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["source_doc_id"] for r in out} == gone
    assert all(58 <= r["end"] - r["start"] <= 66 for r in out)


def test_one_word_over_and_over_is_few_passages(spark):
    """Runs of one word have one first place for all their seeds; they don't give a passage a seed."""
    rng = random.Random(14)
    rows = [(i, f"{sentence(rng, 40)} {'the ' * 300} {sentence(rng, 40)}") for i in range(3)]
    assert len(sd.repeated_passages(documents(spark, rows)).collect()) <= 12


def test_most_fuzzy_passages_are_found(spark):
    """Of passages of 60 words nearly all that are 0.85 alike, and those with an edit at every eighth word."""
    rng = random.Random(15)
    rows, want = [], {}
    for t in range(200):
        old = sentence(rng, 60).split()
        new = list(old)
        for i in range(3, 60, 8) if t % 2 else rng.sample(range(60), 9):
            new[i] = f"edit{rng.randrange(10**6)}"
        rows += [(10 * t, f"{sentence(rng, 40)} {' '.join(old)} {sentence(rng, 40)}"), (10 * t + 1, f"{sentence(rng, 40)} {' '.join(new)} {sentence(rng, 40)}")]
        want[10 * t + 1] = 10 * t
    found = {r["doc_id"]: r["source_doc_id"] for r in sd.repeated_passages(documents(spark, rows)).collect() if min(r["end"], 100) - max(r["start"], 40) >= 40}
    assert found.items() <= want.items() and len(found) >= 190


@pytest.mark.parametrize("often", [1, 8])
def test_frequent_seeds_give_the_same(spark, monkeypatch, often):
    """The same passages whether a seed's rows are dealt by its hash or get its first place by a broadcast."""
    rows, _ = passage_rows(random.Random(13))
    docs = documents(spark, rows)
    plain = sorted(map(tuple, sd.repeated_passages(docs).collect()))
    monkeypatch.setattr(sd, "LOOKED_AT", 1)
    monkeypatch.setattr(sd, "OFTEN", often)
    assert len(sd.frequent(docs.select("doc_id", "text"))) > 5
    assert sorted(map(tuple, sd.repeated_passages(docs).collect())) == plain and plain
