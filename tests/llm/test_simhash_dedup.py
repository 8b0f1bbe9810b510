"""SimHash near-duplicates against all pairs and union-find."""

import random
import re

import numpy as np
import pytest
import xxhash
from cases import clashing, documents, odd_rows, rows_of, sentence

from lexispark.llm import simhash_dedup


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", best.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def planted(rng):
    base = [sentence(rng, 120) for _ in range(20)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:10]):
        words = t.split()
        words[5] = "changed"
        rows += [(200 + i, t), (300 + i, " ".join(words)), (50 - i, t.upper())]
    return rows


def test_matches_brute_force(spark):
    rows = planted(random.Random(1)) + [r for r in odd_rows(random.Random(2)) if len(r[1] or "") < 100_000]
    assert rows_of(simhash_dedup.near_duplicates(documents(spark, rows))) == brute(rows)


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op7_simhash_near_dedup"](spark, sf).select("doc_id", "fingerprint", "component_id")) == brute(rows)


def test_long_chains_are_one_component(spark):
    """A path of fingerprints, each two bits from the next, is one component whatever its length."""
    values, x = [], 0
    for i in range(30):
        x ^= 3 << (2 * i)
        values.append(x - (1 << 64) if x >> 63 else x)
    prints = spark.createDataFrame([(1000 - i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    table = simhash_dedup.component_table(prints).collect()
    assert {r["component_id"] for r in table} == {1000 - 29}
    assert len({r["root"] for r in table}) == 1


@pytest.mark.parametrize("n", [50, 5000])
def test_forest_spans_what_pairs_link(n):
    rng = np.random.default_rng(n)
    free = rng.permutation(64)[:20]
    values = np.unique(np.array([sum(1 << int(b) for b in free[rng.random(20) < 0.5]) for _ in range(n)], dtype=np.uint64))
    edges = simhash_dedup.forest(values, 2)
    assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 2).all()
    at = {int(v): i for i, v in enumerate(values)}
    root = np.arange(len(values))

    def components(pairs):
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in pairs:
            root[find(i)] = find(j)
        return len({find(i) for i in range(len(values))})

    every = []
    for lo in range(0, len(values), 500):
        a, b = np.nonzero(np.bitwise_count(values[lo : lo + 500, None] ^ values[None, :]) <= 2)
        every.append(np.stack([a + lo, b], axis=1))
    every = np.concatenate(every)
    every = every[every[:, 0] < every[:, 1]]
    assert len(root) - len(edges) == components([(at[int(a)], at[int(b)]) for a, b in edges]) == components(every.tolist())


def test_deduplicate_keeps_one_of_each_component(spark):
    rng = random.Random(3)
    rows = planted(rng) + odd_rows(rng)
    docs = clashing(documents(spark, rows))
    out = simhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    prints = [fingerprint(t) if len(t or "") < 100_000 else None for _, t in rows]
    every = {(d, t) for d, t in rows}
    assert {(r["doc_id"], r["text"]) for r in kept} <= every
    assert all(r["d"] == "own d" and r["fp"] == "own fp" for r in kept)
    # a component for each row that stays, none without one
    table = {r["fp"]: r["root"] for r in simhash_dedup.component_table(simhash_dedup.with_fingerprint(docs, ["doc_id"])).collect()}
    roots = [table[int(np.uint64(fingerprint(r["text"])).view(np.int64))] for r in kept]
    assert len(roots) == len(set(roots)) == len(set(table.values()))
    assert len(prints) > len(kept)


def test_empty_table(spark):
    assert simhash_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert simhash_dedup.deduplicate(documents(spark, [])).collect() == []


def test_frequent_fingerprints_by_broadcast(spark, monkeypatch):
    """The same components whether a fingerprint's rows meet it by broadcast or by a join."""
    rng = random.Random(11)
    text = sentence(rng, 40)
    rows = [(i, text) for i in range(60)] + [(100 + i, sentence(rng, 30)) for i in range(20)] + [(200, None), (201, "")]
    docs = documents(spark, rows)
    plain = sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash_dedup, "HOT_KEYS", 20)
    assert sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect())) == plain and len(plain) == len(rows)
    assert {r[2] for r in plain if r[0] < 60} == {0}
