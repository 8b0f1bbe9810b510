"""Fingerprints of documents and their edited texts, against the definition a row at a time."""

import hashlib
import random

import numpy as np
from cases import clashing, documents, odd_rows, sentence

from lexispark.llm import fingerprints


def brute(rows):
    """(doc_id, n_chars, sha256 of the edited text, both texts, the next text) in the order of descending ids; ids must be distinct."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        new = text[: len(text) - k] + following[:k]
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, following))
    return out


def check(rows, out):
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    for d, n, sha, text, new, following in brute(rows):
        r = got[d]
        own, changed, after = (p.tobytes().hex() for p in fingerprints.simhash([text, new, following]))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, own, changed), d
        near = [float(fingerprints.likeness(np.frombuffer(bytes.fromhex(own), np.uint8)[None], np.frombuffer(bytes.fromhex(x), np.uint8)[None])[0]) for x in (changed, after)]
        assert [r["near_edited"], r["near_next"]] == near and all(0 <= x <= 1 for x in near)


def test_matches_definition(spark):
    rng = random.Random(1)
    rows = list({d: (d, t) for d, t in odd_rows(rng) if d is not None}.values()) + [(1000 + 3 * i, sentence(rng, rng.randrange(0, 120))) for i in range(150)]
    check(rows, fingerprints.fingerprint_documents(clashing(documents(spark, rows))).collect())


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op9_fingerprints"](spark, sf).collect()
    check(rows, out)
    prints = {r["doc_id"]: np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint8) for r in out}
    every = np.stack(list(prints.values()))
    for r in out:
        assert r["n_near"] == (int((np.bitwise_count(every ^ prints[r["doc_id"]]).sum(axis=1) <= fingerprints.RADIUS).sum()) if r["doc_id"] % fingerprints.ASKED == 0 else None)
    edited, following = np.mean([r["near_edited"] for r in out]), np.mean([r["near_next"] for r in out])
    assert edited > 0.55 > 0.25 > following


def test_repeated_and_missing_ids_give_a_row_each(spark):
    rows = odd_rows(random.Random(2))
    out = fingerprints.fingerprint_documents(documents(spark, rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_chars"]) for r in out) == sorted((repr(d), len(t or "")) for d, t in rows)


def test_one_row_and_none(spark):
    out = fingerprints.fingerprint_documents(documents(spark, [(5, "abcdef")])).collect()
    assert len(out) == 1 and out[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and out[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(documents(spark, [])).collect() == []


def test_many_ids_alike(spark):
    rows = [(7, f"text {i}") for i in range(50)]
    out = fingerprints.fingerprint_documents(documents(spark, rows)).collect()
    assert len(out) == 50


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    near = base.copy()
    for i in range(40):
        for b in rng.choice(256, i, replace=False):
            near[i, b // 8] ^= np.uint8(1 << (b % 8))
    prints = np.concatenate([base, near])
    df = spark.createDataFrame([(p.tobytes().hex(),) for p in prints], "fingerprint string")
    got = {(r["fp"], r["near_fp"]): r["differing"] for r in fingerprints.search(df, df, 24).collect()}
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    wanted = {(prints[i].tobytes().hex(), prints[j].tobytes().hex()): int(distance[i, j]) for i, j in np.argwhere(distance <= 24)}
    assert got == wanted


def test_a_pair_comes_out_once(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (20, 32), dtype=np.uint8)
    near = np.repeat(base, 12, axis=0)
    for i in range(len(near)):
        for b in rng.choice(256, i % 12, replace=False):
            near[i, b // 8] ^= np.uint8(1 << (b % 8))
    df = spark.createDataFrame([(p.tobytes().hex(),) for p in np.concatenate([base, near])], "fingerprint string")
    rows = fingerprints.search(df, df).collect()
    every = np.unique(np.concatenate([base, near]), axis=0)
    distance = np.bitwise_count(every[:, None] ^ every[None]).sum(axis=2)
    assert len(rows) == len({(r["fp"], r["near_fp"]) for r in rows}) == int((distance <= fingerprints.RADIUS).sum())


def test_neighbours_of_odd_rows(spark):
    docs = documents(spark, [*odd_rows(random.Random(5)), (20, "one text"), (21, "one text"), (40, None)])
    out = fingerprints.fingerprints_and_neighbours(docs).collect()
    assert len(out) == len(odd_rows(random.Random(5))) + 3
    near = {r["doc_id"]: r["n_near"] for r in out}
    assert near[20] == 2 and near[21] is None and near[None] is None and near[40] >= 2
    assert fingerprints.fingerprints_and_neighbours(documents(spark, [])).collect() == []


def test_ranges_by_bytes(spark, monkeypatch):
    """Many ranges, each in a partition of its own."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2_000)
    rng = random.Random(6)
    rows = [(7 * i - 300, sentence(rng, rng.randrange(0, 60))) for i in range(200)]
    assert len(fingerprints._ranges(documents(spark, rows))) > 20
    check(rows, fingerprints.fingerprint_documents(documents(spark, rows)).collect())


def test_keys_fall_into_partitions_one_by_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 200):
        keys = fingerprints._keys(n)
        df = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        assert [r["p"] for r in df.collect()] == list(range(n))


def test_only_fingerprints_that_may_meet_a_query_are_dealt(spark, monkeypatch):
    """All within the radius of a query, and few others."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    near = base[:100].copy()
    for i in range(100):
        for b in rng.choice(256, i % 8, replace=False):
            near[i, b // 8] ^= np.uint8(1 << (b % 8))
    rows = [(20 * i, p.tobytes().hex()) for i, p in enumerate(base[:100])] + [(20 * i + 1, p.tobytes().hex()) for i, p in enumerate(base[100:])] + [(20 * i + 2, p.tobytes().hex()) for i, p in enumerate(near)]
    dealt, search = [], fingerprints.search
    monkeypatch.setattr(fingerprints, "search", lambda pool, *a: dealt.append(pool.count()) or search(pool, *a))
    out = fingerprints.with_neighbours(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert len(out) == len(rows) and {r["doc_id"]: r["n_near"] for r in out} == {d: 2 if d % 20 == 0 else None for d, _ in rows}
    assert 200 <= dealt[0] < 600
