"""Packing: ids against the tokenizer, an exact round trip, and best-fit decreasing piece by piece."""

import random
import zlib

import numpy as np
import pytest
from cases import documents, odd_rows, sentence

from lexispark.llm import packing

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path(NAME))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_cached_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    encode = packing.Encoder(packing.tokenizer_path(NAME))
    signs = [chr(c) for c in range(9, 0x250) if c not in range(0xD800, 0xE000)] + list("漢字がな한국́​ ’“…—𝒳ﬁſßİı") + ["<|endoftext|>", "<|", "|>", "'s", "'LL", "don't", "1st", "  ", "\n\n", "ABC", "é", "_x_", "a_b", "1²³½"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(4000)] + [sentence(rng, 50), "Don't STOP, it's 10:30 p.m. — you'll see!", "", "­ soft­hyphen", "İstanbul", "x" * 3000]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_cache_generations_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    rng = random.Random(2)
    encode = packing.Encoder(packing.tokenizer_path(NAME))
    for _ in range(200):
        text = sentence(rng, rng.randrange(1, 12))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_round_trip(rows, docs, tokenizer, capacity=2048):
    """Every id of every document lies in one piece, and no two pieces overlap."""
    sequences, by_doc = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = {}
    for d, text in docs:
        wanted.setdefault(d, []).append(ids_of(tokenizer, text))
    assert by_doc.keys() == wanted.keys()
    for d, pieces in by_doc.items():
        assert sum(len(i) for _, i, _ in pieces) == sum(map(len, wanted[d]))
        if len(wanted[d]) == 1:
            assert [x for _, i, _ in sorted(pieces, key=lambda p: p[0]) for x in i] == wanted[d][0]
            assert {n for _, _, n in pieces} == {len(wanted[d][0])}
        at = sorted((s, len(i)) for s, i, _ in pieces)
        assert len([s for s, _ in at if s == 0]) == len(wanted[d])
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def brute_best_fit(lengths, capacity):
    """Number of windows of best-fit decreasing, a piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, 6) for _ in range(rng.randrange(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_decreasing(counts, capacity)
    used, placed = {}, {}
    for length, rank, n, window, offset in runs:
        for j in range(n):
            used.setdefault(window + j, []).append((offset, length))
            placed.setdefault(length, []).append(rank + j)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
    room = []
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        room.append(capacity - at)
    assert sorted(room) == brute_best_fit(lengths, capacity)


def test_tightest_window():
    tree = packing.OpenWindows(100)
    for r in (3, 50, 97):
        tree.add(r, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 50, 51, 97, 98, 100)] == [3, 3, 50, 50, 97, 97, -1, -1]
    tree.add(50, -1)
    assert tree.tightest(4) == 97


def test_round_trip_of_odd_rows(spark, tokenizer):
    rows = odd_rows(random.Random(3)) + [(500 + i, sentence(random.Random(i), 300)) for i in range(60)]
    out = packing.pack(documents(spark, rows), with_ids=True).collect()
    check_round_trip(out, rows, tokenizer)


def test_query_on_the_table(spark, sf, tokenizer):
    from lexispark.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=True)
    n = check_round_trip(out.collect(), docs, tokenizer)
    lengths = [r["length"] for r in out.collect()]
    assert n == len(brute_best_fit(lengths, 2048)) <= -(-sum(lengths) // 2048) + 3
    query = QUERIES["op4_packing"](spark, sf)
    assert dict(query.dtypes) == {k: "bigint" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    assert sorted(map(tuple, query.collect())) == sorted(map(tuple, out.drop("ids").collect()))


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).collect() == []
