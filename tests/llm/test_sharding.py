"""Shards: the scheduler against a plain one, and the properties that rows must have."""

import random
import zlib

import pytest
from cases import clashing, documents, odd_rows, sentence

from lexispark.llm import sharding


@pytest.mark.parametrize("seed", range(5))
def test_lpt_against_a_plain_loop(seed):
    rng = random.Random(seed)
    items = [(rng.randrange(1, 50), i) for i in range(rng.randrange(0, 60))]
    load, wanted = [0] * 4, [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], str(items[i][1]))):
        wanted[i] = min(range(4), key=lambda s: (load[s], s))
        load[wanted[i]] += items[i][0]
    assert sharding.lpt(items, 4) == wanted


def check(rows, out, shards=16):
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, of_text, load = {}, {}, [0] * shards
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        of_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return load


def test_odd_rows(spark):
    rows = odd_rows(random.Random(1)) + [(100 + i, sentence(random.Random(i % 40), 20)) for i in range(300)]
    check(rows, sharding.shard(clashing(documents(spark, rows))).collect())


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    load = check(rows, QUERIES["op10_sharding"](spark, sf).collect())
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    plain = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert max(load) <= 1.01 * max(plain)


def test_empty_table(spark):
    assert sharding.shard(documents(spark, [])).collect() == []
