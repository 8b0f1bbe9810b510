"""How the index writes its tables: what must not move or meet in one task."""

import os

import pyarrow.parquet as pq

from lexispark import Index
from lexispark.sources.local import local_rows


def many(spark, n=1_500):
    return local_rows(spark, [(f"d{i:05d}", f"f{i % 7}.txt", i, f"common word{i % 50} only{i} word{i % 50}") for i in range(n)], "docid string, file string, line int, text string")


def held(folder):
    return [pq.read_table(f"{folder}/{f}").to_pydict() for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]


def test_postings_stay_with_their_documents(spark, tmp_path):
    small = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        index = Index.create(spark, str(tmp_path), many(spark))
    finally:
        for k in small:
            spark.conf.unset(k)
    parts = [t for t in held(f"{index.state.parts[0]}/postings") if t["row"]]
    assert len(parts) > 1
    ranges = sorted((min(t["row"]), max(t["row"])) for t in parts)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # by ranges of terms they would overlap
    for t in parts:
        assert list(zip(t["term"], t["row"])) == sorted(zip(t["term"], t["row"]))
    assert sum(len(t["row"]) for t in parts) == index.state.total("nnz") == 4_500
    index.compact()
    assert sum(len(t["row"]) for t in held(f"{index.state.parts[0]}/postings")) == 4_500
    assert index.reconcile().count() == 0 and len(index.search("common", 2_000)) == 1_500
