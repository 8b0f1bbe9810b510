"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexispark.index.index import Index
from lexispark.plans import catalogue

K, SINGLE, SEGMENTS = 10, 5, 8


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="lexispark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"{work}/checkpoint").config("spark.sql.warehouse.dir", f"{work}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 4)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    try:
        docs = catalogue.docs_of(spark, folder)
        noop(docs.limit(1))  # the session's own start isn't a query
        texts = catalogue.as_texts(docs)
        index = timed("index_build", lambda: Index.create(spark, f"{work}/index", texts))
        size = index.stats()
        queries = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
        noop(index.postings())
        timed("search_batch", lambda: index.search_batch(queries, K, with_text=False))
        timed("search_single", lambda: [index.search(q, K) for q in queries[:SINGLE]])
        index.config(materialised=True)
        timed("weights_build", index.weights)
        timed("search_batch_weights", lambda: index.search_batch(queries, K, with_text=False))
        index.config(materialised=False)
        batch = texts.limit(100)
        timed("update_100_rows", lambda: index.upsert(index.chunks().limit(100).select("row"), batch))
        parts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SEGMENTS + 1)))
        split = Index.create(spark, f"{work}/split", catalogue.as_texts(parts.where("part = 0")))
        for i in range(1, SEGMENTS + 1):
            split.publish(catalogue.as_texts(parts.where(F.col("part") == i)))
        timed("search_batch_mounted_8", lambda: split.search_batch(queries, K, with_text=False))
        timed("fold_and_compact", split.compact)
        timed("search_batch_folded", lambda: split.search_batch(queries, K, with_text=False))
        for name in ("tokenize_docs", "chunk_prose", "term_freq", "idf_table", "bm25_topk", "bm25_topk_batch", "explain_contrib", "fused_topk", "hit_span", "hash_diff"):
            timed(name, lambda name=name: noop(catalogue.QUERIES[name](spark, folder)))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    detail = {"documents": size["rows"], "postings": size["nnz"], "terms": size["terms"], "postings_per_sec_build": round(size["nnz"] / took["index_build"]), "queries": len(queries), "batch_ms_per_query": round(1000 * took["search_batch"] / len(queries), 3), "batch_weights_ms_per_query": round(1000 * took["search_batch_weights"] / len(queries), 3), "single_ms_per_query": round(1000 * took["search_single"] / SINGLE, 1)}
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "detail": detail}))


if __name__ == "__main__":
    main()
