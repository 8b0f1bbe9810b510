"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified Hamming distance, components.

Fingerprint: XXH64 (seed 42) of each 3-word shingle, a bit is 1 if it is set in over half of the hashes. Two fingerprints link at `radius` or fewer
differing bits. With `radius` + 4 blocks, two linked fingerprints agree in 4 blocks at least; each distinct fingerprint is dealt to every choice of
4 of the 6 blocks. A bucket fixes 42 or more of 64 bits, so it holds at most 2**22 distinct fingerprints whatever the corpus holds: equal fingerprints are one
before any bucket is built, and no group of documents is ever gathered. Only the edges of a spanning forest leave a bucket:
fewer rows than members, never all pairs.

Components are found by alternating large-star and small-star steps over those edges, checkpointed in the shared folder.

Defined cases: null or empty text and text of white space have fingerprint zero, which links like any other. Fewer than three words: the whole sequence is
the one shingle. Repeated rows (also of doc_id) stay in `near_duplicates`, each with its component. A null doc_id counts as larger than all; a component without any other has a null id.
Empty tables give no rows. Extra columns are ignored by `near_duplicates` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, durable, few, named_back, over_batches

SHINGLE, RADIUS, BITS = 3, 2, 64
#: A fingerprint is met by broadcast if more rows have it than HOT_ROWS and than one of HOT_KEYS equal parts of all rows.
HOT_ROWS, HOT_KEYS = 10_000, 1_000
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    lanes = np.arange(8, dtype=np.int64) * 256
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        if len(words) <= shingle:
            hashes = np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
        else:
            if shingle == 3:
                hashes = np.array([digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])], dtype=np.uint64)
            else:
                hashes = np.array([digest(b" ".join(x), 42) for x in zip(*(words[j:] for j in range(shingle)))], dtype=np.uint64)
        # how often each value stands in each of the eight bytes; 256 counts a byte give the counts of its bits
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048).reshape(8, 256)
        ones = (seen @ SPREAD).ravel()
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns `keep` and `fp` (the fingerprint as a signed long)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def work(batches):
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return over_batches(docs.select(*dict.fromkeys([*keep, "text"])), work, schema)


def block_masks(radius: int, agree: int = 4) -> list[int]:
    """Bit masks of every choice of `agree` of `radius` + `agree` blocks."""
    n = radius + agree
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [sum(c) for c in combinations(blocks, agree)]


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """Edges (pairs of values) of a spanning forest of the graph that links distinct `values` at `radius` or fewer differing bits.

    Up to 4,096 members are compared in blocks; more look up their neighbours, one mask of the bits that differ among them at a time.
    """
    values = np.sort(values)
    n = len(values)
    root, edges = np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(a: np.ndarray, b: np.ndarray) -> None:
        keep = root[a] != root[b]
        if not keep.any():
            return
        for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((i, j))
        while not np.array_equal(root, flat := root[root]):
            root[:] = flat

    if n <= 4096:
        for lo in range(0, n, 64):
            a, b = np.nonzero(np.bitwise_count(values[lo : lo + 64, None] ^ values[None, lo:]) <= radius)
            union(a[a < b] + lo, b[a < b] + lo)
    else:
        free = [1 << i for i in range(BITS) if int(np.bitwise_or.reduce(values ^ values[0])) >> i & 1]
        for size in range(1, radius + 1):
            for bits in combinations(free, size):
                other = values ^ np.uint64(sum(bits))
                at = np.minimum(np.searchsorted(values, other), n - 1)
                a = np.flatnonzero(values[at] == other)
                a = a[a < at[a]]
                union(a, at[a])
    return values[np.array(edges, dtype=np.int64).reshape(-1, 2)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a < b as signed longs, that connect the distinct values of column `fp` as the links within `radius` do."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)))
    buckets = fps.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def work(batches):
        for batch in batches:
            column = batch.column("fps")
            parts = [forest(np.array(x, dtype=np.int64).view(np.uint64), radius) for x in column.to_pylist()]
            e = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, 2), np.int64)
            e = np.unique(np.sort(e, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return over_batches(buckets, work, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge.

    Alternates large-star and small-star steps until no edge changes; a node's neighbours are never gathered, only their minimum.
    """
    edges = durable(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    rows = edges.count()
    before = None
    while True:
        both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * rows)
        least = few(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), rows)
        # large-star: each larger neighbour of n meets the smallest of n's neighbourhood
        large = few(few(both.join(least, F.col("a") == F.col("n")).where("b > n").select(F.col("b").alias("n"), "m").where("n <> m"), rows).distinct(), rows)
        # small-star: n and its smaller neighbours meet the smallest of them
        low = few(large.groupBy("n").agg(F.min("m").alias("low")), rows)
        small = few(large.join(low, "n").select(F.when(F.col("m") == F.col("low"), F.col("n")).otherwise(F.col("m")).alias("b"), F.col("low").alias("a")).where("a <> b"), rows).distinct()
        edges = durable(few(small, rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def component_table(prints: DataFrame, radius: int = RADIUS, further=None) -> DataFrame:
    """(fp, root, component_id, n) for every distinct `fp` of `prints` (doc_id, fp): a fingerprint that stands for its component, the smallest doc_id that the component holds, and how many rows have the fingerprint.

    `further`: a function of the first doc_id of each fingerprint (as far as one row has it) that gives more links, as pairs (a, b) of these.
    """
    firsts = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = links(firsts.select("fp"), radius)
    if further is not None:
        alone = prints.join(firsts.where("first is not null").select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("fp").alias("fp")).where("k = 1")
        ids = durable(alone.select("doc_id", "fp"))
        a, b = (ids.select(F.col("doc_id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
        edges = edges.unionByName(further(ids.select("doc_id")).join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    roots = components(edges)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    tied = firsts.join(nodes, F.col("fp") == F.col("node")).select("fp", "first", "root")
    smallest = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    known = tied.join(smallest, "root").select("fp", "root", "component_id")
    return firsts.join(known, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"), "n")


def with_component(prints: DataFrame, table: DataFrame) -> DataFrame:
    """`prints` with root and component_id of each row's fingerprint. Fingerprints that many rows have meet their rows by a broadcast; the others by a join in which no key has many rows."""
    rows = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)  # of fewer than HOT_KEYS fingerprints
    hot = F.broadcast(table.where(often).drop("n"))
    few = prints.join(hot.select("fp"), "fp", "left_anti").join(table.where(~often).drop("n"), "fp")
    return few.unionByName(prints.join(hot, "fp"), allowMissingColumns=False)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = durable(with_fingerprint(docs, ["doc_id"], shingle))
    table = durable(component_table(prints, radius))
    return with_component(prints, table).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, further=None) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns of `docs`.

    Where several rows of a component have that doc_id, or none has a doc_id, one of them stays. `further`: a function of the documents and of ids (of one row each) that links more of them.
    """
    own, back = aside(docs, ("fp", "root", "component_id", "_row"))
    prints = durable(with_fingerprint(own, ["doc_id"], shingle))
    table = durable(component_table(prints, radius, None if further is None else lambda ids: further(own, ids)).drop("n"))
    # rows whose doc_id says which document they are need no text beside their fingerprint
    stay = table.where("component_id is not null").select(F.col("component_id").alias("doc_id")).distinct()
    shared = durable(prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("root")))
    odd = not shared.isEmpty()
    if odd:
        stay = stay.join(shared, F.col("doc_id") == F.col("root"), "left_anti")
    left = own.join(stay, "doc_id", "left_semi")
    if odd:
        rest = with_fingerprint(own.join(shared, F.col("doc_id").eqNullSafe(F.col("root")), "left_semi"), own.columns, shingle).join(table, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        order = Window.partitionBy("root").orderBy(F.xxhash64("text"), *(F.xxhash64(f"`{c}`") for c in own.columns if c not in ("doc_id", "text")))
        left = left.select(*own.columns).unionByName(rest.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*own.columns))
    return named_back(left, back)
