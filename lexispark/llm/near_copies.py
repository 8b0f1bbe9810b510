"""Second step of near-dedup in the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of 64 bits within two bits only tell texts that are all but equal (see the README for figures), so the stage looks at shingles too.

1. Of each document the first share of its shingle hashes that two similar sets can't both keep apart: two sets with similarity s share one of their n - ceil(s n) + 1 first.
   Any order of the hashes will do. Of the lower half of all hashes those of few documents come first, by steps of STEP from COMMON documents on, so common passages bring nobody together who shares
   little else; the upper half, which isn't counted, comes last.
2. A place in that order bounds what two sets can share from there on, so a hash's holder can only be similar to holders of a certain size, its `most`. Holders too large for every
   other group's `most` leave the hash before anything is paired. Hashes of the same holders, as those of a passage, are one.
3. Stars: while all pairs of holders would be many, each hash joins its holders with two of them (the one that can take the largest partner, and one drawn by a hash of doc_id),
   and what proves similar is one group from then on. These rounds only save work.
4. All pairs of holders of a hash that are not in one group yet, as far as both sizes fit both places, and both sketches each other: a sketch has the parity of how many shingles fall on each of its bits,
   so two sets differ in as many shingles at least as their sketches do in bits. At the first hash that two similar sets share all this holds, so every similar pair is met or
   its ends are in one group. It is tested inside the join, which also turns down pairs that met at an earlier hash. The rest is compared exactly, by whole sets.
5. Components of the links; the smallest doc_id of each stays.

Only documents that a candidate names are shuffled for the comparison.

Defined cases: a null doc_id, a null text and a text without words have no copies. Fewer than five words are one shingle. Without ids, or in empty tables, there are no copies. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, few, over_batches
from .simhash_dedup import components
from .substring_dedup import bits_of, in_table, sieve
from .words import Words, chunked, layout, mix, ngrams

SHINGLE, SIMILARITY = 5, 0.8
#: Documents above which a hash comes later, and times as many for each further step; pairs of holders a sign above which a round of stars is worth it, rounds at most, and the share of the links of the round before that a round must find for another one to follow.
COMMON, STEP, MANY, ROUNDS, WORTH = 32, 8, 4, 3, 0.25
#: Words of 64 bits of a sketch; hashes before a place that tell pairs that have met from new ones.
SKETCH, RECENT = 8, 16
PLACE, SKETCHED = ("doc_id", "n", "at", "c"), tuple(f"s{i}" for i in range(SKETCH))


def shingle_sets(column, shingle: int = SHINGLE):
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    data, offs = layout(column)
    for lo, hi in chunked(offs):
        w = Words(data, offs, lo, hi)
        h = w.hashes()
        g = ngrams(h, shingle)
        for i in range(w.n):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= shingle:
                yield np.unique(g[a : b - shingle + 1])
            elif b > a:
                whole = h[a : a + 1]
                for x in h[a + 1 : b]:
                    whole = mix(whole * np.uint64(31) + x)
                yield whole
            else:
                yield h[:0]


def prefix(n: int, similarity: float) -> int:
    """How many of the smallest of n elements are enough to meet any similar set."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def lower(s: np.ndarray) -> int:
    """How many of the sorted hashes are in the lower half of all."""
    return int(np.searchsorted(s, np.uint64(1 << 63)))


def common(docs: DataFrame, table) -> list[np.ndarray]:
    """Bit tables of the hashes, of the lower half of all, that over COMMON of the documents in the bit table hold, over COMMON * STEP, and so on."""

    def work(batches):
        for batch in batches:
            batch = batch.filter(in_table(batch.column("doc_id"), table))
            parts = [s[: lower(s)] for s in shingle_sets(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["hash"])

    counted = durable(over_batches(docs, work, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > COMMON))
    most, least, out = counted.agg(F.max("n")).first()[0] or 0, COMMON, []
    while most > least:
        out.append(sieve(counted.where(F.col("n") > least), "hash"))
        least *= STEP
    return out


def signs(docs: DataFrame, table, later, similarity: float) -> DataFrame:
    """(hash, doc_id, n, at): the first hashes of each document in the bit table with their places, those in more of the bit tables `later` after those in fewer; and how many shingles it has."""

    def work(batches):
        for batch in batches:
            batch = batch.filter(in_table(batch.column("doc_id"), table))
            ids = batch.column("doc_id").to_numpy()
            parts, many, sizes = [], [], []
            for s in shingle_sets(batch.column("text")):
                k = lower(s)
                step = np.full(len(s), 127, dtype=np.int8)
                step[:k] = sum((bits_of(s[:k], t).astype(np.int8) for t in later.value), np.zeros(k, np.int8))
                parts.append(s[np.argsort(step, kind="stable")[: prefix(len(s), similarity)]])
                many.append(len(parts[-1]))
                sizes.append(len(s))
            if parts:
                many = np.array(many)
                at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                columns = np.concatenate(parts).view(np.int64), np.repeat(ids, many), np.repeat(np.array(sizes, np.int32), many), at.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "doc_id", "n", "at"])

    return over_batches(docs, work, "hash long, doc_id long, n int, at int")


def sketches(docs: DataFrame, table) -> DataFrame:
    """(doc_id, s0, s1, ...): parities of the numbers of shingles that fall on each bit, for the documents in the bit table."""

    def work(batches):
        for batch in batches:
            batch = batch.filter(in_table(batch.column("doc_id"), table))
            bits = [np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1 for s in shingle_sets(batch.column("text"))]
            if bits:
                words = np.packbits(np.array(bits, dtype=np.uint8), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["doc_id", *SKETCHED])

    return over_batches(docs, work, "doc_id long, " + ", ".join(f"{c} long" for c in SKETCHED))


def most(similarity: float, n="n", at="at") -> F.Column:
    """Shingles that a similar set can have at most, if it shares nothing before this place: both sizes together times s / (1 + s) must be met by what is left."""
    return F.floor((F.col(n) - F.col(at)) * ((1 + similarity) / similarity) - F.col(n) + 1e-6)


def shared_signs(found: DataFrame, rows: DataFrame) -> DataFrame:
    """`found` (hash, doc_id, n, at) as far as several documents hold the hash, with the group c (the document itself) and the sketch of each. Hashes that the same documents hold are one: the smallest, at the first place of any."""
    # a window deals the rows once; for a join with counts of holders Spark makes all signs twice, as the two uses need different columns
    own = Window.partitionBy("hash")
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).over(own).alias(f"h{i}") for i in range(2)]
    held = found.select("*", F.min("doc_id").over(own).alias("lo"), F.max("doc_id").over(own).alias("hi"), *marks).where("lo < hi")
    # the order of hashes is the same in all documents, so the first place is that of the same hash in each, and no bound gets weaker
    held = durable(held.groupBy("h0", "h1", "doc_id", "n").agg(F.min("hash").alias("hash"), F.min("at").alias("at")).select("hash", "doc_id", "n", "at"))
    table = rows.sparkSession.sparkContext.broadcast(sieve(held, "doc_id"))
    return few(held, held.count()).join(sketches(rows, table), "doc_id").withColumn("c", F.col("doc_id")).select("hash", *PLACE, *SKETCHED)


def grouped(found: DataFrame, edges: DataFrame | None, similarity: float, rows: int) -> DataFrame:
    """`found` (of about `rows` rows) with the group of each document in column c, as far as a holder of another group may be similar."""
    if edges is not None:
        known = components(edges).select(F.col("node").alias("doc_id"), "root")
        found = found.drop("c").join(known, "doc_id", "left").withColumn("c", F.coalesce("root", "doc_id"))
    found = few(found, rows)
    # of each hash the two groups with the largest `most`
    by_group = few(found.groupBy("hash", "c").agg(F.max(most(similarity)).alias("m")), rows)
    best = by_group.withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("m"), "c"))).where("k <= 2")
    best = best.groupBy("hash").agg(F.max(F.when(F.col("k") == 1, F.col("c"))).alias("own"), F.max(F.when(F.col("k") == 1, F.col("m"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("m"))).alias("second")).where("second is not null")
    best = few(best, rows)
    return durable(few(found.join(best, "hash").where(F.when(F.col("c") == F.col("own"), F.col("second")).otherwise(F.col("first")) >= F.col("n")).select("hash", *PLACE, *SKETCHED), rows))


def load(found: DataFrame) -> tuple[int, int]:
    """Rows of `found`, and pairs of them with one hash and two groups."""
    each = found.groupBy("hash", "c").agg(F.count("*").alias("k")).groupBy("hash").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    rows, pairs = each.agg(F.sum("k"), F.sum(F.expr("cast((cast(k as decimal(38,0)) * k - kk) / 2 as decimal(38,0))"))).first()
    return rows or 0, int(pairs or 0)


def fits(similarity: float, a: str, b: str) -> F.Column:
    """Whether two holders of a hash in two groups can be similar, by their sizes, places and sketches. `a`, `b`: prefixes of the columns."""
    differ = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCHED[1:]), F.bit_count(F.col(f"{a}{SKETCHED[0]}").bitwiseXOR(F.col(f"{b}{SKETCHED[0]}"))))
    may = (F.col(f"{a}n") + F.col(f"{b}n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (F.col(f"{a}c") != F.col(f"{b}c")) & (F.col(f"{a}n") <= most(similarity, f"{b}n", f"{b}at")) & (F.col(f"{b}n") <= most(similarity, f"{a}n", f"{a}at")) & (differ <= may)


def stars(found: DataFrame, salt: int, similarity: float, rows: int) -> DataFrame:
    """(a, b), a < b: documents that may be similar, of each hash its holders with two of them. `rows`: how many `found` has."""
    drawn = F.struct(F.xxhash64("doc_id", F.lit(salt)), F.struct(*PLACE, *SKETCHED).alias("e"))
    found = few(found, rows)
    ends = found.groupBy("hash").agg(F.min(drawn).alias("first"), F.max(drawn).alias("last"))
    ends = ends.select("hash", F.explode(F.array_distinct(F.array("first.e", "last.e"))).alias("e")).select("hash", *(F.col(f"e.{c}").alias(f"e_{c}") for c in (*PLACE, *SKETCHED)))
    joined = found.withColumnRenamed("hash", "h").join(ends, (F.col("h") == F.col("hash")) & fits(similarity, "", "e_"))
    return few(joined.select(F.least("doc_id", "e_doc_id").alias("a"), F.greatest("doc_id", "e_doc_id").alias("b")), rows).distinct()


def all_pairs(found: DataFrame, similarity: float, rows: int) -> DataFrame:
    """(a, b), a < b: all documents of two groups that can be similar. Most pairs of holders are turned down inside the join and never come out of it.

    So are pairs that both have met before, as far as the RECENT hashes before show it: at an earlier place of both every bound is wider, and a pair's first hash has none before it.
    """
    earlier = F.collect_list("hash").over(Window.partitionBy("doc_id", "n").orderBy("at").rowsBetween(-RECENT, -1))
    found = durable(few(few(found, rows).withColumn("before", earlier), rows))
    a, b = (found.select("hash", *(F.col(c).alias(f"{x}_{c}") for c in (*PLACE, *SKETCHED, "before"))) for x in "ab")
    new = ~F.arrays_overlap("a_before", "b_before")
    joined = a.withColumnRenamed("hash", "h").join(b, (F.col("h") == F.col("hash")) & (F.col("a_doc_id") < F.col("b_doc_id")) & fits(similarity, "a_", "b_") & new)
    return few(joined.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")), rows).distinct()


def fine_sketch(s: np.ndarray) -> bytes:
    """As a sketch, of a number of bits that grows with the set: the power of 2 that two bits a shingle or more come to, 512 at least."""
    m = 1 << max(9, (2 * len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two fine sketches (bytes) differ; the longer one is folded to the other's length."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _kept_pairs(rows: DataFrame, pairs: DataFrame, of, keeps) -> DataFrame:
    """Those of `pairs` (a, b; read more than once) that `keeps` keeps, by the number of shingles of both and what `of` makes of each shingle set (bytes)."""
    table = rows.sparkSession.sparkContext.broadcast(sieve(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), "a"))

    def made(batches):
        for batch in batches:
            batch = batch.filter(in_table(batch.column("doc_id"), table))
            sets = list(shingle_sets(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([of(s) for s in sets], pa.binary())], ["id", "n", "own"])

    held = over_batches(rows, made, "id long, n int, own binary")
    a, b = (held.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")

    def work(batches):
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "own_a", "own_b")), strict=True):
                keep.append(keeps(n_a, n_b, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return over_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "own_a", "own_b"), work, "a long, b long")


def similar(rows: DataFrame, ids: DataFrame, pairs: DataFrame, similarity: float, count: int) -> DataFrame:
    """Those of `pairs` (a, b; about `count`) of `ids` whose texts are similar. Fine sketches, a small part of the sets, rule out most others; whole sets decide."""
    pairs = durable(few(pairs, count))
    # the bit table lets a few others through
    asked = few(pairs.join(ids.select(F.col("doc_id").alias("a")), "a", "left_semi"), count)
    pairs = durable(few(asked.join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi"), count))

    def may(n_a, n_b, x, y) -> bool:
        return sketches_differ(x, y) <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-6

    def are(n_a, n_b, x, y) -> bool:
        same = len(np.intersect1d(x.view(np.uint64), y.view(np.uint64), assume_unique=True))
        return same >= similarity * (n_a + n_b - same) - 1e-9

    left = durable(few(_kept_pairs(rows, pairs, fine_sketch, may), count))
    return few(_kept_pairs(rows, left, lambda s: s.tobytes(), are), count)


def links(docs: DataFrame, ids: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: pairs of `ids` (column doc_id) whose texts are similar, and that connect all that are."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = broadcast(sieve(ids, "doc_id"))
    placed = durable(shared_signs(signs(rows, table, broadcast(common(rows, table)), similarity), rows))
    found, edges = grouped(placed, None, similarity, placed.count()), None
    before, gain = 0, 1
    for salt in range(ROUNDS + 1):
        held, pairs = load(found)
        if salt == ROUNDS or pairs <= MANY * held or gain < WORTH * before:
            break
        more = durable(similar(rows, ids, stars(found, salt, similarity, held), similarity, held))
        before, gain = gain if salt else 0, more.count()
        edges = more if edges is None else edges.unionByName(more)
        found = grouped(found, edges, similarity, held)
    last = similar(rows, ids, all_pairs(found, similarity, held), similarity, held)
    return last if edges is None else edges.unionByName(last)


def copies_among(docs: DataFrame, ids: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of `ids` (column doc_id, each of one row of `docs`) whose documents are near copies of one with a smaller id among them: all of a group but the smallest."""
    found = components(links(docs, ids, similarity))
    return found.where("node <> root").select(F.col("node").alias("doc_id"))
