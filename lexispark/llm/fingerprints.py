"""Document fingerprints: SimHash over weighted word shingles, with permuted block tables for searches within a Hamming radius.

Terms are shingles of one to three neighbouring words (the whole sequence where there are fewer), lower-cased. A term's hash votes on the signed bits
with the term's bytes as weight, once for each occurrence; a bit is 1 if its votes are above zero. A text without words votes with its whole bytes, an empty text has fingerprint 0.
The likeness of two fingerprints is the cosine that their share of differing bits stands for, 0 at the least.

Neighbours in the order of doc_id are met without a global sort: ids that stand in the data cut the order into ranges of about RANGE_BYTES of text, so each range's first
document is known beforehand and is sent to the range before it too. Each range is a partition of its own and is read once in order, a row at a time.

Searches: RADIUS + 1 permutations put another block of the fingerprint first, so two fingerprints within RADIUS bits agree in the first block of one of their tables. Equal fingerprints are one before any bucket is
built, a block has 32 bits, only fingerprints that a bit table of the queries' blocks lets through are dealt, and a pair comes out of the first table in which it agrees only. Documents whose doc_id is divisible by ASKED are the queries, against all documents.

Defined cases: null text counts as empty. Rows of one doc_id are ordered by a hash of their text; null ids come last. One document alone is its own next. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, over_batches
from .substring_dedup import bits_of, sieve
from .words import Words, chunked, layout, mix, ngrams

BITS, SHINGLE = 256, 3
#: Bytes of text in a range, and ranges at most; bits within which a search finds; of which ids it asks.
RANGE_BYTES, RANGES, RADIUS, ASKED = 16 << 20, 10_000, 7, 20
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (2**64 - 1)) for j in range(BITS // 64)]


def simhash(texts: list[str | None]) -> np.ndarray:
    """Fingerprints of texts, a row of BITS // 8 bytes each."""
    data, offs = layout(pa.array([t or "" for t in texts], pa.large_string()))
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    for lo, hi in chunked(offs):
        w = Words(data, offs, lo, hi)
        h, row, size = w.hashes(), w.row(), (w.e - w.s).astype(np.float64)
        terms, rows, weights = [h], [row], [size]
        for k in range(2, SHINGLE + 1):
            g = ngrams(h, k)
            within = np.flatnonzero(row[: len(g)] == row[k - 1 :]) if len(g) else np.zeros(0, np.int64)
            terms.append(g[within] + np.uint64(k))
            rows.append(row[within])
            weights.append(sum(size[within + j] for j in range(k)))
        bare = [i for i in range(hi - lo) if w.first[i] == w.first[i + 1] and offs[lo + i + 1] > offs[lo + i]]
        if bare:
            raw = [data[offs[lo + i] : offs[lo + i + 1]].tobytes() for i in bare]
            terms.append(np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little") for r in raw], dtype=np.uint64))
            rows.append(np.array(bare))
            weights.append(np.ones(len(bare)))
        term, at, weight = np.concatenate(terms), np.concatenate(rows) * 256, np.concatenate(weights)
        votes = []
        for seed in _SEEDS:
            lanes = mix(term ^ seed).view(np.uint8).reshape(-1, 8)
            votes += [np.bincount(at + lanes[:, b], weight, (hi - lo) * 256).reshape(-1, 256) @ _SIGNS for b in range(8)]
        out[lo:hi] = np.packbits(np.concatenate(votes, axis=1) > 0.5, axis=1, bitorder="little")
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints."""
    differing = np.bitwise_count(a ^ b).sum(axis=1)
    return np.where(differing == 0, 1.0, np.maximum(0.0, np.cos(np.pi * differing / BITS)))


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as much of the beginning of `following`."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame) -> list[int]:
    """Ids of `docs` that end the ranges, the largest id last: about as many as the texts' bytes ask for, RANGES at most."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(max(2, size // RANGE_BYTES), RANGES)
    shares = F.array(*(F.lit((i + 1) / n) for i in range(n)))
    row = docs.agg(F.percentile_approx("doc_id", shares, F.lit(50 * n)).alias("at"), F.max("doc_id").alias("top")).first()
    return sorted({*(row["at"] or []), row["top"]} - {None}) or [0]


def _keys(n: int) -> np.ndarray:
    """Numbers that Spark's hash partitioning deals to n partitions one by one: the first number of each."""
    out, first, size = np.full(n, -1, dtype=np.int64), 0, 16 * n
    while (out < 0).any():
        x = np.arange(first, first + size, dtype=np.uint32)
        # Murmur3 of a 32-bit number with seed 42, as Spark has it
        k = x * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        h ^= h >> np.uint32(16)
        place, at = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
        new = out[place] < 0
        out[place[new]] = x[at[new]]
        first += size
    return out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = _ranges(docs)
    keys = _keys(len(ends))

    def deal(batches):
        bounds, press = np.array(ends, dtype=np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            known = ids.fill_null(ends[0]).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, known)
            packed = [press.compress((t or "").encode()) for t in texts]
            order = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=7).digest(), "little") for t in texts]
            # the first documents of a range follow the last of the range before it
            ahead = np.flatnonzero((bounds[part] == known) & ids.is_valid().to_numpy(zero_copy_only=False))
            take = pa.array(np.append(np.arange(len(ids)), ahead))
            where = keys[np.append(part, (part[ahead] + 1) % len(bounds))].astype(np.int32)
            late = pa.array(np.append(np.zeros(len(ids), bool), np.ones(len(ahead), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(where), late, ids.take(take), pa.array(order, pa.int64()).take(take), pa.array(packed, pa.binary()).take(take)], ["part", "late", "doc_id", "tie", "packed"])

    def read(batches):
        unpack = zstandard.ZstdDecompressor()
        held = None  # the last row, whose next is still to come: part, id, text, fingerprint
        for batch in batches:
            part, late, ids = (batch.column(c).to_pylist() for c in ("part", "late", "doc_id"))
            texts = [unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()]
            prints = simhash(texts)
            rows = list(zip(part, ids, texts, prints, late, strict=True))
            done = []  # id, text, its fingerprint, edited text, the next one's fingerprint
            for row in rows:
                if held is not None:
                    if held[0] == row[0]:
                        done.append((held[1], held[2], held[3], edited(held[2], row[2]), row[3]))
                held = None if row[4] else row
            if not done:
                continue
            ids, texts, own, new, following = zip(*done, strict=True)
            own, following, changed = np.stack(own), np.stack(following), simhash(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array([f.tobytes().hex() for f in own], pa.string()),
                    pa.array([f.tobytes().hex() for f in changed], pa.string()),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, following)),
                ],
                [f.split()[0] for f in OUT.split(", ")],
            )

    dealt = over_batches(docs, deal, "part int, late boolean, doc_id long, tie long, packed binary")
    ordered = dealt.repartition(len(ends), "part").sortWithinPartitions("part", "late", F.col("doc_id").desc_nulls_last(), "tie")
    return over_batches(ordered.drop("tie"), read, OUT)


def _blocks(fp: str, radius: int) -> list[F.Column]:
    """The hex digits of each of radius + 1 blocks."""
    n, digits = radius + 1, BITS // 4
    cuts = [round(i * digits / n) for i in range(n + 1)]
    return [F.substring(fp, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (table, block, fp): each of radius + 1 permutations puts another block of the fingerprint first; close fingerprints agree in one of them."""
    blocks = F.array(*(F.struct(F.lit(i).alias("table"), b.alias("block")) for i, b in enumerate(_blocks("fp", radius))))
    return prints.select("fp", F.explode(blocks).alias("b")).select("b.table", "b.block", "fp")


def differing_bits(a, b) -> F.Column:
    """Hamming distance of two fingerprint columns of hex digits."""
    words = [F.bit_count(F.conv(F.substring(a, i, 15), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 15), 16, 10).cast("long"))) for i in range(1, BITS // 4 + 1, 15)]
    return sum(words[1:], words[0])


def meeting(fingerprinted: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """Column `fingerprint` of the rows that may agree in a block with one of `queries`, found by a bit table of their blocks: all that do, and few others."""

    def numbers(column) -> list[np.ndarray]:
        prints = pa.array(column, pa.string()).to_pylist()
        n, digits = radius + 1, BITS // 4
        cuts = [round(i * digits / n) for i in range(n + 1)]
        # the table's number is part of what is hashed
        return [mix(np.array([int(p[a:b], 16) & (2**64 - 1) for p in prints], dtype=np.uint64) ^ np.uint64(i + 1 << 56)).view(np.int64) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def blocks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers(batch.column(0))))], ["block"])

    table = fingerprinted.sparkSession.sparkContext.broadcast(sieve(over_batches(queries.select("fingerprint"), blocks, "block long"), "block"))

    def met(batches):
        for batch in batches:
            hit = [bits_of(x, table.value) for x in numbers(batch.column(0))]
            yield batch.filter(pa.array(np.logical_or.reduce(hit)))

    return over_batches(fingerprinted.select("fingerprint"), met, "fingerprint string")


def search(fingerprinted: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, near_fp, differing) for each distinct fingerprint of `queries` and each distinct one of `fingerprinted` within `radius` bits, itself included.

    Documents of equal fingerprints are one row here; column `fingerprint` ties them to their documents. A wide radius has short blocks, and so many pairs to look at.
    """
    pool = fingerprinted.select(F.col("fingerprint").alias("fp")).distinct()
    asked = queries.select(F.col("fingerprint").alias("fp")).distinct()
    left = block_tables(asked, radius)
    right = block_tables(pool, radius).select(F.col("table").alias("t"), F.col("block").alias("b"), F.col("fp").alias("near_fp"))
    first = F.coalesce(*(F.when(x == y, F.lit(i)) for i, (x, y) in enumerate(zip(_blocks("fp", radius), _blocks("near_fp", radius), strict=True))))
    differing = differing_bits("fp", "near_fp")
    pairs = left.join(right, (F.col("table") == F.col("t")) & (F.col("block") == F.col("b")) & (first == F.col("table")) & (differing <= radius))
    return pairs.select("fp", "near_fp", differing.alias("differing"))


def with_neighbours(prints: DataFrame, radius: int = RADIUS, asked: int = ASKED) -> DataFrame:
    """`prints` (doc_id, fingerprint and more; read more than once) with n_near: of documents whose doc_id is divisible by `asked`, how many documents have a fingerprint within `radius` bits, the document itself included; null for others."""
    of = F.coalesce(F.col("doc_id") % asked == 0, F.lit(False))
    pool = durable(meeting(prints, prints.where(of), radius))
    counts = pool.groupBy(F.col("fingerprint").alias("near_fp")).agg(F.count("*").alias("n"))
    near = search(pool, prints.where(of), radius).join(counts, "near_fp").groupBy("fp").agg(F.sum("n").alias("n_near"))
    found = prints.where(of).join(near, F.col("fingerprint") == F.col("fp"), "left").select(*prints.columns, "n_near")
    return found.unionByName(prints.where(~of).withColumn("n_near", F.lit(None).cast("long")))


def fingerprints_and_neighbours(docs: DataFrame) -> DataFrame:
    """As `fingerprint_documents`, with n_near of the queries' documents."""
    return with_neighbours(durable(fingerprint_documents(docs)))
