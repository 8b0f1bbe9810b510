"""Packing of token sequences: best-fit decreasing over counts of lengths.

Best-fit decreasing looks only at lengths, so the plan is made for the histogram of piece lengths (at most `capacity` numbers), not for the
pieces: a segment tree indexed by remaining capacity finds the tightest open window, and all pieces of one length that fit windows of one
remaining capacity are placed in one step. The plan is a list of runs: pieces rank..rank+n of a length stand at one offset of windows id..id+n. The
executors then number the pieces of each length and look their run up. The plan is that of a single pass over all pieces, while the driver
holds only counts and runs, whose number depends on `capacity` and not on the corpus.

Overlong documents are first cut into full windows; only what is left over is packed.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows are documents of their own. Ties
between pieces of one length go by doc_id, start and checksum. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, kept, over_batches

CAPACITY, END, SALTS = 2048, 1, 32
#: Pre-tokens of one generation of a Python worker's cache; two are kept, at about 200 bytes each.
CACHE = 250_000


class Encoder:
    """ids of a public tokenizer file, by a cache of pre-tokens.

    In texts of plain Latin letters a pre-token's ids don't depend on its neighbours, so each distinct one is encoded once for as long as it stays in the cache;
    any other text goes to the tokenizer as it is.
    """

    PLAIN = re.compile("[^\\t\\n\\r -~\\u00a1-\\u00a8\\u00ab\\u00ac\\u00ae-\\u00b1\\u00b4\\u00b6-\\u00b8\\u00bb\\u00bf-\\u012f\\u0132-\\u013e\\u0141-\\u0148\\u014a-\\u017e]|<\\|")
    SPLIT = re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cache, self.old = Tokenizer.from_file(path), {}, {}

    def __call__(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit numbers."""
        if self.PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.SPLIT.findall(text.lower())
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            self.learn(set(words).difference(self.cache))
            return b"".join(map(self.cache.__getitem__, words))

    def learn(self, new: set[str]) -> None:
        """Put words into the cache: from the generation before, else from the tokenizer. The caller's other words must be in it already."""
        known = {w: self.old[w] for w in new if w in self.old}
        fresh = list(new.difference(known)) if known else list(new)
        self.cache |= known
        if not fresh:
            return
        joined = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        first = np.flatnonzero(np.diff(joined.word_ids, prepend=-1))
        if len(first) == len(fresh):  # none of them was split further
            raw, cuts = np.array(joined.ids, "<u4").tobytes(), [*(4 * first).tolist(), 4 * len(joined.ids)]
            self.cache.update(zip(fresh, (raw[a:b] for a, b in zip(cuts, cuts[1:])), strict=True))
        else:
            for w, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                self.cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
PIECE_IDS = PIECE + ", ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: full windows, then the rest. `tokenizer`: name of a public vocabulary file."""

    def work(batches):
        encode, tail = kept(tokenizer, lambda: Encoder(tokenizer_path(tokenizer))), struct.pack("<I", end)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = memoryview(encode(text or "") + tail)
                n = len(raw) // 4
                for a in range(0, n, capacity):
                    part = raw[4 * a : 4 * (a + capacity)]
                    rows.append((doc_id, a, len(part) // 4, zlib.crc32(part), n, *([bytes(part)] if with_ids else [])))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, PIECE_IDS if with_ids else PIECE, tokenizer)


class OpenWindows:
    """Segment tree over remaining capacities: how many windows have each, and the tightest that takes a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        """Smallest remaining capacity >= length of an open window, -1 if there is none."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank, n, window, offset): pieces rank..rank+n-1 of that length stand at `offset` of windows window..window+n-1."""
    tree, held = OpenWindows(capacity), {}  # held: runs (window, n) of each remaining capacity
    runs, windows = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                # each new window takes as many of this length as fit it before the next is opened
                each = capacity // length
                full, last = divmod(left, each)
                for n, take in ((full, each), (1, last)):
                    if n and take:
                        for j in range(take):
                            runs.append((length, rank, n, windows, j * length))
                            rank += n
                        if capacity - take * length:
                            held.setdefault(capacity - take * length, []).append((windows, n))
                            tree.add(capacity - take * length, n)
                        windows += n
                left = 0
            else:
                window, n = held[room].pop()
                take = min(n, left)
                if n > take:
                    held[room].append((window + take, n - take))
                tree.add(room, -take)
                runs.append((length, rank, take, window, capacity - room))
                if room > length:
                    held.setdefault(room - length, []).append((window, take))
                    tree.add(room - length, take)
                rank += take
                left -= take
    return runs


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit)."""
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.when(F.col("length") == capacity, F.lit(SALTS * 64)).otherwise(F.lit(SALTS))).cast("int")
    parts = durable(pieces(docs, tokenizer, capacity, end, with_ids).withColumn("salt", salt))
    counts = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = durable(counts.select("length", "salt", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")))
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(best_fit_decreasing(totals, capacity))
    plan = parts.sparkSession.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    # `before` has at most `capacity` * SALTS rows, and as many again for full windows
    ranked = parts.withColumn("place", place).join(F.broadcast(before.select("length", "salt", "before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), (F.col("before") + F.col("place") - 1).alias("rank"))
    names = [c for c in ranked.columns if c != "rank"]

    def work(batches):
        runs = plan.value
        key = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            window, offset = runs[at, 3] + rank - runs[at, 1], runs[at, 4]
            columns = {c: batch.column(c) for c in names} | {"length": pa.array(length), "sequence_id": pa.array(window), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = PIECE.replace("length int", "length long") + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return over_batches(ranked, work, schema)
