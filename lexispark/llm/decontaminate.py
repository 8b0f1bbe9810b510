"""Benchmark decontamination by an FM-index over each training shard.

A shard is a bounded piece of an Arrow batch. Words outside the benchmark's vocabulary, and neighbouring words that are neighbours in no benchmark item,
cannot lie inside a window, so they only cut the shard into segments; a segment shorter than the shortest window is left out. Over the rest an
FM-index is built, all windows are searched backwards at once, their occurrences are located, and overlapping occurrences are merged
into removal spans. This is one narrow stage: documents are never shuffled and each row is judged on its own.

The benchmark is broadcast in parts of at most `part_bytes` of text; its size is measured first. With more than one part the
documents pass once for each part and the spans found so far travel along, cut by a checkpoint in the shared folder.

Defined cases: a null or empty text, or one without words, has no words and no hits. An item with fewer words than the window is one window
of its own length; an item without words is none. Repeated documents are judged each; repeated items count each (by item_id, equal ids
once); all items with a null item_id are one item, whose name is the empty string. Empty tables give empty or clean results. Extra columns pass through `decontaminate`, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, durable, named_back, over_batches
from .fm_index import FMIndex
from .words import WORD, Words, chunked, layout

WINDOW = 10
PART_BYTES = 16 << 20
#: Words of text that one FM-index holds at most (a longer document is a shard of its own).
SHARD_BYTES = 4 << 20


class Benchmark:
    """Windows of the items, over a vocabulary of word hashes: the part that is broadcast."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offs = layout(texts)
        w = Words(data, offs, 0, len(items), WORD) if items else None
        h = w.hashes() if w else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        owners: dict[bytes, set[int]] = {}
        pairs = []
        for i in range(len(items)):
            own = ids[w.first[i] : w.first[i + 1]]
            pairs.append(own[:-1] << 32 | own[1:])
            for j in range(max(1, len(own) - window + 1) if len(own) else 0):
                owners.setdefault(own[j : j + window].tobytes(), set()).add(i)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.names = [str(k) for k, _ in items]
        self.groups: list[tuple[np.ndarray, list[list[int]]]] = []
        by_length: dict[int, list[bytes]] = {}
        for key in owners:
            by_length.setdefault(len(key) // 8, []).append(key)
        for n, keys in sorted(by_length.items()):
            self.groups.append((np.frombuffer(b"".join(keys), np.int64).reshape(-1, n).copy(), [sorted(owners[k]) for k in keys]))
        self.shortest = min(by_length, default=0)
        # a filter of 2**20 bits in front of the binary search
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number (from 1) of each word hash, 0 for the others."""
        out = np.zeros(len(h), dtype=np.int64)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.vocabulary, h[at])
        k[k == len(self.vocabulary)] = 0
        out[at] = np.where(self.vocabulary[k] == h[at], k + 1, 0)
        return out

    def occurrences(self, sym: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """First word, length and items of every occurrence of a window in the words `sym` of texts `row`."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if not self.groups or not len(sym):
            return none
        joined = np.zeros(len(sym), dtype=bool)  # to the next word
        near = np.flatnonzero((sym[:-1] > 0) & (sym[1:] > 0) & (row[:-1] == row[1:]))
        pair = sym[near] << 32 | sym[near + 1]
        k = np.searchsorted(self.pairs, pair)
        k[k == len(self.pairs)] = 0
        joined[near[self.pairs[k] == pair] if len(self.pairs) else near[:0]] = True
        begin = np.flatnonzero((sym > 0) & ~np.append(False, joined[:-1]))
        end = np.flatnonzero((sym > 0) & ~joined) + 1
        long = end - begin >= self.shortest
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return none
        total = size + 1
        to = np.cumsum(total) - total
        text = np.zeros(int(total.sum()), dtype=np.int64)
        origin = np.repeat(begin - to, total) + np.arange(len(text))  # word of each place; a separator's is never asked for
        inner = np.ones(len(text), dtype=bool)
        inner[to + size] = False
        text[inner] = sym[origin[inner]]
        index = FMIndex(text, len(self.vocabulary))
        places, lengths, items = [], [], []
        for patterns, owners in self.groups:
            lo, hi = index.search(patterns)
            hit = np.flatnonzero(lo < hi)
            many = (hi - lo)[hit]
            if not len(hit):
                continue
            rows = np.repeat(lo[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            places.append(origin[index.locate(rows)])
            lengths.append(np.full(len(rows), patterns.shape[1]))
            items.extend(owners[p] for p in np.repeat(hit, many))
        return (np.concatenate(places), np.concatenate(lengths), items) if places else none


def scan(batch: pa.RecordBatch, bench: Benchmark, edit: bool) -> dict[str, list]:
    """Words, merged spans (words and bytes) and items of each row of a batch."""
    data, offs = layout(batch.column("text"))
    out: dict[str, list] = {"n_words": [], "spans": [], "cuts": [], "items": []}
    for a, b in chunked(offs, SHARD_BYTES):
        starts, counts, syms = [], [], []
        for lo, hi in chunked(offs[a : b + 1]):
            w = Words(data, offs, a + lo, a + hi)
            counts.append(np.diff(w.first))
            syms.append(bench.symbols(w.hashes()))
            starts.append(w)
        counts, sym = np.concatenate(counts), np.concatenate(syms)
        first = np.append(0, np.cumsum(counts))
        row = np.repeat(np.arange(b - a), counts)
        place, length, items = bench.occurrences(sym, row)
        spans: list[list] = [[] for _ in range(b - a)]
        found: list[set] = [set() for _ in range(b - a)]
        for j in np.argsort(place, kind="stable"):
            r = int(row[place[j]])
            x, y = int(place[j] - first[r]), int(place[j] - first[r] + length[j])
            found[r].update(bench.names[i] for i in items[j])
            if spans[r] and x <= spans[r][-1][1]:
                spans[r][-1][1] = max(spans[r][-1][1], y)
            else:
                spans[r].append([x, y])
        base = 0
        for w in starts:
            for i in range(w.n):
                r = base + i
                out["n_words"].append(int(counts[r]))
                out["spans"].append([{"start": x, "end": y} for x, y in spans[r]])
                out["items"].append(sorted(found[r]))
                at = w.first[i]
                out["cuts"].append([{"start": int(w.s[at + x] - w.at[i]), "end": int(w.e[at + y - 1] - w.at[i])} for x, y in spans[r]] if edit and spans[r] else [])
            base += w.n
    return out


def cut(text: str | None, cuts: list[dict]) -> str | None:
    """`text` without the byte ranges; blanks around a cut shrink to one, line breaks stay."""
    if not cuts:
        return text
    raw, parts, at = text.encode(), [], 0
    for c in cuts:
        parts.append(raw[at : c["start"]].decode())
        at = c["end"]
    parts.append(raw[at:].decode())
    return " ".join(x for x in (p.strip(" ") for p in parts) if x)


def has_word(text: str) -> bool:
    return re.search(r"\w", text) is not None


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("cuts", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = {"n_words": pa.int64(), "spans": _ARROW_SPAN, "cuts": _ARROW_SPAN, "items": pa.list_(pa.string())}


def merged(old: list[dict], new: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*old, *new], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), edit: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Columns `keep` of `docs` with n_words, spans (word ranges), items; with `edit` also text (whole) and cuts (its byte ranges)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    names = list(dict.fromkeys([*keep, "text"]))
    df = docs.select(*names)
    kept = names if edit or parts > 1 else [c for c in names if c in keep]
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # at most about part_bytes
        bench = spark.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in sorted(rows)], window))
        schema = T.StructType([df.schema[c] for c in kept] + FOUND)
        more = part > 0

        def work(batches, bench=bench, kept=kept, more=more):
            for batch in batches:
                found = scan(batch, bench.value, edit)
                if more:
                    old = {k: batch.column(k).to_pylist() for k in ("spans", "cuts", "items")}
                    for k in ("spans", "cuts"):
                        found[k] = [merged(a or [], b) for a, b in zip(old[k], found[k], strict=True)]
                    found["items"] = [sorted({*(a or []), *b}) for a, b in zip(old["items"], found["items"], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[k], t) for k, t in _ARROW.items())], [*kept, *_ARROW])

        df = over_batches(df, work, schema)
        if parts > 1:
            df = durable(df)
    return df.select(*(c for c in (names if edit else keep)), "n_words", "spans", "items", *(["cuts"] if edit else []))


def sha256_of(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = find_windows(docs, benchmark, window, part_bytes=part_bytes)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256_of("items").alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """`docs` with the merged spans cut out of `text` (and n_chars, where there is one, set anew); a document of which nothing is left goes.

    Documents without a hit stay as they are, null texts too.
    """
    docs, back = aside(docs, ("n_words", "spans", "items", "cuts"))
    found = find_windows(docs, benchmark, window, tuple(c for c in docs.columns if c != "text"), True, part_bytes)
    schema = T.StructType([found.schema[c] for c in docs.columns])

    def work(batches):
        for batch in batches:
            texts, cuts = batch.column("text"), batch.column("cuts")
            if pa.compute.any(pa.compute.greater(pa.compute.list_value_length(cuts), 0)).as_py():
                new = [cut(t, c) if c else t for t, c in zip(texts.to_pylist(), cuts.to_pylist(), strict=True)]
                keep = pa.array([not c or has_word(t) for t, c in zip(new, cuts.to_pylist(), strict=True)], pa.bool_())
                columns = [pa.array(new, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema]
                if "n_chars" in schema.names:
                    i = schema.names.index("n_chars")
                    columns[i] = pa.array([len(t) if c else n for t, c, n in zip(new, cuts.to_pylist(), columns[i].to_pylist(), strict=True)], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(keep)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema], schema.names)

    return named_back(over_batches(found, work, schema), back)
