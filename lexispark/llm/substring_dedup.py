"""Substring dedup by collinear chaining: fuzzy passages that repeat across documents.

1. Seeds: winnowed five-word shingles; every run of WINDOW + 4 words that two documents share gives both a common seed.
2. A seed is joined with its first place (smallest doc_id, then position), never with all its other places, so a passage shared by n documents gives n - 1 matches.
   Seeds are dealt by hash once, for both. Those that a thousandth of a sample of the documents holds or more are not dealt at all: there are few of them, so their firsts, summed before the shuffle, are
   sent to their rows. The sample decides on the way only, not on what is found. A passage made of pieces that several earlier documents hold is matched with those; where
   matches go over from one to another, the seeds to either side are one more seed with a first place of its own, which finds a holder of the whole.
3. The matches of a document with one earlier document are merged into diagonal fragments; a Fenwick tree over the earlier document's positions
   finds each fragment's best predecessor under gap costs; the best chains are taken one by one.
4. Chains are aligned word by word with the earlier document's passage. Where one word in five or fewer differs over `min_words` words or more,
   the segment is a repeated passage. The first holder keeps it; later ones report or lose it.

Only documents that some chain names are shuffled for the alignment; a bit table sized by their number (2**SIEVE bits at most) tells them from the rest, and
passes more than needed when it fills, never fewer.

Defined cases: null texts and texts of fewer than `min_words` words have no passage. A null doc_id is never linked and its row stays as it is. Rows of one
doc_id count as one document for the search (no passage repeats between them) and are aligned each on its own. Repeats inside a single document
are left alone. Empty tables give empty or unchanged results. Extra columns pass through `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, durable, named_back, over_batches
from .decontaminate import cut, has_word
from .words import Words, chunked, layout, mix, ngrams

K, WINDOW, MIN_WORDS, SIMILARITY = 5, 5, 45, 0.8
#: Words beyond a chain's ends that the alignment looks at; the furthest that seeds of an unbroken match can be apart, so that a fragment holds no edit; cost of a skipped word in a chain.
REACH, SKIP, GAP = 64, WINDOW, 0.125
#: Bits of the largest bit table, as a power of 2 (16 MB).
SIEVE = 27
#: Share of the documents that is looked at for frequent seeds; occurrences there that make a seed frequent: so many, and one for so many documents.
LOOKED_AT, OFTEN, ONE_OF = 64, 50, 1_000
_POS = 28


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW, often=None, inside: bool = False) -> DataFrame:
    """(hash, doc_id, pos): winnowed shingles of k words; with `often` (a broadcast of sorted hashes) only those that are not among them, or with `inside` only those that are."""

    def work(batches):
        for batch in batches:
            data, offs = layout(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in chunked(offs):
                w = Words(data, offs, lo, hi)
                g = ngrams(w.hashes(), k)
                row = w.row()
                n = len(g) - window + 1
                if n <= 0:
                    continue
                best, at = g[:n].copy(), np.arange(n)
                for j in range(1, window):
                    less = g[j : n + j] <= best  # the last of equal ones
                    np.copyto(best, g[j : n + j], where=less)
                    at[less] = np.flatnonzero(less) + j
                at = np.unique(at[row[:n] == row[k + window - 2 :]])
                if often is not None:
                    h = g[at].view(np.int64)
                    place = np.minimum(np.searchsorted(often.value, h), len(often.value) - 1)
                    at = at[(often.value[place] == h) == inside]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[lo + row[at]]), pa.array((at - w.first[row[at]]).astype(np.int32))], ["hash", "doc_id", "pos"])

    # no column is nullable: else the planner puts other filters before the two uses of one exchange, which then becomes two
    schema = T.StructType([T.StructField("hash", T.LongType(), False), T.StructField("doc_id", T.LongType(), False), T.StructField("pos", T.IntegerType(), False)])
    return over_batches(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the seeds that a sample of the documents holds often: ONE_OF times as many as a document has seeds, at most."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOKED_AT)) == 0)
    limit = max(OFTEN, some.count() // ONE_OF)
    return np.sort(seeds(some).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("hash").toArrow().column("hash").to_numpy())


def direct_places(docs: DataFrame, packed: bool) -> DataFrame:
    """`first_places` of all seeds."""
    hashes = frequent(docs)
    if not len(hashes):
        return first_places(seeds(docs).repartition("hash"), packed, "hash")
    often = docs.sparkSession.sparkContext.broadcast(hashes)
    return first_places(seeds(docs, often=often).repartition("hash"), packed, "hash").unionByName(first_places(durable(seeds(docs, often=often, inside=True)), packed, "hash", few=True))


def first_places(found: DataFrame, packed: bool, *more: str, few: bool = False) -> DataFrame:
    """(d, x, r, y, more): each row of `found` (hash, doc_id, pos, more) of document d with the first place of its hash, if an earlier document r holds that. `few`: of few hashes."""
    if packed:
        place = F.shiftleft("doc_id", _POS).bitwiseOR(F.col("pos").cast("long"))
        r, y = F.shiftright("first", _POS), F.col("first").bitwiseAND(F.lit((1 << _POS) - 1)).cast("int")
    else:
        place, r, y = F.struct("doc_id", "pos"), F.col("first.doc_id"), F.col("first.pos")
    firsts = found.groupBy("hash").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).select("hash", "last", r.alias("r"), y.alias("y")).where("last > r")
    firsts = firsts.drop("last")
    return found.join(F.broadcast(firsts) if few else firsts, "hash").where("doc_id > r").select(F.col("doc_id").alias("d"), F.col("pos").alias("x"), "r", "y", *more)


def by_document(found: DataFrame, names: list[str], of, schema: str) -> DataFrame:
    """`of` (a function that gives record batches) over the columns `names`, the first of which is d, as rows of one array, whole documents at a time."""

    def work(batches):
        held = np.zeros((len(names), 0), dtype=np.int64)
        for batch in batches:
            m = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
            if not m.shape[1]:
                continue
            cut = int(np.searchsorted(m[0], m[0, -1]))
            held = m[:, cut:]
            if cut:
                yield of(m[:, :cut])
        if held.shape[1]:
            yield of(held)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return over_batches(found.select(*names).repartition(n, "d").sortWithinPartitions("d"), work, schema)


def edges_of(m: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The run that each row (d, x, r, y; ordered by d and x) belongs to, and the seams: rows i in runs that can be a passage, where row i + 1 goes over to another place than row i.

    Equal seeds in a row (one word over and over) have one first place and are no seam.
    """
    d, x, r, y = m[:4]
    same = (d[1:] == d[:-1]) & (x[1:] - x[:-1] <= 2 * WINDOW)
    run = np.cumsum(np.append(True, ~same)) - 1
    begin = np.flatnonzero(np.append(True, ~same))
    end = np.append(begin[1:], len(d)) - 1
    long = (x[end] - x[begin] + k + 2 * (WINDOW + k - 1) >= min_words)[run]
    return run, np.flatnonzero(same & long[1:] & ((r[1:] != r[:-1]) | (y[1:] != y[:-1]) & (x[1:] - y[1:] != x[:-1] - y[:-1])))


def seams(found: DataFrame, min_words: int, k: int = K) -> DataFrame:
    """(hash, doc_id, pos, step): hashes of one, two and three matched seeds to either side of each seam, by the place of the last seed before it and the steps to the next.

    A passage made of pieces that several earlier documents hold has its seeds matched with those. Its true holder goes over between the same pieces at the same seeds.
    """

    def of(m: np.ndarray) -> pa.RecordBatch:
        m = m[:, np.lexsort((m[1], m[0]))]
        d, x, h = m[0], m[1], m[4].view(np.uint64)
        run, seam = edges_of(m, min_words, k)
        out = []
        for side in (1, 2, 3):
            at = seam[seam >= side - 1]
            at = at[at + side < len(d)]
            at = at[run[at - side + 1] == run[at + side]] if len(at) else at
            key = np.full(len(at), side, dtype=np.uint64)
            for j in range(1 - side, side + 1):
                key = mix(key * np.uint64(31) + h[at + j] + (x[at + j] - x[at]).view(np.uint64))
            out.append((key.view(np.int64), d[at], x[at], x[at + 1] - x[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *(pa.array(c.astype(np.int32)) for c in columns[2:])], ["hash", "doc_id", "pos", "step"])

    return by_document(found, ["d", "x", "r", "y", "hash"], of, "hash long, doc_id long, pos int, step int")


def matches(docs: DataFrame, packed: bool, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, x, r, y): each seed of document d with its first place in an earlier document r, and the seeds about each seam with the first place of their context."""
    direct = direct_places(docs, packed)
    context = first_places(seams(direct, min_words), packed, "step")
    both = F.explode(F.array(*(F.struct("d", (F.col("x") + s).alias("x"), "r", (F.col("y") + s).alias("y")) for s in (F.lit(0), F.col("step")))))
    return direct.select("d", "x", "r", "y").unionByName(context.select(both.alias("m")).select("m.*"))


class Fenwick:
    """Prefix maxima of (priority, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Largest value at places below i."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chain(fragments: list[tuple[int, int, int, int]], k: int = K, gap: float = GAP) -> list[list[int]]:
    """Disjoint chains of fragments (x1, x2, y1, seeds; seed starts on one diagonal), best first, each in order.

    A fragment may follow another if it begins after the other's last seed in both documents; a chain scores its words less `gap` for each word that
    is skipped in either document.
    """
    n = len(fragments)
    if n == 1:
        return [[0]]
    last_y = [f[2] + f[1] - f[0] for f in fragments]
    ranks = {y: i for i, y in enumerate(sorted({*last_y, *(f[2] for f in fragments)}))}
    tree, score, before = Fenwick(len(ranks)), [0.0] * n, [-1] * n
    starts = sorted(range(n), key=lambda i: fragments[i][0])
    ends = sorted(range(n), key=lambda i: fragments[i][1])
    e = 0
    for i in starts:
        x1, x2, y1, _ = fragments[i]
        while e < n and fragments[ends[e]][1] < x1:
            j = ends[e]
            tree.put(ranks[last_y[j]], (score[j] + gap * (fragments[j][1] + last_y[j]), j))
            e += 1
        best, j = tree.top(ranks[y1])
        best -= gap * (x1 + y1 - 2 * k)
        score[i] = x2 - x1 + k
        if j >= 0 and best > 0:
            score[i] += best
            before[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def chains(found: DataFrame, min_words: int, k: int = K) -> DataFrame:
    """(d, r, y_lo, y_hi, frags): chains of two seeds or more; frags holds x1, x2, y1 of each fragment in turn."""

    def of(m: np.ndarray):
        """Chains of whole documents; rows d, x, r, y. A lone seed between two seams counts for two: it may be all that is matched with the holder of its whole run."""
        m = m[:, np.lexsort((m[1], m[0]))]
        _, seam = edges_of(m, min_words, k)
        weight = np.ones(m.shape[1], dtype=np.int64)
        weight[np.intersect1d(seam, seam + 1)] = 2
        order = np.lexsort((m[1], m[1] - m[3], m[2], m[0]))
        (d, x, r, y), weight = m[:, order], weight[order]
        diagonal = x - y
        pair = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]))
        new = pair | np.append(True, (diagonal[1:] != diagonal[:-1]) | (x[1:] - x[:-1] > SKIP))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(d)) - 1
        fx1, fx2, fy1, count = x[begin], x[end], y[begin], np.add.reduceat(weight, begin)
        group = np.cumsum(pair)[begin]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        last = np.append(first[1:], len(group))
        # a pair of documents with one seed in all has no passage
        for g in np.flatnonzero(np.add.reduceat(count, first) > 1):
            a, b = int(first[g]), int(last[g])
            frags = list(zip(fx1[a:b].tolist(), fx2[a:b].tolist(), fy1[a:b].tolist(), count[a:b].tolist(), strict=True))
            for own in chain(frags, k):
                if sum(frags[i][3] for i in own) < 2:
                    continue
                x1, x2 = frags[own[0]][0], frags[own[-1]][1]
                y_hi = frags[own[-1]][2] + x2 - frags[own[-1]][0] + k
                yield int(d[begin[a]]), int(r[begin[a]]), frags[own[0]][2], y_hi, [v for i in own for v in frags[i][:3]]

    names = ["d", "r", "y_lo", "y_hi", "frags"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]

    def batch_of(m: np.ndarray) -> pa.RecordBatch:
        rows = list(of(m))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)

    return by_document(found, ["d", "x", "r", "y"], batch_of, "d long, r long, y_lo int, y_hi int, frags array<int>")


def _bit(ids: np.ndarray, power: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - power)).astype(np.int64)


def sieve(ids: DataFrame, column: str) -> np.ndarray:
    """Bit table of the ids (read twice), of about 16 places an id, from 2**16 to 2**SIEVE of them: at most 2**SIEVE / 64 rows come to the driver. Beyond that it fills and lets more others through."""
    ids = ids.select(column)
    power = min(SIEVE, max(16, (16 * ids.count()).bit_length()))

    def work(batches):
        for batch in batches:
            bit = np.unique(_bit(batch.column(0).to_numpy(), power))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> 6).astype(np.int32)), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    rows = over_batches(ids, work, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def bits_of(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each id is in the bit table."""
    bit = _bit(ids, (64 * len(table) - 1).bit_length())
    return ((table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def in_table(ids, table) -> pa.Array:
    """Whether each id is in the bit table (a broadcast); null ids are not."""
    hit = bits_of(pa.compute.cast(ids, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), table.value)
    return pa.array(hit & ids.is_valid().to_numpy(zero_copy_only=False))


def sifted(docs: DataFrame, table, inside: bool) -> DataFrame:
    """The rows of `docs` whose doc_id is in the bit table (a broadcast), or those that are not; null ids are not."""

    def work(batches):
        for batch in batches:
            hit = in_table(batch.column("doc_id"), table)
            yield batch.filter(hit if inside else pa.compute.invert(hit))

    return over_batches(docs, work, docs.schema)


def word_hashes(docs: DataFrame, table) -> DataFrame:
    """(r, words): 32-bit hashes of all words of the documents in the bit table."""

    def work(batches):
        for batch in batches:
            batch = batch.filter(in_table(batch.column("doc_id"), table))
            data, offs = layout(batch.column("text"))
            out = []
            for lo, hi in chunked(offs):
                w = Words(data, offs, lo, hi)
                h = w.hashes().astype(np.uint32)
                out += [h[w.first[i] : w.first[i + 1]].tobytes() for i in range(w.n)]
            yield pa.RecordBatch.from_arrays([pa.compute.cast(batch.column("doc_id"), pa.int64()), pa.array(out, pa.binary())], ["r", "words"])

    return over_batches(docs.select("doc_id", "text"), work, "r long, words binary")


def columns_of(a: np.ndarray, b: np.ndarray, frags: list[int], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignment columns (place in a, place in b, equal) along a chain, REACH words beyond both ends."""
    n, m = len(a), len(b)
    xs, ys, eq = [], [], []

    def run(x: int, y: int, size: int) -> None:
        xs.append(np.arange(x, x + size))
        ys.append(np.arange(y, y + size))
        eq.append(a[x : x + size] == b[y : y + size])

    x, y = frags[0], frags[2]
    back = min(REACH, x, y)
    x, y = x - back, y - back
    for i in range(0, len(frags), 3):
        x1, x2, y1 = frags[i : i + 3]
        dx, dy = x1 - x, y1 - y
        if i and (dx < 0 or dy < 0):  # seeds overlap: the later one gives way
            late = max(-dx, -dy)
            x1, y1, dx, dy = x1 + late, y1 + late, dx + late, dy + late
        if dx == dy:
            run(x, y, dx)
        elif i:
            # the shorter gap is filled from both sides, the rest of the longer one is unmatched
            size = min(dx, dy)
            head = a[x : x + size] == b[y : y + size]
            tail = a[x1 - size : x1] == b[y1 - size : y1]
            # number of words to take from the left: the most matches
            left = int(np.argmax(np.append(0, np.cumsum(head)) + np.append(np.cumsum(tail[::-1])[::-1], 0)))
            run(x, y, left)
            extra = max(dx, dy) - size
            xs.append(np.arange(x + left, x + left + extra) if dx > dy else np.full(extra, x + left))
            ys.append(np.arange(y + left, y + left + extra) if dy > dx else np.full(extra, y + left))
            eq.append(np.zeros(extra, dtype=bool))
            run(x1 - (size - left), y1 - (size - left), size - left)
        stop = max(x1, min(x2 + k, n, m - (y1 - x1)))
        run(x1, y1, stop - x1)
        x, y = stop, y1 + stop - x1
    more = min(REACH, n - x, m - y)
    run(x, y, max(0, more))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(eq)


def segments(equal: np.ndarray, similarity: float = SIMILARITY, min_words: int = 1, place: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Disjoint stretches of `min_words` places or more in which at least `similarity` of the columns are equal; each begins and ends with an equal column.

    Of all such stretches the one of the best score comes first (an equal column counts 1, another what makes `similarity` score 0), then those beside it.
    `place`: the place of each column in the document, ascending; its own number by default.
    """
    place = np.arange(len(equal)) if place is None else place
    total = np.append(0.0, np.cumsum(np.where(equal, 1.0, -similarity / (1 - similarity))))
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        start = np.where(equal[lo:hi], total[lo:hi], np.inf)
        least = np.minimum.accumulate(start)
        # the last column that each stretch can begin with
        late = np.searchsorted(place[lo:hi], place[lo:hi] + 1 - min_words, side="right") - 1
        score = np.where(equal[lo:hi] & (late >= 0), total[lo + 1 : hi + 1] - least[np.maximum(late, 0)], -np.inf)
        end = int(np.argmax(score))
        if not score[end] >= -1e-9:
            continue
        begin = int(np.flatnonzero(start[: late[end] + 1] == least[late[end]])[-1])
        out.append((lo + begin, lo + end + 1))
        todo += [(lo, lo + begin), (lo + end + 1, hi)]
    return sorted(out)


PASSAGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("source_doc_id", T.LongType()), T.StructField("source_start", T.LongType()), T.StructField("source_end", T.LongType()), T.StructField("similarity", T.DoubleType())])


def aligned(own: np.ndarray, hits: list[dict], min_words: int, similarity: float, k: int = K) -> list[dict]:
    """Passages of a document (32-bit word hashes) that its chains hold."""
    out = []
    for c in hits:
        b = np.frombuffer(c["slice"], dtype=np.uint32)
        frags = list(c["frags"])
        frags[2::3] = [y - c["base"] for y in frags[2::3]]
        if frags[-2] + k > len(own) or not len(b):  # a row of the same doc_id with another text
            continue
        x, y, equal = columns_of(own, b, frags, k)
        for lo, hi in segments(equal, similarity, min_words, x):
            start, end = int(x[lo]), int(x[hi - 1]) + 1
            out.append({"start": start, "end": end, "source_doc_id": c["r"], "source_start": int(y[lo]) + c["base"], "source_end": int(y[hi - 1]) + 1 + c["base"], "similarity": float(equal[lo:hi].mean())})
    return sorted(out, key=lambda p: (p["start"], -p["end"], p["source_doc_id"]))


def told(passages: list[dict], k: int = K) -> list[dict]:
    """Those of a document's passages that say something new: of one stretch the earliest holder's, and a later one's where it covers k words or more that no earlier one does."""
    out: list[dict] = []
    for p in sorted(passages, key=lambda p: (p["source_doc_id"], p["start"], -p["end"])):
        new, at = 0, p["start"]
        for q in sorted((q for q in out if q["end"] > p["start"] and q["start"] < p["end"]), key=lambda q: q["start"]):
            new += max(0, q["start"] - at)
            at = max(at, q["end"])
        if new + max(0, p["end"] - at) >= k:
            out.append(p)
    return sorted(out, key=lambda p: (p["start"], -p["end"], p["source_doc_id"]))


def _with_hits(docs: DataFrame, min_words: int):
    """`docs` that some chain names, with the chains and the earlier documents' words in column _hits; and the bit table of the ids in it."""
    spark = docs.sparkSession
    ids = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    packed = ids[0] is None or 0 <= ids[0] <= ids[1] < 1 << (62 - _POS)
    found = durable(chains(matches(docs, packed, min_words), min_words))
    late, early = (spark.sparkContext.broadcast(sieve(found, c)) for c in ("d", "r"))
    base = F.greatest(F.lit(0), F.col("y_lo") - REACH)
    words = word_hashes(docs, early)
    slices = found.join(words, "r").select("d", "r", base.alias("base"), "frags", F.substring("words", 4 * base + 1, 4 * (F.col("y_hi") + REACH - base)).alias("slice"))
    hits = slices.groupBy("d").agg(F.collect_list(F.struct("r", "base", "frags", "slice")).alias("_hits"))
    return sifted(docs, late, True).join(hits, F.col("doc_id") == F.col("d"), "left").drop("d"), late


def passages_of(batch: pa.RecordBatch, min_words: int, similarity: float, edit: bool):
    """Of each row: its passages, and with `edit` the byte ranges that they cover."""
    data, offs = layout(batch.column("text"))
    hits = batch.column("_hits")
    out, cuts = [[]] * len(hits), [[]] * len(hits)
    for i in range(len(hits)):
        if not hits[i].is_valid:
            continue
        w = Words(data, offs, i, i + 1)
        out[i] = aligned(w.hashes().astype(np.uint32), hits[i].as_py(), min_words, similarity)
        if edit:
            spans: list[list[int]] = []
            for p in out[i]:
                if spans and p["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], p["end"])
                else:
                    spans.append([p["start"], p["end"]])
            cuts[i] = [{"start": int(w.s[a] - 1), "end": int(w.e[b - 1] - 1)} for a, b in spans]
    return out, cuts


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each passage of `doc_id` that an earlier document holds: doc_id, start, end (words), source_doc_id, source_start, source_end, similarity. Several holders: see `told`."""
    named, _ = _with_hits(docs.select("doc_id", "text"), min_words)
    arrow = pa.struct([pa.field(f.name, pa.float64() if f.name == "similarity" else pa.int64()) for f in PASSAGE])

    def work(batches):
        for batch in batches:
            found = [told(x) for x in passages_of(batch, min_words, similarity, False)[0]]
            counts = np.array([len(x) for x in found])
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), counts)))
            flat = pa.array([p for x in found for p in x], arrow)
            yield pa.RecordBatch.from_arrays([pa.compute.cast(ids, pa.int64()), *flat.flatten()], ["doc_id", *PASSAGE.names])

    return over_batches(named, work, T.StructType([T.StructField("doc_id", T.LongType()), *PASSAGE]))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the passages that an earlier document holds; a document of which nothing is left goes. n_chars, where there is one, follows the text."""
    docs, back = aside(docs, ("d", "_hits"))
    named, late = _with_hits(docs, min_words)
    schema = docs.schema

    def work(batches):
        for batch in batches:
            _, cuts = passages_of(batch, min_words, similarity, True)
            texts = [cut(t, c) for t, c in zip(batch.column("text").to_pylist(), cuts, strict=True)]
            columns = {f.name: batch.column(f.name) for f in schema}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, cuts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            keep = pa.array([not c or has_word(t) for t, c in zip(texts, cuts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(keep)

    return named_back(sifted(docs, late, False).unionByName(over_batches(named, work, schema)), back)
