"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities and weights of a lexicon learned from the labels, its words' nearness to a second person, capitals, punctuation, digits and obfuscation.
Lexicon terms are whole words and word beginnings (4 to 6 bytes), after lower-casing and after undoing digit and symbol stand-ins.
The classifier is fitted on at most `sample` labelled rows (SAMPLE; taken by a hash of doc_id, near copies thinned out); every text is scored whole. The trees and the
calibration see each of these rows through a lexicon learned from the other folds.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text counts as empty; an empty text has the features of no words and gets a score as any other. A doc_id with several labels is toxic if one of them is; a
null label is no label. Repeated rows are scored each. Without labels of both kinds every score is the share of toxic labels (0 without any). Empty tables give no rows. Extra columns
pass through `reject`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, crc_mod3, durable, named_back, over_batches
from .words import LOWER, WORD, Words, chunked, layout, mix, ngrams, powers

SAMPLE, THRESHOLD = 20_000, 0.7
#: A term enters the lexicon if so many toxic rows hold it, its log odds are this high, and its log-likelihood ratio (twice the surprise at so many toxic ones among its rows) leaves little room for chance.
LEXICON, LEAST_DOCS, LEAST_ODDS, LEAST_RATIO, FOLDS = 4_000, 5, 3.0, 16.0, 4
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 10
#: Bytes of text whose features are worked out at once; about 100 bytes of memory for each.
FEATURE_BYTES = 1 << 19
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen usted ustedes ti tuyo tuya vosotros vosotras os".split()

_PLAIN = LOWER.copy()
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _PLAIN[ord(_a)] = ord(_b)
_LOOSE = WORD.copy()
_LOOSE[[ord("@"), ord("$")]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, offs = layout(pa.array(words, pa.large_string()))
    return Words(data, offs, 0, len(words)).hashes()


_YOU = np.unique(_hash_words(SECOND_PERSON))


class Loose(Words):
    """Words in which stand-ins count as letters, and are read as those."""

    def __init__(self, data, offs, lo, hi):
        super().__init__(data, offs, lo, hi)
        raw = self.raw
        inside = _LOOSE[self.buf]
        inside[self.at - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.s, self.e = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.s, self.at)
        digits = np.append(0, np.cumsum(_DIGIT[raw] | (raw == 64) | (raw == 36)))
        letters = np.append(0, np.cumsum(_LETTER[raw]))
        #: letters together with stand-ins, at least as many letters as those
        stand = digits[self.e] - digits[self.s]
        self.mixed = (stand > 0) & (letters[self.e] - letters[self.s] >= np.maximum(2, stand))
        self.buf = _PLAIN[raw]

    def terms(self) -> list[np.ndarray]:
        """Hash of each word and of its beginnings of 4, 5 and 6 bytes (of a word that is no longer: the word's)."""
        up, down = powers(len(self.buf) + 1)
        total = np.append(np.uint64(0), np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)]))
        return [mix((total[np.minimum(self.e, self.s + p)] - total[self.s]) * down[self.s]) + np.uint64(p) for p in (1 << 30, 4, 5, 6)]


class Lexicon:
    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def of(self, w: Loose) -> np.ndarray:
        """Largest weight of each word's terms, 0 for a word outside the lexicon."""
        out = np.zeros(len(w.s))
        if not len(self.terms):
            return out
        for h in w.terms():
            at = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            np.maximum.at(out, at, np.where(self.terms[k] == h[at], self.weights[k], 0.0))
        return out


FEATURES = ["lexicon", "hits", "weight", "heaviest", "you_near", "you", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits", "mixed", "mixed_hits", "words"]


def features(column, lexicon: Lexicon) -> np.ndarray:
    data, offs = layout(column)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for lo, hi in chunked(offs, FEATURE_BYTES):
        w = Loose(data, offs, lo, hi)
        n, row = hi - lo, w.row()
        weight = lexicon.of(w)
        hit = weight > 0
        place = np.repeat(np.arange(n), np.diff(w.at))  # row of each byte, from the first text on

        def rate(flag, of=row, n=n):
            return np.bincount(of, flag, n)

        raw = w.raw[w.at[0] :]
        words = np.maximum(1.0, np.diff(w.first))
        chars = np.maximum(1.0, np.diff(w.at) - 1)
        letters = np.maximum(1.0, rate(_LETTER[raw], place))
        total = np.append(0, np.cumsum(_UPPER[w.raw]))
        shouted = (total[w.e] - total[w.s] == w.e - w.s) & (w.e - w.s > 2)
        # second person: the words as they stand
        up, down = powers(len(w.buf) + 1)
        low = LOWER[w.raw]
        sums = np.append(np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)]))
        small = np.flatnonzero(w.e - w.s <= 9)
        h = mix((sums[w.e[small]] - sums[w.s[small]]) * down[w.s[small]])
        k = np.minimum(np.searchsorted(_YOU, h), len(_YOU) - 1)
        you = np.zeros(len(row), bool)
        you[small[_YOU[k] == h]] = True
        near = np.append(0, np.cumsum(you))
        at = np.flatnonzero(hit)
        close = near[np.minimum(at + 6, len(row))] > near[np.maximum(at - 5, 0)]
        hits = rate(hit)
        out[lo:hi] = np.stack(
            [
                hits / words,
                np.log1p(hits),
                rate(weight) / words,
                _largest(weight, row, n),
                rate(close, row[at]) / (hits + 1),
                rate(you) / words,
                rate(_UPPER[raw], place) / letters,
                rate(shouted) / words,
                rate(raw == 33, place) / chars,
                rate(raw == 63, place) / chars,
                rate(_PUNCT[raw], place) / chars,
                rate(_DIGIT[raw], place) / chars,
                rate(w.mixed) / words,
                rate(w.mixed & hit) / words,
                np.log1p(np.diff(w.first)),
            ],
            axis=1,
        )
    return out


def _largest(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, row, values)
    return out


class Boosted:
    """Gradient-boosted trees of one depth on quantile bins, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.depth, self.base, self.trees = depth, float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            splits = []
            for level in range(depth):
                size = 1 << level
                best = np.full(size, 1e-9)
                feature, cut = np.zeros(size, np.int64), np.full(size, BINS, np.int64)  # without a gain all go left
                for f in range(x.shape[1]):
                    key = node * BINS + binned[:, f]
                    gs, hs, ns = (np.cumsum(np.bincount(key, v, size * BINS).reshape(size, BINS), axis=1) for v in (g, h, np.ones(len(y))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < LEAF) | (nt - ns < LEAF)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(size), k]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], f, k[better]
                splits.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            size = 1 << depth
            value = RATE * np.bincount(node, g, size) / (np.bincount(node, h, size) + 1)
            self.trees.append((splits, value))
            margin += value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots and values of a rising step function, to be interpolated."""
    places, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum of y, count, least x, largest x
    for a, total, n in zip(places.tolist(), np.bincount(at, y, len(places)).tolist(), np.bincount(at, minlength=len(places)).tolist(), strict=True):
        blocks.append([total, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots = [v for b in blocks for v in ((b[2], b[0] / b[1]), (b[3], b[0] / b[1]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Model:
    def __init__(self, lexicon: Lexicon, share: float):
        self.lexicon, self.share, self.boosted, self.knots = lexicon, share, None, None

    def fit(self, x: np.ndarray, y: np.ndarray, calibrating: np.ndarray) -> None:
        if 0 < y[~calibrating].sum() < (~calibrating).sum():
            self.boosted = Boosted(x[~calibrating], y[~calibrating])
            margins = self.boosted.margin(x[calibrating])
            if len(margins) and 0 < y[calibrating].sum() < calibrating.sum():
                self.knots = isotonic(margins, y[calibrating])

    def score(self, column) -> np.ndarray:
        """0 to 1; a small part of the uncalibrated probability keeps the order within a calibrated step."""
        if self.boosted is None:
            return np.full(len(column), self.share)
        margin = self.boosted.margin(features(column, self.lexicon))
        raw = 1 / (1 + np.exp(-margin))
        return raw if self.knots is None else 0.98 * np.interp(margin, *self.knots) + 0.02 * raw


def _least_shingle(column, seed: int) -> np.ndarray:
    """Smallest hash of a text's three-word shingles: near copies mostly share it. 0 without any."""
    data, offs = layout(column)
    out = np.zeros(len(offs) - 1, dtype=np.uint64)
    for lo, hi in chunked(offs):
        w = Words(data, offs, lo, hi)
        g = mix(ngrams(w.hashes(), 3) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        row = w.row()
        inner = np.flatnonzero(row[: len(g)] == row[2:]) if len(g) else np.zeros(0, np.int64)
        least = np.full(hi - lo, 2**64 - 1, dtype=np.uint64)
        np.minimum.at(least, row[inner], g[inner])
        out[lo:hi] = np.where(least == 2**64 - 1, 0, least)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(crc_mod3(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample)  # at most `sample` rows of two numbers
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id").withColumn("fold", fold)
    rows = durable(rows)  # at most `sample` documents (and rows of one doc_id); the passes below read these and not the whole table

    def thin(batches):
        for batch in batches:
            keys = [_least_shingle(batch.column("text"), s).view(np.int64) for s in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "fold")), *(pa.array(k) for k in keys)], ["doc_id", "toxic", "fold", "a", "b"])

    keys = over_batches(rows, thin, "doc_id long, toxic int, fold int, a long, b long").toPandas().sort_values(["doc_id", "toxic"])  # `sample` rows
    keys = keys.drop_duplicates("doc_id").drop_duplicates(["a", "toxic"]).drop_duplicates(["b", "toxic"])
    if not len(keys):
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), 0.0)
    chosen = spark.createDataFrame([(int(d),) for d in keys["doc_id"]], "doc_id long")
    rows = rows.join(F.broadcast(chosen), "doc_id")

    def count(batches):
        for batch in batches:
            data, offs = layout(batch.column("text"))
            y, part = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for lo, hi in chunked(offs):
                w = Loose(data, offs, lo, hi)
                row, found = w.row(), []
                for h in w.terms():
                    order = np.lexsort((row, h))
                    h, r = h[order], row[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
                    found.append((h[new], lo + r[new]))
                h, r = (np.concatenate(x) for x in zip(*found, strict=True))
                terms, at = np.unique(h, return_inverse=True)
                cell, where = np.unique(at * FOLDS + part[r], return_inverse=True)
                bad, every = np.bincount(where, y[r], len(cell)), np.bincount(where, minlength=len(cell))
                columns = terms[cell // FOLDS].view(np.int64), (cell % FOLDS).astype(np.int32), bad.astype(np.int64), every.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "fold", "bad", "n"])

    # of each term the numbers in all rows and in each fold
    here = [F.col("fold") == k for k in range(FOLDS)]
    cells = [F.sum(F.when(f, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, f in enumerate(here) for c in ("bad", "n")]
    counted = over_batches(rows, count, "term long, fold int, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), *cells).where(F.col("bad") >= LEAST_DOCS)
    found = counted.orderBy(F.desc("bad"), F.desc(F.col("bad") / F.col("n")), "term").where((_odds(F.col("bad"), F.col("n"), keys) >= LEAST_ODDS) & (_ratio(F.col("bad"), F.col("n"), keys) >= LEAST_RATIO)).limit(LEXICON).toPandas()

    def lexicon(bad, n, own) -> Lexicon:
        keep = bad >= LEAST_DOCS
        odds = _odds(bad, n, own)
        keep &= (odds >= LEAST_ODDS) & (_ratio(bad, n, own) >= LEAST_RATIO)
        return Lexicon(found["term"].to_numpy(np.int64).view(np.uint64)[keep], odds[keep])

    whole = {c: found[c].to_numpy(float) for c in found.columns if c != "term"}
    model = Model(lexicon(whole["bad"], whole["n"], keys), float((keys["toxic"] == 1).mean()))
    # a row's features for fitting come from a lexicon without its fold, so that the trees see how well terms do on texts that didn't choose them
    others = [lexicon(whole["bad"] - whole[f"bad{k}"], whole["n"] - whole[f"n{k}"], keys[keys["fold"] != k]) for k in range(FOLDS)]
    shared = spark.sparkContext.broadcast(others)

    def measure(batches):
        for batch in batches:
            part, x = batch.column("fold").to_numpy(), np.zeros((batch.num_rows, len(FEATURES)))
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                x[at] = features(batch.column("text").take(pa.array(at)), shared.value[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(c) for c in x.T)], ["doc_id", "toxic", *FEATURES])

    seen = over_batches(rows, measure, "doc_id long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["doc_id", *FEATURES])
    order = np.random.default_rng(0).random(len(seen))
    model.fit(seen[FEATURES].to_numpy(float), seen["toxic"].to_numpy(float), order < 0.25)
    return model


def _odds(bad, n, keys):
    """Smoothed log odds of a term between toxic and other rows of `keys`; numbers or columns."""
    log = F.log if isinstance(bad, Column) else np.log
    toxic, rows = float((keys["toxic"] == 1).sum()), float(len(keys))
    return log((bad + 0.5) / (toxic + 1)) - log((n - bad + 0.5) / (rows - toxic + 1))


def _ratio(bad, n, keys):
    """Log-likelihood ratio of a term's share of toxic rows against that of all `keys`; numbers or columns."""
    log = F.log if isinstance(bad, Column) else np.log
    share, least = min(max(float((keys["toxic"] == 1).mean()), 1e-9), 1 - 1e-9), 1e-9
    good = n - bad
    return 2 * (bad * log((bad + least) / (n * share + least)) + good * log((good + least) / (n * (1 - share) + least)))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema if f.name != name), T.StructField(name, T.DoubleType())])

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != name), pa.array(shared.value.score(batch.column("text")), pa.float64())], schema.names)

    return over_batches(docs, work, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, sample))
    return out.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose text scores at `threshold` or above."""
    own, back = aside(docs, ("_toxicity",))
    return named_back(scored(own, train(docs, labels, sample), "_toxicity").where(F.col("_toxicity") < threshold), back)
