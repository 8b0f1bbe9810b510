"""Language of words and texts by a linear-chain conditional random field.

A word's features are its byte n-grams with the word's borders (so beginnings and endings are features of their own) and the word itself as a lexicon entry, all hashed to one
table of weights; transitions between the languages of neighbouring words are learned too. Forward-backward gives each word's language probabilities, also in
code-switched text; a document's language is the one with the largest mean probability over its words.

Fitting: on at most `sample` texts (SAMPLE), dealt equally to the languages by a hash of doc_id, of each at most WORDS words from places spread over the text; stretches of different languages are
joined to sequences, from which the transitions are learned. Of more than LANGS language names those of the most texts are learned. Learned only from text and non-null lang of rows whose crc32(doc_id as text) mod 3 is not 1. lang,
source and doc_id are never inputs of a prediction. Whole texts are predicted; a chain is cut every CHAIN words to bound the number of steps.

Defined cases: a null text, or one without a letter, is `und` with score 0, as are all texts when nothing could be learned; a text whose only letters stand outside
words cannot exist. A single learned language is predicted with score 1. Repeated rows are predicted each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod3, over_batches
from .words import WORD, Words, chunked, layout

SAMPLE, WORDS, TABLE, CHAIN, LANGS = 4_000, 150, 16, 512, 100
#: Of a longer text so many pieces of so many characters come to the driver, spread over it: enough for WORDS words, and at most 20 MB in all.
PIECES, PIECE = 8, 500
SIZES = (2, 3, 4)
EPOCHS, BATCH, STEP = 3, 128, 0.3

_LETTER = WORD.copy()
_LETTER[48:58] = False
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False


class Letters(Words):
    """Words of letters only."""

    def __init__(self, data, offs, lo, hi):
        super().__init__(data, offs, lo, hi, _LETTER)

    def ngrams(self) -> list[np.ndarray]:
        """For each n-gram size, the table row of the n-gram that ends at each byte; bytes outside words count as one border sign."""
        inside = _LETTER[self.buf]
        inside[self.at - 1] = False
        text = np.where(inside, self.buf, 1).astype(np.uint32)
        out, h = [], text.copy()
        for n in range(2, max(SIZES) + 1):
            before = np.ones_like(text)
            before[n - 1 :] = text[: len(text) - n + 1]
            h = h * np.uint32(0x01000193) ^ before
            if n in SIZES:
                out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE)).astype(np.int32) + (SIZES.index(n) << TABLE))
        return out

    def lexicon(self) -> np.ndarray:
        return (self.hashes() >> np.uint64(64 - TABLE)).astype(np.int32) + (len(SIZES) << TABLE)


ROWS = (len(SIZES) + 1) << TABLE


def emissions(w: Letters, weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each language: the mean weight of its n-grams, each size, and its lexicon weight."""
    out = weights[w.lexicon()].astype(np.float64)
    stop = np.minimum(w.e, len(w.buf) - 1)  # the n-gram that ends at the border after the word counts too
    for rows in w.ngrams():
        total = np.zeros((len(rows) + 1, weights.shape[1]))
        np.cumsum(weights[rows], axis=0, out=total[1:])
        out += total[stop + 1] - total[w.s]
    return out


def forward_backward(em: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of chains (`first`: their first words and the end) and the expected transitions, scaled at each step; all chains advance together."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    emit = np.exp(em - em.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps + 1), side="left")  # chains longer than t
    for t in range(steps):
        at = begin[: live[t]] + t
        a = emit[at] * (start if t == 0 else alpha[at - 1] @ moves)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    both = np.zeros_like(moves)
    for t in range(steps - 1, 0, -1):
        at = begin[: live[t]] + t
        eb = emit[at] * beta[at]
        b = eb @ moves.T
        norm = b.sum(axis=1, keepdims=True)
        beta[at - 1] = b / norm
        joint = alpha[at - 1].T @ (eb / np.einsum("ij,jk,ik->i", alpha[at - 1], moves, eb)[:, None])
        both += joint * moves
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300), both


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        n = len(langs)
        self.weights = np.zeros((ROWS, n), dtype=np.float32)
        self.start, self.moves = np.full(n, 1 / max(n, 1)), np.full((n, n), 1 / max(n, 1))

    def fit(self, texts: list[str], langs: list[str], seed: int = 0) -> None:
        """AdaGrad on the likelihood of sequences that join stretches of words of different languages."""
        rng, n = np.random.default_rng(seed), len(self.langs)
        if n < 2:
            return
        data, offs = layout(pa.array(texts, pa.large_string()))
        own = np.array([self.langs.index(x) for x in langs])
        ids, lens, tags = [], [], []  # feature rows of each word, flattened
        for lo, hi in chunked(offs):
            w = Letters(data, offs, lo, hi)
            grams, lexicon = w.ngrams(), w.lexicon()
            for i in range(hi - lo):
                words = np.arange(w.first[i], w.first[i + 1])
                if len(words) > WORDS:
                    # runs of 30 words, spread over the text
                    words = np.unique((np.linspace(0, len(words) - 30, WORDS // 30).astype(int)[:, None] + np.arange(30)).ravel()) + w.first[i]
                for k in words:
                    a, b = int(w.s[k]), min(int(w.e[k]), len(w.buf) - 1) + 1
                    ids.append(np.concatenate([lexicon[k : k + 1], *(g[a:b] for g in grams)]))
                tags.append(np.full(len(words), own[lo + i]))
        if not ids:
            return
        lens, flat, tag = np.array([len(x) for x in ids]), np.concatenate(ids), np.concatenate(tags)
        place = np.append(0, np.cumsum(lens))
        by_lang = [np.flatnonzero(tag == k) for k in range(n)]
        present = [k for k in range(n) if len(by_lang[k])]
        square, logmoves = np.full((ROWS, n), 1e-3, dtype=np.float32), np.zeros((n, n))
        msquare = np.full((n, n), 1e-3)
        rounds = max(1, EPOCHS * len(tag) // (BATCH * 60))
        for _ in range(rounds):
            words, gold, first = [], [], [0]
            for _ in range(BATCH):
                size = 0
                while size < 60:
                    k = present[rng.integers(len(present))]
                    take = int(min(rng.geometric(1 / 25), 60 - size, len(by_lang[k])))
                    at = int(rng.integers(len(by_lang[k]) - take + 1))
                    words.append(by_lang[k][at : at + take])
                    gold.append(np.full(take, k))
                    size += take
                first.append(first[-1] + size)
            words, gold, first = np.concatenate(words), np.concatenate(gold), np.array(first)
            many = lens[words]
            rows = flat[np.repeat(place[words] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            of = np.repeat(np.arange(len(words)), many)
            em = np.zeros((len(words), n))
            picked = self.weights[rows]
            for k in range(n):
                em[:, k] = np.bincount(of, picked[:, k], len(words))
            moves = np.exp(logmoves)
            moves /= moves.sum(axis=1, keepdims=True)
            gamma, both = forward_backward(em, first, self.start, moves)
            error = np.eye(n)[gold] - gamma
            touched, inverse = np.unique(rows, return_inverse=True)
            step = np.stack([np.bincount(inverse, error[of, k], len(touched)) for k in range(n)], axis=1) / len(words)
            square[touched] += step**2 * 1e6
            self.weights[touched] += STEP * 1e3 * step / np.sqrt(square[touched])
            inner = np.ones(len(words), bool)
            inner[first[:-1]] = False
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            grad = (seen - both) / len(words)
            grad -= grad.sum(axis=1, keepdims=True) * moves  # the rows of `moves` are normalised
            msquare += grad**2
            logmoves += 0.2 * grad / np.sqrt(msquare)
        moves = np.exp(logmoves)
        self.moves = moves / moves.sum(axis=1, keepdims=True)

    def words(self, w: Letters) -> np.ndarray:
        """Probabilities of each word's languages."""
        counts = np.diff(w.first)
        cuts = [np.arange(a, a + c, CHAIN) for a, c in zip(w.first[:-1].tolist(), counts.tolist(), strict=True) if c]
        first = np.append(np.concatenate(cuts) if cuts else np.zeros(0, np.int64), len(w.s))
        return forward_backward(emissions(w, self.weights), first, self.start, self.moves)[0]

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        data, offs = layout(column)
        names, scores = ["und"] * (len(offs) - 1), np.zeros(len(offs) - 1)
        if not self.langs:
            return names, scores
        for lo, hi in chunked(offs):
            w = Letters(data, offs, lo, hi)
            total = np.zeros((w.n, len(self.langs)))
            if len(w.s):
                p = self.words(w)
                row = w.row()
                for k in range(len(self.langs)):
                    total[:, k] = np.bincount(row, p[:, k], w.n)
            count = np.diff(w.first)
            ascii_ = np.bincount(np.repeat(np.arange(w.n), np.diff(w.at)), _ASCII_LETTER[w.buf[w.at[0] :]], w.n) > 0
            best = total.argmax(axis=1)
            for i in range(w.n):
                if count[i] and (ascii_[i] or any(c.isalpha() for c in data[offs[lo + i] : offs[lo + i + 1]].tobytes().decode())):
                    names[lo + i] = self.langs[best[i]]
                    scores[lo + i] = min(1.0, total[i, best[i]] / count[i])
        return names, scores


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(crc_mod3(F.col("doc_id")) != 1)
    per_lang = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).select("lang", "n")
    counts = {r["lang"]: r["n"] for r in per_lang.collect()}
    if not counts:
        return Model([])
    share = sample / len(counts)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("lang")), F.lit(1 << 30))
    below = known.sparkSession.createDataFrame([(k, int((1 << 30) * min(1.0, share / n)) + 1) for k, n in counts.items()], "lang string, below long")
    # `sample` rows are expected and 1.2 times as many the most
    at = [F.substring("text", (F.length("text") * (i / PIECES)).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)]
    text = F.when(F.length("text") > PIECES * PIECE, F.concat_ws("\n", *at)).otherwise(F.col("text"))
    rows = known.join(F.broadcast(below), "lang").where(part < F.col("below")).select("doc_id", "lang", text.alias("text")).limit(int(1.2 * sample) + len(counts)).toPandas().sort_values(["doc_id", "lang", "text"])
    model = Model(sorted(counts))
    model.fit(rows["text"].tolist(), rows["lang"].tolist())
    return model


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def work(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.compute.cast(batch.column("doc_id"), pa.int64()), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = over_batches(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
