"""Language identification with error-correcting output codes.

Every language has a codeword of bits, the codewords as far from each other as can be. One binary
classifier for each bit predicts it from byte n-grams (one to three bytes, ASCII in lower case, hashed to
BINS bins, weighted by the logarithm of their count and scaled to length 1). Decoding is loss-weighted: for each codeword the classifiers'
logistic losses are summed, each weighted by how reliable its bit was on held-out examples; the codeword of the least loss
wins. `margin` is the second-least loss less the least, per unit of weight; below AMBIGUOUS the text is flagged.

The classifiers are fitted on at most `per_lang` labelled documents of each language, chosen by a hash of the
id; a quarter of them is held out for the weights. All texts are classified whole, where they are read; nothing is shuffled but the sample.

Defined cases: null and empty texts, and any text without a model (no labelled document), have no language and are
ambiguous; of equal losses the first language by name wins, with margin 0; with one language all texts are of it; null labels aren't learned from; repeated or null ids are rows like others; ids are integers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import LOWER, integer_id, map_arrow, need, row_slices, text_bytes

PER_LANG, BINS, BITS, AMBIGUOUS = 400, 4096, 15, 0.25
ROUNDS, RATE, RIDGE = 300, 4.0, 1e-4


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1; columns are splits of the languages, all distinct up to sign where there are enough, chosen for the largest least distance."""
    if n < 2:
        return np.ones((n, bits), dtype=np.int8)
    rng = np.random.Generator(np.random.PCG64(seed))
    if n <= 5:  # all distinct splits: every pair of codewords is as far apart as any. A repeated one would be the same classifier, and correct nothing.
        return np.array([[1 if k >> j & 1 else -1 for k in range(1, 1 << n - 1)] for j in range(n)], dtype=np.int8)
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        if (abs(m.sum(axis=0)) == n).any() or len(np.unique(m * m[0], axis=1).T) < bits:
            continue
        d = (bits - m.astype(int) @ m.T) // 2
        least = d[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = m, least
    return best


def ngram_counts(buf: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """rows x bins counts of the hashed n-grams that lie within a row."""
    n = len(off) - 1
    x = LOWER[buf].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * bins, np.diff(off))
    shift = np.uint32(32 - int(np.log2(bins)))
    out = np.zeros(n * bins, dtype=np.int64)
    key = x
    for k in (1, 2, 3):
        if k > 1:
            key = key[:-1] * np.uint32(257) + x[k - 1 :]
        if len(key) == 0:
            break
        h = ((key + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1)) >> shift
        inside = row[: len(key)] == row[k - 1 :]
        out += np.bincount((row[: len(key)] + h)[inside], minlength=n * bins)
    return out.reshape(n, bins)


def features(col: pa.Array | pa.ChunkedArray, bins: int = BINS) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) of slices of the column."""
    buf, off = text_bytes(col)
    for a, b in row_slices(off):
        for c in range(a, b, 256):
            e = min(b, c + 256)
            x = np.log1p(ngram_counts(buf[off[c] : off[e]], off[c : e + 1] - off[c], bins).astype(np.float32))
            yield c, x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class OutputCodes:
    """The codewords, one linear classifier for each bit, and the bits' weights."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        self.bins, self.bits = bins, bits

    def fit(self, texts: list[str], langs: list[str]) -> OutputCodes:
        self.langs = sorted(set(langs))
        y = np.searchsorted(self.langs, langs)
        self.code = codewords(len(self.langs), self.bits)
        x = np.concatenate([f for _, f in features(pa.array(texts, pa.large_string()), self.bins)])
        held = np.zeros(len(y), dtype=bool)
        for k in range(len(self.langs)):
            held[np.flatnonzero(y == k)[3::4]] = True
        t = self.code[y].astype(np.float32)
        balance = (1 / np.bincount(y[~held], minlength=len(self.langs)).clip(1))[y]
        balance = (balance / balance[~held].mean()).astype(np.float32)[:, None]
        w, bias = np.zeros((self.bins, t.shape[1]), dtype=np.float32), np.zeros(t.shape[1], dtype=np.float32)
        xs, ts, bs = x[~held], t[~held], balance[~held]
        for _ in range(ROUNDS):
            g = -bs * ts / (1 + np.exp(np.clip(ts * (xs @ w + bias), -30, 30))) / len(xs)
            w -= RATE * (xs.T @ g + RIDGE * w)
            bias -= RATE * g.sum(axis=0)
        self.w, self.bias = w, bias
        right = ((x[held] @ w + bias) * t[held] > 0).mean(axis=0) if held.any() else np.ones(t.shape[1])
        # The weight of evidence of a bit that is right with this chance.
        p = (right * held.sum() + 1) / (held.sum() + 2)
        self.weight = np.maximum(np.log(p / (1 - p)), 0.05)
        self.weight /= self.weight.sum()
        return self

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each row for each language."""
        f = x @ self.w + self.bias
        return np.stack([np.logaddexp(0, -f * c) @ self.weight for c in self.code.astype(np.float32)], axis=1)

    def predict(self, col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and margin of each text."""
        best, margin = np.zeros(len(col), dtype=np.int64), np.zeros(len(col))
        for a, x in features(col, self.bins):
            loss = self.losses(x)
            at = loss.argmin(axis=1)
            two = np.sort(loss, axis=1)
            best[a : a + len(x)] = at
            margin[a : a + len(x)] = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.inf
        return best, margin


def labelled_sample(docs: DataFrame, per_lang: int) -> list:
    known = docs.where("doc_id is not null and lang is not null").select("doc_id", "lang").distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_lang).select("doc_id", "lang")
    d = docs.where("text is not null and text <> ''").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    return sorted(d.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["doc_id"]))


def language_id(docs: DataFrame, per_lang: int = PER_LANG, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """(doc_id, lang, predicted, margin, ambiguous) of every row."""
    need(docs, "doc_id", "text", "lang")
    d = docs.select(integer_id(docs).alias("doc_id"), "lang", "text")
    rows = labelled_sample(d, per_lang)
    if not rows:
        return d.select("doc_id", "lang", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("margin"), F.lit(True).alias("ambiguous"))
    shared = d.sparkSession.sparkContext.broadcast(OutputCodes().fit([r["text"] for r in rows], [r["lang"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, margin = shared.value.predict(b.column(2))
            off = text_bytes(b.column(2))[1]
            none = np.diff(off) == 0
            margin = np.minimum(np.round(margin, 6), 1e9)
            langs = pa.array(np.array(shared.value.langs, dtype=object)[best], pa.string(), mask=none)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), langs, pa.array(margin, mask=none), pa.array(none | (margin < ambiguous))], ["doc_id", "lang", "predicted", "margin", "ambiguous"])

    return d.transform(map_arrow, run, "doc_id long, lang string, predicted string, margin double, ambiguous boolean")
