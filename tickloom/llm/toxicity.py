"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are a text's words (ASCII lower case). The examples are a bounded, seeded sample of the labels (at most `per_class`
of each class), clean and toxic ones alike; the vocabulary is all their words. A term weighs (1 + ln tf) x idf x
relevance. idf = ln(N / df), with document frequencies counted over all documents, is floored to 0 for terms of more than MAX_SHARE of
them, unless more toxic examples than clean ones have the term. Relevance (relevance frequency, squared) is log2(2 + (a - 1) / b)^2 for a term
that a toxic and b clean examples have, never below 1: no term is dropped for it. Without that factor neighbours are decided
by rare harmless words (README has the figures).

The index is inverted: a posting list for each term, in blocks of BLOCK examples, each with its largest weight. A query
adds these maxima to a bound for every block. The FIRST blocks of the highest bounds are scored, then every other block whose bound
reaches the k-th best cosine so far; so the k nearest are exact (ties: the lesser id). Queries are
searched many at a time; those whose postings are few for their blocks, so that bounds would cost more than they
save, have all their postings added up at once, with the same result. Every text is read whole.

The score is a distance-weighted vote: squared cosines, weighted by how many labelled
documents of its class each example stands for, with the labels' toxic share as a prior of weight PRIOR; then a logistic
calibration fitted on the examples, each scored without itself.

Defined cases: null and empty texts, and those without a term of the vocabulary, get the prior and no
evidence, and are never called toxic; without toxic or without clean labels every score is null and nothing is toxic;
rows of the same id are scored one by one; labels that are null are left out, of a document's several labels the highest counts;
ids are integers; other columns, whatever their names, are ignored or passed on.
Neither documents nor scores are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import give_back, integer_id, map_arrow, need, numbered, word_hashes

PER_CLASS, NEIGHBOURS, BLOCK, FIRST, PRIOR, MAX_SHARE, THRESHOLD = 1500, 15, 64, 8, 4e-4, 0.1, 0.5
#: The relevance of a term that as many toxic examples (but one) as clean ones have.
RELEVANT = np.log2(3) ** 2
#: Most queries, and most of their terms' blocks, searched at a time (a query of more is alone).
QUERIES, ENTRIES = 128, 1 << 18
#: Postings for each block of a term from which on bounds pay.
PAYS = 4
ROWS = 500


class Terms:
    """The vocabulary: sorted hashes; a bitmap of 2^20 bits goes before the search in them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[self.hashes >> np.uint64(44)] = True

    def vectors(self, col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the texts' terms, in this order."""
        h, n = word_hashes(col)
        row = np.repeat(np.arange(len(n)), n)
        on = self.may[h >> np.uint64(44)]
        h, row = h[on], row[on]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        on = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        key, count = np.unique(row[on] << 32 | at[on], return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, count


def relevance(rows: np.ndarray, terms: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """log2(2 + (a - 1) / b)^2 of each term, from the examples that have it."""
    a = np.bincount(terms, weights=toxic[rows], minlength=n_terms)
    b = np.bincount(terms, minlength=n_terms) - a
    return np.log2(2 + np.maximum(a - 1, 0) / np.maximum(b, 1)) ** 2


def weigh(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1 in each row, without terms of weight 0."""
    w = (1 + np.log(counts)) * weight[terms]
    on = w > 0
    rows, terms, w = rows[on], terms[on], w[on]
    if len(rows):
        w = w / np.sqrt(np.bincount(rows, weights=w * w))[rows]
    return rows, terms, w


def spread(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin .. begin + n - 1 of every entry in turn, and the entry of each."""
    entry = np.repeat(np.arange(len(n)), n)
    return np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + begin[entry], entry


class BlockMaxIndex:
    """Posting lists of the examples' weights by term and block, with the largest weight of each term in each of its blocks."""

    def __init__(self, n: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order], weights[order]
        key = terms[order] * np.int64(self.blocks) + self.rows // BLOCK
        self.post = np.flatnonzero(np.diff(key, prepend=-1))  # where a term's postings in a block begin
        self.size = np.diff(np.append(self.post, len(key)))
        self.block = key[self.post] % self.blocks
        self.most = np.maximum.reduceat(self.weights, self.post) if len(self.post) else np.zeros(0)
        self.begin = np.searchsorted(key[self.post], np.arange(n_terms + 1) * np.int64(self.blocks))
        self.start = np.append(self.post, len(key))[self.begin]  # of each term's postings

    def search(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, but: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each of the n queries that has one, its k examples of the highest cosine above 0 (ties: the lesser number) and the cosines. but: an example that a query leaves out."""
        begin = np.searchsorted(rows, np.arange(n + 1))
        entries = np.concatenate([[0], np.cumsum(self.begin[terms + 1] - self.begin[terms])])[begin]
        a = 0
        while a < n:
            b = min(n, a + QUERIES, max(a + 1, int(np.searchsorted(entries, entries[a] + ENTRIES, "right")) - 1))
            s = slice(begin[a], begin[b])
            if s.start < s.stop:
                yield from self._batch(rows[s] - a, terms[s], weights[s], b - a, k, None if but is None else but[a:b], a)
            a = b

    def _batch(self, rows, terms, weights, n, k, but, first):
        size = self.start[terms + 1] - self.start[terms]
        if size.sum() < PAYS * (self.begin[terms + 1] - self.begin[terms]).sum():
            p = np.repeat(self.start[terms] - np.cumsum(size) + size, size)
            p += np.arange(len(p))
            cell = np.repeat(rows * self.n, size)
            cell += self.rows[p]
            cos = np.bincount(cell, weights=np.repeat(weights, size) * self.weights[p], minlength=n * self.n)
            if but is not None:
                cos.reshape(n, self.n)[np.arange(n), but] = 0
        else:
            cos = self._bounded(rows, terms, weights, n, k, but)
        at = min(k, self.n) - 1
        c = np.round(cos.reshape(n, self.n), 12)
        kth = -np.partition(-c, at, axis=1)[:, at]
        r, x = np.nonzero((c >= kth[:, None]) & (c > 0))
        v = c[r, x]
        order = np.lexsort((x, -v, r))
        r, x, v = r[order], x[order], v[order]
        begin = np.searchsorted(r, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(begin)):
            z = slice(begin[i], min(begin[i] + k, begin[i + 1]))
            yield first + int(i), x[z], v[z]

    def _bounded(self, rows, terms, weights, n, k, but) -> np.ndarray:
        """Cosines of the blocks whose bounds reach the k-th best one."""
        e, of = spread(self.begin[terms], self.begin[terms + 1] - self.begin[terms])
        row, w = rows[of], weights[of]
        cell = row * self.blocks + self.block[e]
        bound = np.bincount(cell, weights=w * self.most[e], minlength=n * self.blocks).reshape(n, self.blocks)
        cos = np.zeros(n * self.n)

        def score(chosen: np.ndarray) -> None:
            on = np.flatnonzero(chosen.ravel()[cell])
            p, i = spread(self.post[e[on]], self.size[e[on]])
            np.add(cos, np.bincount(row[on][i] * self.n + self.rows[p], weights=w[on][i] * self.weights[p], minlength=n * self.n), out=cos)
            if but is not None:
                cos.reshape(n, self.n)[np.arange(n), but] = 0

        done = np.zeros_like(bound, dtype=bool)
        np.put_along_axis(done, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        done &= bound > 0
        score(done)
        at = min(k, self.n) - 1
        kth = -np.partition(-cos.reshape(n, self.n), at, axis=1)[:, at]
        score((bound > 0) & ~done & (bound >= kth[:, None] - 1e-9))
        return cos


class ToxicModel:
    """Terms, their weights, index, votes and calibration; of bounded size, so it may be broadcast."""

    def __init__(self, terms: Terms, k: int = NEIGHBOURS):
        self.terms, self.k = terms, k

    def fit(self, ids: np.ndarray, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], toxic: np.ndarray, stands_for: np.ndarray, idf: np.ndarray, common: np.ndarray) -> ToxicModel:
        """ids ascend; vectors: the examples' (row, term, count); common: which terms have a floored IDF."""
        self.ids, self.toxic, self.mass = ids, toxic.astype(float), stands_for
        self.weight = idf * relevance(vectors[0], vectors[1], self.toxic, len(idf))
        self.weight[common & (self.weight < idf * RELEVANT)] = 0
        self.prior = float((self.toxic * self.mass).sum() / self.mass.sum())
        v = weigh(*vectors, self.weight)
        self.index = BlockMaxIndex(len(ids), *v, len(idf))
        raw = np.full(len(ids), self.prior)
        for i, near, cos in self.index.search(*v, len(ids), self.k, np.arange(len(ids))):
            raw[i] = self.vote(near, cos)
        # Logistic calibration by Newton's method, with the classes at their true shares and a little ridge.
        x = np.stack([np.ones(len(raw)), _logit(raw)], axis=1)
        m = self.mass / self.mass.mean()
        beta = np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            g = x.T @ (m * (self.toxic - p)) - 1.0 * (beta - [0.0, 1.0])
            step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + np.eye(2), g)
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        self.beta = beta
        give_back()
        return self

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        w = cos**2 * self.mass[near] / self.mass.mean()
        return float((np.sum(w * self.toxic[near]) + PRIOR * self.prior) / (np.sum(w) + PRIOR))

    def score(self, col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[list[dict]]]:
        """Calibrated scores, and evidence: the nearest examples with their cosines and labels."""
        raw = np.full(len(col), self.prior)
        evidence: list[list[dict]] = [[] for _ in range(len(col))]
        for i, near, cos in self.nearest(col):
            raw[i] = self.vote(near, cos)
            evidence[i] = [{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in zip(self.ids[near].tolist(), np.round(cos, 6).tolist(), (self.toxic[near] > 0).tolist())]
        return self.calibrated(raw), evidence

    def flags(self, col: pa.Array | pa.ChunkedArray, threshold: float) -> np.ndarray:
        """Which texts are toxic: by score, and with evidence."""
        raw, known = np.full(len(col), self.prior), np.zeros(len(col), dtype=bool)
        for i, near, cos in self.nearest(col):
            raw[i], known[i] = self.vote(near, cos), True
        return (self.calibrated(raw) >= threshold) & known

    def nearest(self, col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The neighbours of each text that has any; the terms of ROWS texts are held at a time."""
        for a in range(0, len(col), ROWS):
            part = col.slice(a, ROWS)
            for i, near, cos in self.index.search(*weigh(*self.terms.vectors(part), self.weight), len(part), self.k):
                yield a + i, near, cos

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.beta[0] + self.beta[1] * _logit(raw))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[pa.Table, dict[int, int]]:
    """At most per_class labelled documents of each class, chosen by a hash of the id, and how many labels each class has."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    size = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    w = Window.partitionBy("toxic").orderBy("h", "doc_id")
    chosen = y.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_class).select("doc_id", "toxic")
    d = docs.where("text is not null").select(integer_id(docs).alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return d.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by("doc_id"), size


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS, max_share: float = MAX_SHARE) -> ToxicModel | None:
    """The model; None if a class has no labelled document. docs: all of them, for the document frequencies."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    rows, size = labelled_sample(docs, labels, per_class)
    y = rows.column("toxic").to_numpy()
    if len(set(y)) < 2:
        return None
    ids, texts = rows.column("doc_id").to_numpy(), rows.column("text").cast(pa.large_string()).combine_chunks()
    terms = Terms(word_hashes(texts)[0])
    n = len(terms.hashes)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, dtype=np.int64)
        for b in batches:
            total[n] += b.num_rows
            total[:n] += np.bincount(shared.value.vectors(b.column(0))[1], minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["f", "n"])

    df = np.zeros(n + 1)
    counts = docs.select("text").transform(map_arrow, count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()  # one number a term of the vocabulary, which the sample bounds
    df[counts.column("f").to_numpy()] = counts.column("n").to_numpy()
    shared.unpersist()
    idf = np.log(df[n] / np.maximum(df[:n], 1))
    have = np.bincount(y, minlength=2)
    mass = np.array([size[0] / have[0], size[1] / have[1]])[y]
    return ToxicModel(terms, k).fit(ids, terms.vectors(texts), y, mass, idf, df[:n] > max_share * df[n])


EVIDENCE = "array<struct<doc_id: bigint, cosine: double, toxic: boolean>>"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """(doc_id, score, toxic, evidence) of every document."""
    need(docs, "doc_id", "text")
    d = docs.select(integer_id(docs).alias("doc_id"), "text")
    model = train(docs, labels, **kw)
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"), F.expr(f"cast(array() as {EVIDENCE})").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, evidence = shared.value.score(b.column(1))
            toxic = (score >= threshold) & np.array([bool(e) for e in evidence], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(toxic), pa.array(evidence, kind)], ["doc_id", "score", "toxic", "evidence"])

    return d.transform(map_arrow, run, f"doc_id long, score double, toxic boolean, evidence {EVIDENCE}")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    model = train(docs, labels, **kw)
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~shared.value.flags(b.column(at), threshold)))

    plain = numbered(docs)  # columns' names may be anything
    return plain.transform(map_arrow, run, plain.schema).toDF(*docs.columns)
