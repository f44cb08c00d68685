"""Language-model scoring by a weighted backoff automaton over words.

Counting. Words, pairs and triples are counted over all documents; kept are all words, and pairs and triples with a count of
MIN_COUNT or more, at every size, so the model grows with the corpus. A triple can't be more frequent than its pairs, so triples are
counted only where both pairs are kept, without losing one.

Distribution. Documents are spread over parts by a hash. A part asks for what its own texts need: for each
context its followers, by hash, sorted and cut by context into buckets. A bucket's task adds up what all
parts sent and answers each in the order of its question, so an answer has no keys. Two rounds (pairs with their
words, then triples) give every part the slice of the model that its texts can reach, with corpus-wide counts. Nothing
is broadcast or brought to the driver but the number of words; a task holds a part or a bucket, whatever the corpus.
Contexts go by 56 bits of hash; followers within their context by 40, those of pairs by 32.

Smoothing. Interpolated absolute discounting: for a kept h w, P(w | h) = (c(h w) - D) / c(h) + b(h) P(w | h'), else
b(h) P(w | h'), where h' drops the first word of h and b(h) = 1 - (S - D K) / c(h), with S and K the sum and the
number of the kept h w. Words have P(w) = (c(w) - D) / N; the D V / N that is left is for words that the corpus doesn't have.
Every context's probabilities add up to 1.

Automaton. States are the contexts: the empty one, words, pairs. An arc (state, word) has a log-probability and leads to the
longest context that is a state; where there is none, the failure arc costs log b(state) and leads to
the state without its first word. Each text is read once from left to right, carrying its state, and adds up its
log-probabilities; all texts of a part go through the automaton together.

Defined cases: words are runs of ASCII letters, digits and characters beyond ASCII, ASCII letters in lower
case; null and empty texts and those without a word have 0 words and null scores; rows of equal or null ids are
scored each; ids are integers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import P_WORD, integer_id, lean_group, map_arrow, mix, need, spans, text_bytes, word_hashes

MIN_COUNT, DISCOUNT = 2, 0.5
#: Bytes of text in a part (parts grow with the square root of the corpus beyond FEW of them); n-grams in a bucket; most buckets.
PART, FEW, BUCKET, MOST_BUCKETS = 12 << 20, 4096, 1 << 20, 1 << 16
#: Places whose arcs are looked up at a time.
PLACES = 1 << 18
FIELDS = ("x1", "x2", "x3", "x4", "x5")
SLICE = "level int, bucket int, part int, " + ", ".join(f"{x} binary" for x in FIELDS)


def pack(x: np.ndarray) -> bytes:
    """Counts, mostly small: their number, a byte each, then two bytes for those from 255 on, then eight for those from 65535 on."""
    big = x[x >= 255]
    return np.int64(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + np.minimum(big, 65535).astype(np.uint16).tobytes() + big[big >= 65535].astype(np.uint64).tobytes()


def unpack(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    out = np.frombuffer(b, np.uint8, n, 8).astype(np.int64)
    big = out == 255
    m = int(big.sum())
    mid = np.frombuffer(b, np.uint16, m, 8 + n).astype(np.int64)
    mid[mid == 65535] = np.frombuffer(b, np.uint64, offset=8 + n + 2 * m)
    out[big] = mid
    return out


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 56-bit numbers as differences: five bytes each, those that need more after them."""
    d = np.diff(h, prepend=np.uint64(0))
    most = np.uint64((1 << 40) - 1)
    low = np.minimum(d, most)
    return np.int64(len(h)).tobytes() + low.astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + d[d >= most].tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    d = np.frombuffer(b, np.uint32, n, 8).astype(np.uint64) | np.frombuffer(b, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32)
    d[d == np.uint64((1 << 40) - 1)] = np.frombuffer(b, np.uint64, offset=8 + 5 * n)
    return np.cumsum(d, dtype=np.uint64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is in the sorted keys; -1 if it isn't."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def ask(level: int, part: int, bits: int, context: np.ndarray, times: np.ndarray, followers: np.ndarray, word: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows of a part's questions: sorted context hashes with their counts, the number of followers of each, the followers' word hashes and counts."""
    begin = np.searchsorted(bucket_of(context, bits), np.arange((1 << bits) + 1))
    at = np.concatenate([[0], np.cumsum(followers)])[begin]
    rows = []
    for k in np.flatnonzero(np.diff(begin)):
        c, f = slice(begin[k], begin[k + 1]), slice(at[k], at[k + 1])
        w = word[f]
        bytes_of = (w >> np.uint64(32)).astype(np.uint32).tobytes() + ((w >> np.uint64(24)).astype(np.uint8).tobytes() if level == 1 else b"")
        rows.append((level, int(k), part, pack_sorted(context[c] >> np.uint64(8)), pack(times[c]), pack(followers[c]), bytes_of, pack(n[f])))
    return rows


def slices(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], ["level", "bucket", "part", *FIELDS])


def merge(t: pa.Table, least: int) -> pa.Table:
    """A bucket's answers: for each part's contexts their counts in all parts, the number and the sum of kept followers; for each follower its count, 0 if it isn't kept."""
    q = t.to_pylist()
    ctx = [unpack_sorted(r["x1"]) for r in q]
    cc, nf = ([unpack(r[x]) for r in q] for x in ("x2", "x3"))
    n = [int(x.sum()) for x in nf]
    word = [np.frombuffer(r["x4"], np.uint32, m).astype(np.uint64) << np.uint64(8) for r, m in zip(q, n)]
    for r, w, m in zip(q, word, n):
        if r["level"] == 1:
            w |= np.frombuffer(r["x4"], np.uint8, m, 4 * m).astype(np.uint64)
    fc = np.concatenate([unpack(r["x5"]) for r in q])
    all_ctx, inv = np.unique(np.concatenate(ctx), return_inverse=True)
    total = np.zeros(len(all_ctx), np.int64)
    np.add.at(total, inv, np.concatenate(cc))
    of = np.repeat(inv, np.concatenate(nf))
    key = mix(all_ctx[of] * np.uint64(P_WORD) + np.concatenate(word), 21)
    order = np.argsort(key)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.flatnonzero(first)
    sums = np.add.reduceat(fc[order], begin) if len(begin) else np.zeros(0, np.int64)
    kept = sums >= least
    owner = of[order[begin]][kept]
    k = np.bincount(owner, minlength=len(all_ctx))
    s = np.zeros(len(all_ctx), np.int64)
    np.add.at(s, owner, sums[kept])
    each = np.zeros(len(key), np.int64)
    each[order] = np.where(kept, sums, 0)[np.cumsum(first) - 1]
    rows, a, b = [], 0, 0
    for r, c, m in zip(q, ctx, n):
        i = inv[a : a + len(c)]
        counts = pack(total[i] if r["level"] == 1 else total[:0])  # pairs' counts are answered in the first round
        rows.append((r["level"], r["bucket"], r["part"], counts, pack(k[i]), pack(s[i]), pack(each[b : b + m]), b""))
        a, b = a + len(c), b + m
    return slices(rows)


def hear(t: pa.Table, level: int) -> list[np.ndarray]:
    """A part's answers of a level, in the order of its questions: counts, kept followers, their sum; the followers' counts."""
    got = sorted((r for r in t.to_pylist() if r["level"] == level), key=lambda r: r["bucket"])
    return [np.concatenate([unpack(r[x]) for r in got] or [np.zeros(0, np.int64)]) for x in FIELDS[:4]]


def ranked(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (below most) in order, the number of each key's and the counts: a key and its place are sorted as one number where both fit."""
    bits = len(key).bit_length()
    if int(most).bit_length() + bits > 64:
        return np.unique(key, return_inverse=True, return_counts=True)
    x = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    at, x = (x & np.uint64((1 << bits) - 1)).astype(np.int64), (x >> np.uint64(bits)).astype(np.int64)
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    begin, number = np.flatnonzero(first), np.empty(len(x), np.int64)
    number[at] = np.cumsum(first) - 1
    return x[begin], number, np.diff(np.append(begin, len(x)))


def ranked_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for hashes, which repeat much: they are numbered by a table and only the distinct ones sorted."""
    d = pa.array(h).dictionary_encode()
    each = d.dictionary.to_numpy()
    order = np.argsort(each)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[d.indices.to_numpy()]
    return each[order], number, np.bincount(number, minlength=len(order))


class Part:
    """The words, pairs and triples of a part's texts."""

    def __init__(self, col):
        h, self.n = word_hashes(col)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.words, self.at, self.times = ranked_hashes(h)
        v = max(1, len(self.words))
        i = np.flatnonzero(self.row[1:] == self.row[:-1])
        pairs, number, self.pair_times = ranked(self.at[i] * v + self.at[i + 1], v * v)
        self.pairs = pairs // v << 32 | pairs % v
        self.pair_of = np.full(len(h), -1)  # of the word at that place and the next one
        self.pair_of[i] = number

    def ask_pairs(self, part: int, bits: int) -> list[tuple]:
        followers = np.bincount(self.pairs >> 32, minlength=len(self.words))
        return ask(1, part, bits, self.words, self.times, followers, self.words[self.pairs & 0xFFFFFFFF], self.pair_times)

    def kept_triples(self, pair_total: np.ndarray) -> None:
        """Contexts (kept pairs that a word follows) by their hash, and triples of two kept pairs."""
        kept = np.append(pair_total > 0, False)
        i = np.flatnonzero(kept[self.pair_of[:-1]] & (self.pair_of[1:] >= 0)) if len(self.pair_of) else np.zeros(0, np.int64)
        of = np.unique(self.pair_of[i])
        i = i[kept[self.pair_of[i + 1]]]
        h = mix(self.words[self.pairs[of] >> 32] * np.uint64(P_WORD) + self.words[self.pairs[of] & 0xFFFFFFFF], 22)
        order = np.argsort(h)
        self.context, self.context_hash = of[order], h[order]
        number = np.zeros(len(self.pairs), np.int64)
        number[self.context] = np.arange(len(of))
        v = max(1, len(self.words))
        triples, at, self.triple_times = ranked(number[self.pair_of[i]] * v + self.at[i + 2], max(1, len(of)) * v)
        self.triples = triples // v << 32 | triples % v
        self.triple_of = np.full(len(self.at), -1, np.int32)  # of the word at that place and the two before
        self.triple_of[i + 2] = at

    def ask_triples(self, part: int, bits: int) -> list[tuple]:
        followers = np.bincount(self.triples >> 32, minlength=len(self.context))
        return ask(2, part, bits, self.context_hash, np.ones(len(self.context), np.int64), followers, self.words[self.triples & 0xFFFFFFFF], self.triple_times)

    def automaton(self, pairs: list[np.ndarray], triples: list[np.ndarray], size: int, discount: float) -> Automaton:
        """The slice of the automaton that the part's texts can reach."""
        total, k1, s1, c2 = pairs
        _, k2, s2, c3 = triples
        v = len(self.words)
        p1 = (total - discount) / max(1, size)
        b1 = 1 - (s1 - discount * k1) / np.maximum(total, 1)
        u, w = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        p2 = (c2 - discount) / np.maximum(total[u], 1) + b1[u] * p1[w]
        live = c2 > 0
        state2 = np.where(live, v + np.cumsum(live), -1)
        b2 = np.ones(len(self.pairs))
        b2[self.context] = 1 - (s2 - discount * k2) / np.maximum(c2[self.context], 1)
        t = np.flatnonzero(c3 > 0)
        h, w3 = self.context[self.triples[t] >> 32], self.triples[t] & 0xFFFFFFFF
        low = np.searchsorted(self.pairs, w[h] << 32 | w3)
        p3 = (c3[t] - discount) / c2[h] + b2[h] * p2[low]
        # Arcs of words and then of pairs: both in the order of their keys.
        key = np.concatenate([u[live] + 1 << 32 | w[live], state2[h] << 32 | w3])
        to, p = np.concatenate([state2[live], state2[low]]), np.log(np.concatenate([p2[live], p3]))
        bow = np.log(np.concatenate([[1.0], b1, b2[live]]))
        fail = np.concatenate([np.zeros(1 + v, np.int64), w[live] + 1])
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair_arc, triple_arc = np.full(len(self.pairs), -1), np.full(len(self.triples), -1)
        pair_arc[live], triple_arc[t] = np.split(place, [int(live.sum())])
        return Automaton(np.log(p1), key[order], to[order], p[order], bow, fail, state2, pair_arc, triple_arc)


class Automaton:
    """States: 0 is the empty context, 1 .. V are words, V + 1 .. are pairs.

    The failure arc of a pair leads to its last word; of a word, to the empty context. Arcs by (state, word): of word
    states to pairs, of pair states to the pair of their last two words.
    """

    def __init__(self, p1, key, to, p, bow, fail, pair_state, pair_arc, triple_arc):
        self.p1, self.key, self.to, self.p, self.bow, self.fail = p1, key, to, p, bow, fail
        #: The states of the part's pairs; -1 for those that aren't kept.
        self.pair_state = pair_state
        #: The arcs of the part's pairs and triples; -1 for those that have none.
        self.pair_arc, self.triple_arc = pair_arc, triple_arc

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities."""
        logp, after = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        todo, s, w = np.arange(len(state)), state, word
        while len(todo):
            base = s == 0
            k = todo[base]
            logp[k] += self.p1[w[base]]
            after[k] = w[base] + 1
            todo, s, w = todo[~base], s[~base], w[~base]
            at = find(self.key, s << 32 | w)
            hit = at >= 0
            logp[todo[hit]] += self.p[at[hit]]
            after[todo[hit]] = self.to[at[hit]]
            todo, s, w = todo[~hit], s[~hit], w[~hit]
            logp[todo] += self.bow[s]
            s = self.fail[s]
        return after, logp

    def score(self, part: Part) -> np.ndarray:
        """Log-probability of each text.

        The automaton is definite: whatever came before, after two words the state is that of the longest kept suffix of
        them. So the run of every text is laid out from left to right at once, and as the part knows the pair and the triple
        of every place by number, their arcs are looked up and not searched for.
        """
        p = np.zeros(len(part.at))
        pad = np.full(2, -1)
        pair_of = np.concatenate([pad, part.pair_of])  # of the words at two places before and one before
        for a in range(0, len(p), PLACES):
            b = min(len(p), a + PLACES)
            word, last, triple = part.at[a:b], pair_of[a + 1 : b + 1], part.triple_of[a:b]
            two = last >= 0  # the word isn't a text's first one
            state = np.full(b - a, -1)
            k = np.flatnonzero(two & (pair_of[a:b] >= 0))
            state[k] = self.pair_state[pair_of[a:b][k]]
            arc = np.full(b - a, -1)
            k = np.flatnonzero((state >= 0) & (triple >= 0))
            arc[k] = self.triple_arc[triple[k]]
            out = np.zeros(b - a)
            k = np.flatnonzero((state >= 0) & (arc < 0))
            out[k] = self.bow[state[k]]
            k = np.flatnonzero((arc < 0) & two)
            arc[k] = self.pair_arc[last[k]]
            k = k[arc[k] < 0]
            out[k] += self.bow[(part.pairs[last[k]] >> 32) + 1]
            k = np.flatnonzero(arc < 0)
            out[k] += self.p1[word[k]]
            k = np.flatnonzero(arc >= 0)
            out[k] += self.p[arc[k]]
            p[a:b] = out
        return np.bincount(part.row, weights=p, minlength=len(part.n))


def corpus_size(docs: DataFrame) -> int:
    """The number of words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(spans(*text_bytes(b.column(0)))[2].sum())])], ["n"])

    return docs.select("text").transform(map_arrow, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def lm_scores(docs: DataFrame, min_count: int = MIN_COUNT, discount: float = DISCOUNT, part: int = PART, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, logprob, mean_logprob) of every row."""
    need(docs, "doc_id", "text")
    d = docs.select(integer_id(docs, "doc_id").alias("doc_id"), "text")
    size = corpus_size(d)
    parts = max(1, math.ceil(6 * size / part))
    if parts > FEW:
        parts = int(FEW * math.sqrt(parts / FEW))
    bits = min(int(math.log2(MOST_BUCKETS)), max(0, math.ceil(math.log2(max(1, size / bucket)))))
    d = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text").repartition("part")

    def first(t: pa.Table) -> pa.Table:
        return slices(Part(t.column("text")).ask_pairs(t.column("part")[0].as_py(), bits))

    def second(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return slices([])
        number, own = t.column("part")[0].as_py(), Part(t.column("text"))
        own.kept_triples(hear(back, 1)[3])
        return slices(own.ask_triples(number, bits))

    def last(t: pa.Table, back: pa.Table) -> pa.Table:
        own = Part(t.column("text"))
        pairs, triples = hear(back, 1), hear(back, 2)
        own.kept_triples(pairs[3])
        score, none = own.automaton(pairs, triples, size, discount).score(own), own.n == 0
        return pa.Table.from_arrays(
            [t.column("doc_id"), pa.array(own.n.astype(np.int64)), pa.array(np.round(score, 4), mask=none), pa.array(np.round(score / np.maximum(own.n, 1), 6), mask=none)], ["doc_id", "n_words", "logprob", "mean_logprob"]
        )

    add = lambda t: merge(t, min_count)
    by = lambda x: x.groupBy("part")
    pairs = by(d).applyInArrow(lean_group(first), SLICE).groupBy("bucket").applyInArrow(add, SLICE).repartition("part")
    triples = by(d).cogroup(by(pairs)).applyInArrow(lean_group(second), SLICE).groupBy("bucket").applyInArrow(add, SLICE).repartition("part")
    # The union keeps its parts' partitioning, so the answers of the first round aren't shuffled again.
    return by(d).cogroup(by(pairs.unionAll(triples))).applyInArrow(lean_group(last), "doc_id long, n_words long, logprob double, mean_logprob double")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LM_SQL = f"""
WITH tok AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
seq AS (SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok)),
size AS (SELECT count(*)::double AS n FROM seq),
p1 AS (SELECT w, count(*)::double AS c, (count(*) - {DISCOUNT}::double) / any_value(n) AS p FROM seq, size GROUP BY w),
k2 AS (SELECT v, w, count(*)::double AS c FROM seq WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {MIN_COUNT}),
b1 AS (SELECT v, 1 - (sum(k2.c) - {DISCOUNT}::double * count(*)) / any_value(p1.c) AS b FROM k2 JOIN p1 ON p1.w = k2.v GROUP BY v),
p2 AS (SELECT k2.v, k2.w, k2.c, (k2.c - {DISCOUNT}::double) / a.c + b1.b * z.p AS p FROM k2 JOIN p1 a ON a.w = k2.v JOIN b1 ON b1.v = k2.v JOIN p1 z ON z.w = k2.w),
k3 AS (SELECT u, v, w, count(*)::double AS c FROM seq WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= {MIN_COUNT}),
b2 AS (SELECT u, k3.v, 1 - (sum(k3.c) - {DISCOUNT}::double * count(*)) / any_value(k2.c) AS b FROM k3 JOIN k2 ON k2.v = k3.u AND k2.w = k3.v GROUP BY u, k3.v),
p3 AS (SELECT k3.u, k3.v, k3.w, (k3.c - {DISCOUNT}::double) / a.c + b2.b * z.p AS p FROM k3 JOIN k2 a ON a.v = k3.u AND a.w = k3.v JOIN b2 ON b2.u = k3.u AND b2.v = k3.v JOIN p2 z ON z.v = k3.v AND z.w = k3.w),
each AS (
  SELECT s.r, CASE
    WHEN p3.p IS NOT NULL THEN ln(p3.p)
    WHEN p2.p IS NOT NULL THEN ln(coalesce(b2.b, 1)) + ln(p2.p)
    ELSE ln(coalesce(b2.b, 1)) + ln(coalesce(b1.b, 1)) + ln(p1.p) END AS lp
  FROM seq s
  LEFT JOIN p1 ON p1.w = s.w LEFT JOIN p2 ON p2.v = s.v AND p2.w = s.w LEFT JOIN p3 ON p3.u = s.u AND p3.v = s.v AND p3.w = s.w
  LEFT JOIN b1 ON b1.v = s.v LEFT JOIN b2 ON b2.u = s.u AND b2.v = s.v)
SELECT doc_id, coalesce(n, 0)::bigint AS n_words, round(lp, 4) AS logprob, round(lp / n, 6) AS mean_logprob
FROM tok LEFT JOIN (SELECT r, count(*) AS n, sum(lp) AS lp FROM each GROUP BY r) USING (r)
"""
