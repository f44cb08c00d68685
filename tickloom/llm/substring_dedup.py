"""Substring dedup: passages of `window` words or more that occur twice or more.

A document's windows are all runs of `window` consecutive words (anything between white
space). Most windows occur once, so a count-min sketch goes before the exact count.

Sketch. Documents are spread over parts by a hash. Each part counts its windows in two
rows of a count-min sketch, kept sparse: its sorted cells as differences of a dozen bits or so each. The parts' sketches are merged
block by block, a block range by range; each part gets back a bit for every cell it sent: whether all parts
together have counted it twice or more. Nothing is broadcast.
Second pass. Windows estimated twice or more in both rows are grouped exactly by 96 bits of hash. A part sends a row for each
distinct one, however often it holds it, so a window that very many documents share is one row a part.
Estimates are never too low, so no repeated window is lost.
The counts go back to the parts, which join overlapping windows to passages. A passage ends where the
first document of its windows changes, so that each has one keeper; passages then overlap by up to window - 1 words.

Defined cases: documents with a null text or fewer than `window` words have no passage; every row is a document of its own,
so rows repeated in full and rows of equal ids share passages; a passage that a document repeats within itself counts, and is first at its first
place only; null ids take part and come last when the first document is chosen (first_doc_id is null where all are); equal ids
are ordered by part and text; other columns are ignored; an empty table gives no rows.

A clean document is reported too where it shares a passage: the synthetic tables have licence lines and benchmark passages in clean ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import IS_TOKEN, P_WORD, integer_id, lean_group, mix, need, prefix_sums, quoted, span_hash, word_hashes

WINDOW = 50
#: Bytes of text in a part (parts grow with the square root of the corpus beyond FEW of them); cells for each window in each row of the sketch; cells in a block.
PART, FEW, CELLS, BLOCK = 8 << 20, 4096, 4, 1 << 22
#: Most blocks of a row: beyond it the blocks grow, and are merged by ranges of BLOCK cells.
MOST_BLOCKS = 1 << 15
BASES = (P_WORD, 0xD6E8FEB86659FD93)
NONE = (1 << 63) - 1


def windows_of(words: np.ndarray, rows: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and whether it lies in one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n)
    return mix(span_hash(prefix_sums(words, base), at, at + k, base), k), rows[k - 1 :] == rows[:n]


def cells_of(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(h, 101 + row) % np.uint64(width)).astype(np.int64)


def low_bits(n: int, block: int) -> int:
    """How many low bits of a difference are written as they are: about those of the usual difference."""
    return max(0, int(math.log2(max(1, 0.69 * block / max(1, n)))))


def pack_sorted(cells: np.ndarray, block: int) -> bytes:
    """Sorted distinct numbers below `block` as Golomb-Rice codes of their differences: some 1.5 bits above the entropy of the usual difference."""
    d, k = np.diff(cells, prepend=-1) - 1, low_bits(len(cells), block)
    end = np.cumsum((d >> k) + 1)
    high = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    high[end - 1] = 1
    low = (d[:, None] >> np.arange(k) & 1).astype(np.uint8)
    return np.packbits(low.ravel()).tobytes() + np.packbits(high).tobytes()


def unpack_sorted(b: bytes, n: int, block: int) -> np.ndarray:
    k = low_bits(n, block)
    size = -(-n * k // 8)
    low = np.unpackbits(np.frombuffer(b, np.uint8, size), count=n * k).reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    end = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, offset=size)))[:n]
    return np.cumsum((np.diff(end, prepend=-1) - 1 << k) + low + 1) - 1


def merge_cells(cells: list[np.ndarray], more: list[np.ndarray], block: int, step: int = BLOCK) -> list[np.ndarray]:
    """Whether each cell of each list is counted twice or more by all lists together; a range of `step` cells at a time."""
    out = [np.zeros(len(c), dtype=bool) for c in cells]
    for lo in range(0, block, step):
        total = np.zeros(min(step, block - lo), dtype=np.uint8)
        cut = [np.searchsorted(c, (lo, lo + step)) for c in cells]
        for c, m, (a, z) in zip(cells, more, cut):
            at = c[a:z] - lo
            total[at] = np.minimum(total[at] + 1 + m[a:z], 2)  # a list's cells are distinct
        for c, o, (a, z) in zip(cells, out, cut):
            o[a:z] = total[c[a:z] - lo] > 1
    return out


def passages(at: np.ndarray, row: np.ndarray, copies: np.ndarray, first: np.ndarray, is_first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of repeated windows (sorted by row and place) with the same keeper that overlap or touch: first window, last window, and most copies of each."""
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window) | (first[1:] != first[:-1]) | (is_first[1:] != is_first[:-1])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(at)) - 1, np.maximum.reduceat(copies, begin)


def substring_duplicates(docs: DataFrame, window: int = WINDOW, part: int = PART, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, copies, first_doc_id, is_first) of each repeated passage.

    copies: the most occurrences of a window in it; first_doc_id: the least id that has its windows; is_first: these are
    their first occurrences, so the passage stays where the others go.
    """
    need(docs, text, doc_id)
    d = docs.select(integer_id(docs, doc_id).alias("doc_id"), F.col(quoted(text)).alias("text")).where("text is not null")
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part))
    if parts > FEW:
        parts = int(FEW * math.sqrt(parts / FEW))
    width = max(1 << 12, CELLS * (size // 6))
    block = max(min(BLOCK, width), -(-width // MOST_BLOCKS))
    width = -(-width // block) * block
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).select("part", "doc_id", "text").repartition("part")

    def read(t: pa.Table) -> tuple[np.ndarray, ...]:
        """Words' rows, the windows' hashes, and where the windows that lie in a row begin."""
        words, n = word_hashes(t.column("text"), lower=False, kind=IS_TOKEN)
        rows = np.repeat(np.arange(len(n)), n)
        h, inside = windows_of(words, rows, window, BASES[0])
        return words, rows, n, h, np.flatnonzero(inside)

    def counted(h: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, n = np.unique(cells_of(h, row, width), return_counts=True)
        return cells, n > 1, np.searchsorted(cells, np.arange(0, width + 1, block))

    def sketch(t: pa.Table) -> pa.Table:
        number, (*_, h, on) = t.column("part")[0].as_py(), read(t)
        out = []
        for row in (0, 1):
            cells, more, begin = counted(h[on], row)
            for k in np.flatnonzero(np.diff(begin)):
                s = slice(begin[k], begin[k + 1])
                out.append((row, int(k), number, int(begin[k + 1] - begin[k]), pack_sorted(cells[s] - k * block, block), np.packbits(more[s]).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["row", "block", "part", "n", "cells", "more"])

    def merge(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        cells = [unpack_sorted(b, k, block) for b, k in zip(t.column("cells").to_pylist(), n)]
        more = [np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(t.column("more").to_pylist(), n)]
        back = [np.packbits(x).tobytes() for x in merge_cells(cells, more, block)]
        return pa.Table.from_arrays([t.column("part").combine_chunks(), t.column("row").combine_chunks(), t.column("block").combine_chunks(), pa.array(back, pa.binary())], ["part", "row", "block", "twice"])

    def emit(t: pa.Table, back: pa.Table) -> pa.Table:
        """A row for each distinct window of the part that is estimated twice or more in both rows of the sketch."""
        if not t.num_rows or not back.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())], ["w1", "w2", "part", "n", "id"])
        words, rows, n, h, every = read(t)
        on = every
        row, blk, blobs = back.column("row").to_numpy(), back.column("block").to_numpy(), back.column("twice").to_pylist()
        for k in (0, 1):
            cells, _, begin = counted(h[every], k)
            twice = np.zeros(len(cells), dtype=bool)
            for i in np.flatnonzero(row == k):
                a, z = begin[blk[i]], begin[blk[i] + 1]
                twice[a:z] = np.unpackbits(np.frombuffer(blobs[i], np.uint8), count=z - a)
            if len(on):
                on = on[twice[np.searchsorted(cells, cells_of(h[on], k, width))]]
        w1, at, n = np.unique(h[on], return_index=True, return_counts=True)
        w2 = windows_of(words, rows, window, BASES[1])[0][on[at]]
        known = ids_of(t)
        low = np.full(len(w1), NONE)
        np.minimum.at(low, np.searchsorted(w1, h[on]), known[rows[on]])
        return pa.Table.from_arrays(
            [pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(len(w1), t.column("part")[0].as_py(), np.int32)), pa.array(n.astype(np.int32)), pa.array(low)], ["w1", "w2", "part", "n", "id"]
        )

    def ids_of(t: pa.Table) -> np.ndarray:
        return t.column("doc_id").fill_null(NONE).to_numpy()

    def report(t: pa.Table, back: pa.Table) -> pa.Table:
        """The part's passages, from its windows that all parts together hold twice or more."""
        names = ["doc_id", "start_word", "end_word", "n_words", "copies", "first_doc_id", "is_first"]
        kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.bool_()]
        if not t.num_rows or not back.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        _, rows, n, h, on = read(t)
        back = back.sort_by("w1")
        w1, copies, first, home = (back.column(c).to_numpy() for c in ("w1", "copies", "first", "home"))
        h = h.view(np.int64)
        k = np.minimum(np.searchsorted(w1, h[on]), len(w1) - 1)
        hit = w1[k] == h[on]
        on, k = on[hit], k[hit]
        r = rows[on]
        at = on - (np.cumsum(n) - n)[r]
        # The first occurrence of a window in the part: the least id, then text, then place.
        digest = np.array([xxhash.xxh64_intdigest(x) for x in t.column("text").to_pylist()], dtype=np.uint64)
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((digest, ids_of(t)))] = np.arange(len(n))
        order = np.lexsort((at, rank[r], k))
        lead = np.zeros(len(on), dtype=bool)
        lead[order[np.flatnonzero(np.diff(k[order], prepend=-1))]] = True
        lead &= home[k] == t.column("part")[0].as_py()
        begin, end, most = passages(at, r, copies[k], first[k], lead, window)
        keeper, ids = first[k][begin], ids_of(t)[r[begin]]
        return pa.Table.from_arrays(
            [pa.array(ids, mask=ids == NONE), pa.array(at[begin].astype(np.int32)), pa.array((at[end] + window).astype(np.int32)), pa.array((at[end] + window - at[begin]).astype(np.int32)), pa.array(most), pa.array(keeper, mask=keeper == NONE), pa.array(lead[begin])],
            names,
        )

    by = lambda x: x.groupBy("part")
    merged = by(d).applyInArrow(lean_group(sketch), "row int, block int, part int, n int, cells binary, more binary").groupBy("row", "block").applyInArrow(lean_group(merge), "part int, row int, block int, twice binary")
    found = by(d).cogroup(by(merged)).applyInArrow(lean_group(emit), "w1 long, w2 int, part int, n int, id long")
    same = Window.partitionBy("w1", "w2")
    least = F.min(F.struct("id", "part")).over(same)
    repeated = found.withColumn("copies", F.sum("n").over(same)).withColumn("least", least).where("copies > 1").select("part", "w1", "copies", F.col("least.id").alias("first"), F.col("least.part").alias("home"))
    return by(d).cogroup(by(repeated)).applyInArrow(lean_group(report), "doc_id long, start_word int, end_word int, n_words int, copies long, first_doc_id long, is_first boolean")


SUBSTRING_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i + 1, i + {WINDOW}), ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})),
c AS (SELECT r, doc_id, i, count(*) OVER s AS copies, min(doc_id) OVER s AS first_doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, r, i) = 1 AS is_first FROM g WINDOW s AS (PARTITION BY g)),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER o + {WINDOW} AND first_doc_id IS NOT DISTINCT FROM lag(first_doc_id) OVER o AND is_first = lag(is_first) OVER o THEN 0 ELSE 1 END AS new FROM c WHERE copies > 1 WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS p FROM n)
SELECT doc_id, min(i)::int AS start_word, (max(i) + {WINDOW})::int AS end_word, (max(i) + {WINDOW} - min(i))::int AS n_words, max(copies)::bigint AS copies, any_value(first_doc_id) AS first_doc_id, any_value(is_first) AS is_first
FROM p GROUP BY r, doc_id, p
"""
