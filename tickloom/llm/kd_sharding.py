"""Sharding by k-d tree partitioning of documents' metadata.

A node holding more than `target` bytes is split at the weighted median (weights: bytes of
text) of its widest dimension, until leaves are within the target or can't be split. Points (dimensions and bytes, no text) are written once.

The top of the tree, nodes of more than `most_points` points, grows a level at a time for all nodes together: a level sends the points
down the tree so far and reduces them, first to each node's extents and bytes, then to the exact weighted
median by refining ranges: each round sums the bytes of at most 1,024 equal ranges of the one in which the
median lies. What comes to the driver is a row per open node, so at most one for each `most_points` points, not one a shard; the
top's arrays are sent to the tasks. Below, each node's points go to one task, which splits them to the end by the same rule; what it does and holds
is bounded by `most_points`. Shards are numbered by the tasks' numbers of shards, from left to right.

Dimensions are integers: a text's length; the seeded hashes of language and source, so equal values stay together; and
the id, which can split what the others can't. Extents are compared relative to the whole table's; ties go to
the earlier dimension. Points at most the median go left; where that takes all, those of the greatest value go right.

Defined cases: null values count as the least, -1; null texts have 0 bytes and length; equal rows can't be told apart and share a
leaf, even beyond the target; ids are integers, those beyond 48 bits are folded; other columns are ignored; an empty table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import integer_id, map_arrow, materialise, need

TARGET = 16 << 20
#: A node of at most so many points is split to the end by one task.
MOST_POINTS = 1 << 17
RANGES = 1024


def dimensions() -> dict[str, Column]:
    fold = F.lit((1 << 48) - 1).cast("bigint")
    hashed = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFF).cast("bigint"))), F.lit(-1).cast("bigint"))
    return {"length": F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint"), "lang": hashed("lang"), "source": hashed("source"), "id": F.coalesce(F.col("doc_id").cast("bigint").bitwiseAND(fold), F.lit(-1).cast("bigint"))}


class Tree:
    """Node k is split by dimension dim[k] at value cut[k]: points up to it go to left[k], others to left[k] + 1. Leaves have dim -1."""

    def __init__(self):
        self.dim, self.cut, self.left = [-1], [0], [-1]

    def split(self, k: int, dim: int, cut: int) -> None:
        self.dim[k], self.cut[k], self.left[k] = dim, cut, len(self.dim)
        self.dim += [-1, -1]
        self.cut += [0, 0]
        self.left += [-1, -1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim), np.array(self.cut, dtype=np.int64), np.array(self.left)

    def shards(self) -> np.ndarray:
        """The leaves' numbers from left to right; -1 for inner nodes."""
        out, stack, n = np.full(len(self.dim), -1), [0], 0
        while stack:
            k = stack.pop()
            if self.dim[k] < 0:
                out[k], n = n, n + 1
            else:
                stack += [self.left[k] + 1, self.left[k]]
        return out


def descend(points: np.ndarray, dim: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each point (rows: dimensions)."""
    at = np.zeros(points.shape[1], dtype=np.int64)
    live = np.arange(points.shape[1])
    while len(live):
        live = live[dim[at[live]] >= 0]
        k = at[live]
        at[live] = left[k] + (points[dim[k], live] > cut[k])
    return at


def _ints(b: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(n)]) if b.num_rows else np.zeros((n, 0), np.int64)


def _extents(points: DataFrame, tree: Tree, n: int) -> dict[int, tuple[int, np.ndarray, np.ndarray, int]]:
    """Bytes, least and greatest values, and number of points of each leaf that has some."""
    t = points.sparkSession.sparkContext.broadcast(tree.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _ints(b, n + 1)
            at = descend(x[:n], *t.value)
            o = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[o], prepend=-1))
            if len(first):
                cols = [at[o][first], np.add.reduceat(x[n][o], first)]
                cols += [f.reduceat(x[k][o], first) for f in (np.minimum, np.maximum) for k in range(n)]
                cols.append(np.diff(np.append(first, len(at))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "bytes", *[f"lo{k}" for k in range(n)], *[f"hi{k}" for k in range(n)], "points"])

    schema = "node long, bytes long, " + ", ".join(f"{e}{k} long" for e in ("lo", "hi") for k in range(n)) + ", points long"
    aggs = [F.sum("bytes").alias("bytes"), *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(n)], *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(n)], F.sum("points").alias("points")]
    return {r[0]: (r[1], np.array(r[2 : 2 + n]), np.array(r[2 + n : -1]), r[-1]) for r in points.transform(map_arrow, run, schema).groupBy("node").agg(*aggs).collect()}


def _ranges(points: DataFrame, tree: Tree, n: int, ask: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int | None]]:
    """For each asked node (dimension, least, width of a range): the range in which half the bytes are reached, its greatest value, and the greatest value before it."""
    size = len(tree.dim)
    dim, lo, width = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for k, (a, b, c) in ask.items():
        dim[k], lo[k], width[k] = a, b, c
    t = points.sparkSession.sparkContext.broadcast((*tree.arrays(), dim, lo, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *shape, dim, lo, width = t.value
        for b in batches:
            x = _ints(b, n + 1)
            at = descend(x[:n], *shape)
            on = np.flatnonzero(width[at] > 0)
            at, v, w = at[on], x[dim[at[on]], on], x[n][on]
            r = np.clip((v - lo[at]) // width[at], -1, RANGES)
            o = np.lexsort((r, at))
            at, r, v, w = at[o], r[o], v[o], w[o]
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(r, prepend=-2) != 0))
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at[first], r[first], np.add.reduceat(w, first), np.maximum.reduceat(v, first))], ["node", "r", "w", "v"])

    by = Window.partitionBy("node").orderBy("r")
    sums = points.transform(map_arrow, run, "node long, r long, w long, v long").groupBy("node", "r").agg(F.sum("w").alias("w"), F.max("v").alias("v"))
    sums = sums.withColumn("upto", F.sum("w").over(by)).withColumn("all", F.sum("w").over(Window.partitionBy("node"))).withColumn("before", F.max("v").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    half = sums.where("2 * upto >= all and 2 * (upto - w) < all")
    return {r[0]: (r[1], r[2], r[3]) for r in half.select("node", "r", "v", "before").collect()}


def split_points(x: np.ndarray, b: np.ndarray, target: int, whole: np.ndarray) -> np.ndarray:
    """The leaf of each point (rows: dimensions) of one node, numbered from left to right."""
    out, stack, n = np.zeros(x.shape[1], np.int64), [np.arange(x.shape[1])], 0
    while stack:
        ix = stack.pop()
        share = (x[:, ix].max(axis=1) - x[:, ix].min(axis=1)) / whole
        if b[ix].sum() <= target or share.max() <= 0:
            out[ix], n = n, n + 1
            continue
        v = x[int(share.argmax()), ix]
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(b[ix][order])
        cut = v[order][np.searchsorted(2 * upto, upto[-1])]
        if cut == v.max():
            cut = v[v < cut].max()
        stack += [ix[v > cut], ix[v <= cut]]
    return out


def grow(points: DataFrame, n: int, target: int, most_points: int = 0) -> tuple[Tree, np.ndarray | None]:
    """The tree of nodes of more than most_points points, and the whole table's extents. points: n integer columns, then bytes."""
    tree, done, whole = Tree(), set(), None
    while True:
        seen = _extents(points, tree, n)
        if whole is None:
            if not seen:
                return tree, None
            whole = np.maximum(seen[0][2] - seen[0][1], 1)
        split = {}
        for k, (size, lo, hi, held) in seen.items():
            if size > target and held > most_points and k not in done:
                share = (hi - lo) / whole
                if share.max() > 0:
                    d = int(share.argmax())
                    split[k] = [d, int(lo[d]), int(hi[d]), size]
                else:
                    done.add(k)
        if not split:
            return tree, whole
        cuts: dict[int, int] = {}
        span = {k: (lo, hi) for k, (d, lo, hi, _) in split.items()}
        top = {k: hi for k, (_, _, hi, _) in split.items()}
        while span:
            ask = {k: (split[k][0], lo, -(-(hi - lo + 1) // RANGES)) for k, (lo, hi) in span.items()}
            got = _ranges(points, tree, n, ask)
            for k, (_, lo, width) in ask.items():
                r, v, before = got[k]
                if width > 1:
                    span[k] = (lo + r * width, lo + (r + 1) * width - 1)
                else:
                    # A median that is the greatest value goes right with its equals, what is before it left.
                    cuts[k] = v if v < top[k] else before
                    del span[k]
        for k in sorted(cuts):
            tree.split(k, split[k][0], cuts[k])


def kd_shards(docs: DataFrame, target: int = TARGET, dims: dict[str, Column] | None = None, most_points: int = MOST_POINTS) -> DataFrame:
    """(doc_id, shard, bytes) of every row; shards are numbered from left to right in the tree."""
    need(docs, "doc_id", "text", "lang", "source")
    integer_id(docs)
    dims = dims or dimensions()
    n = len(dims)
    points = docs.select(*[c.alias(f"d{k}") for k, c in enumerate(dims.values())], F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), F.col("doc_id").cast("bigint").alias("doc_id"))
    points = materialise(points, "kd-points")
    tree, whole = grow(points.drop("doc_id"), n, target, most_points)
    spark = points.sparkSession
    if whole is None:
        return spark.createDataFrame([], "doc_id long, shard int, bytes long")
    t = spark.sparkContext.broadcast((tree.arrays(), tree.shards()))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, shards = t.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shards[descend(_ints(b, n), *shape)].astype(np.int32)), *b.columns], ["top", *b.schema.names])

    def below(g: pa.Table) -> pa.Table:
        x = np.stack([g.column(f"d{k}").to_numpy() for k in range(n)])
        own = split_points(x, g.column("bytes").to_numpy(), target, whole)
        return pa.Table.from_arrays([g.column("doc_id"), g.column("top"), pa.array(own.astype(np.int32)), g.column("bytes")], ["doc_id", "top", "own", "bytes"])

    kinds = ", ".join(f"d{k} long" for k in range(n))
    split = points.transform(map_arrow, leaf, f"top int, {kinds}, bytes long, doc_id long").groupBy("top").applyInArrow(below, "doc_id long, top int, own int, bytes long")
    split = materialise(split, "kd-split")
    sizes = sorted(map(tuple, split.groupBy("top").agg(F.max("own") + 1).collect()))  # a row for each node of the top's lowest level
    first = np.concatenate([[0], np.cumsum([k for _, k in sizes])])
    offsets = spark.createDataFrame([(top, int(o)) for (top, _), o in zip(sizes, first)], "top int, first int")
    return split.join(F.broadcast(offsets), "top").select("doc_id", (F.col("own") + F.col("first")).alias("shard"), "bytes")
