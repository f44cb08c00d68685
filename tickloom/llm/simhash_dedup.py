"""Near-dedup by 128-bit SimHash and BK-trees.

A document's fingerprint has the signs of the sums of its distinct words' and word pairs'
hash bits. Equal fingerprints are one node. Nodes are spread over shards: one for each of TABLES
seeded choices of PICKS of the document's BINS least hashes (of its features, one permutation in BINS bins,
empty bins taking the next one's) and each value of these. Two documents that share a part J of their features meet in a
table with chance J^PICKS. Bits of the fingerprint would do for a small radius only: at 27 of 128, 16 of them agree with
chance 0.02, as they do for unrelated texts. At 27 bits the features' cosine is about 0.79 and J about 0.65, so 24 tables
miss fewer than one pair in a thousand at that J; texts whose distance is less than their features say are missed more often.
From 2^20 documents on, PICKS and with them TABLES grow with the logarithm of their number, so that unrelated documents
meet as rarely as before and the chance of missing a pair stays the same.
Every shard with two nodes or more becomes a BK-tree,
children keyed by their Hamming distance to the parent, and every node of the shard is a
query that follows only the edges within the radius of its distance to the parent.
The shuffle sends a shard's tree to where its queries are. Broadcasting all trees to all
queries would grow with the data and compare far pairs, so it isn't done. A shard of more than SLICE nodes goes to several
tasks, its queries in slices: each searches the whole tree for its own.

Building and searching go level by level over all shards of an Arrow batch at once.
A shard emits one edge per node, to the least node of those it is linked with; the edges'
connected components (alternating large and small stars, with the edges written
between the rounds) are the groups.

Defined cases: null and empty texts and texts without a word are near nothing; rows
without an id are kept and not searched; rows with equal ids are one document, so all of them stay or go; the least id of a group stays;
ids are integers; other columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitmaps import bitmap_of, bits_for, mark
from tickloom.llm.shared import P_WORD, columns, discard, integer_id, map_arrow, materialise, mix, need, numbered, prefix_sums, quoted, span_hash, word_hashes

RADIUS, PICKS, BINS = 27, 3, 64
#: The J at which a pair is missed with chance MISSED; documents up to which PICKS are enough; by how much more documents need one more (the J of unrelated texts is below 1 / GROWTH).
LEAST_J, MISSED, FEW, GROWTH = 0.65, 4.6e-4, 1 << 20, 8
#: Queries of a shard that one task searches for.
SLICE = 4096
#: Near copies on sf0.1 lie at 4 to 27 bits and unrelated texts from about 31 on; texts of under SHORT_WORDS words reach into the gap, so theirs is the smaller radius.
SHORT_WORDS, SHORT_RADIUS = 16, 18
#: Pairs of query and node followed at a time.
FRONTIER = 1 << 20


#: A byte's bits, each in a byte of its own of 64 bits: up to 255 of these can be summed without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).copy().view(np.uint64)[:, 0]


def features_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row above 54 bits of the hash of each row's distinct features, sorted; number of words) of 1,024 texts at most."""
    h, n = word_hashes(col)
    rows = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    two = np.flatnonzero(rows[1:] == rows[:-1])
    pair = mix(span_hash(prefix_sums(h, P_WORD), two, two + 2, P_WORD), 2)
    # Distinct features of each row by one sort: the row above 54 bits of the hash.
    key = np.sort(np.concatenate([rows << np.uint64(54) | h >> np.uint64(10), rows[two] << np.uint64(54) | pair >> np.uint64(10)]))
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    return key[first], n


def fingerprints_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 words of 64 bits, number of words) for each text; 1,024 texts at most."""
    key, n = features_of(col)
    return signs(key, len(n)), n


def signs(key: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of n rows from their features."""
    out = np.zeros((n, 2), dtype=np.uint64)
    if not len(key):
        return out
    rows = (key >> np.uint64(54)).astype(np.int64)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    size = np.diff(np.append(starts, len(key)))
    inside = np.arange(len(key)) - np.repeat(starts, size)
    chunks = np.flatnonzero(inside % 255 == 0)
    docs = np.searchsorted(chunks, starts)
    for word in (0, 1):
        sums = np.empty((len(chunks), 8), dtype=np.uint64)
        hashed = mix(key << np.uint64(10), 11 + word).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums[:, k] = np.add.reduceat(LANES[hashed[:, k]], chunks)
        total = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), docs, axis=0, dtype=np.int32)
        out[rows[starts], word] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def picks_for(docs: int) -> int:
    return PICKS + max(0, math.ceil(math.log(max(1, docs) / FEW, GROWTH)))


def tables_for(picks: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - LEAST_J**picks))


@lru_cache
def _picks(picks: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(4711))
    return np.stack([np.sort(rng.permutation(BINS)[:picks]) for _ in range(tables_for(picks))])


def shard_keys(key: np.ndarray, n: int, picks: int = PICKS) -> np.ndarray:
    """n x tables shard numbers from the rows' features: a hash of the table and of its least hashes."""
    none = np.uint64((1 << 64) - 1)
    x = mix(key << np.uint64(10), 77)
    least = np.full(n * BINS, none, dtype=np.uint64)
    np.minimum.at(least, (key >> np.uint64(54)).astype(np.int64) * BINS + (x >> np.uint64(58)).astype(np.int64), x)
    least = least.reshape(n, BINS)
    at = np.where(np.hstack([least, least]) != none, np.arange(2 * BINS), 2 * BINS)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    least = np.take_along_axis(least, at, axis=1)
    out = np.tile(np.arange(tables_for(picks), dtype=np.uint64), (n, 1))
    for k in _picks(picks).T:
        out = mix(out ^ least[:, k], 78)
    return out


def _fingerprint_batches(picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(1, b.num_rows), 1000):
                part = b.slice(k, 1000)
                key, n = features_of(part.column(1))
                f, on = signs(key, len(n)), n > 0
                keys = shard_keys(key, len(n), picks)[on].view(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(on)), pa.array(f[on, 0].view(np.int64)), pa.array(f[on, 1].view(np.int64)), pa.array(n[on] < SHORT_WORDS), keys], ["doc_id", "f0", "f1", "short", "shards"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, f0, f1, short, shards) of the documents that have an id and a word; short: under SHORT_WORDS words."""
    need(docs, text, doc_id)
    d = docs.select(integer_id(docs, doc_id).alias("doc_id"), F.col(quoted(text)).alias("text")).where("doc_id is not null and text is not null")
    return d.transform(map_arrow, _fingerprint_batches(picks_for(docs.count())), "doc_id long, f0 long, f1 long, short boolean, shards array<long>")


def distance(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a0 ^ b0).astype(np.int32) + np.bitwise_count(a1 ^ b1).astype(np.int32)


def build_trees(tree: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over the rows, one for each value of `tree` (sorted); the first row of a tree is its root.

    Gives each row's parent (itself for a root) and its distance to it. Level by level: of the rows that reach the
    same edge of the same parent, the first becomes the child and the others go on below it.
    """
    n = len(tree)
    parent, edge = np.arange(n), np.zeros(n, dtype=np.int32)
    if n == 0:
        return parent, edge, np.zeros(0, np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = tree[1:] != tree[:-1]
    roots = np.flatnonzero(first)
    at = roots[np.cumsum(first) - 1]
    left = np.flatnonzero(~first)
    at = at[left]
    while len(left):
        d = distance(f0[left], f1[left], f0[at], f1[at])
        order = np.lexsort((left, d, at))
        left, at, d = left[order], at[order], d[order]
        new = np.ones(len(left), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
        child = left[new][np.cumsum(new) - 1]
        parent[left[new]], edge[left[new]] = at[new], d[new]
        left, at = left[~new], child[~new]
    return parent, edge, roots


def search_trees(tree: np.ndarray, f0: np.ndarray, f1: np.ndarray, radius: int | np.ndarray, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same tree within the radius: every row (or those in `queries`) is a query; a pair comes once, the later row first. Rows may have radii of their own: a pair is within the lesser."""
    parent, edge, roots = build_trees(tree, f0, f1)
    n = len(tree)
    if n == 0:
        return
    radii = np.broadcast_to(np.asarray(radius, dtype=np.int32), n)
    kids = np.flatnonzero(parent != np.arange(n))
    key = parent[kids] * np.int64(256) + edge[kids]
    order = np.argsort(key, kind="stable")
    kids, key = kids[order], key[order]
    root_of = np.repeat(roots, np.diff(np.append(roots, n)))
    every = np.arange(n) if queries is None else queries
    stack = [(every[a : a + FRONTIER], root_of[every[a : a + FRONTIER]]) for a in range(0, len(every), FRONTIER)]
    while stack:
        q, at = stack.pop()
        d = distance(f0[q], f1[q], f0[at], f1[at])
        hit = (d <= np.minimum(radii[q], radii[at])) & (q > at)
        if hit.any():
            yield q[hit], at[hit]
        lo = np.searchsorted(key, at * np.int64(256) + np.maximum(d - radii[q], 0))
        n_kids = np.searchsorted(key, at * np.int64(256) + np.minimum(d + radii[q], 255), "right") - lo
        cum = np.cumsum(n_kids)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(cum, (cum[a - 1] if a else 0) + FRONTIER, "right")))
            m = n_kids[a:b]
            if m.any():
                inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                stack.append((np.repeat(q[a:b], m), kids[np.repeat(lo[a:b], m) + inside]))
            a = b


def least_linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's connected component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _edge_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(0)
            size = m.value_lengths().to_numpy(zero_copy_only=False)
            flat = m.flatten()
            node = flat.field(0).to_numpy(zero_copy_only=False)
            f0, f1 = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2))
            radii = np.where(flat.field(3).to_numpy(zero_copy_only=False), min(radius, SHORT_RADIUS), radius)
            tree = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((node, tree))
            tree, node, f0, f1, radii = tree[order], node[order], f0[order], f1[order], radii[order]
            first = np.repeat(np.cumsum(size) - size, size)
            lo = np.repeat(b.column(1).to_numpy(zero_copy_only=False), size) * SLICE
            rank = np.arange(len(node)) - first
            queries = np.flatnonzero((rank >= lo) & (rank < lo + SLICE))
            root = least_linked(len(node), search_trees(tree, f0, f1, radii, queries))
            on = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[root[on]])], ["a", "b"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of the connected component of each node of the edges (a, b)."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # Large star: each node's greater neighbours go to the least node near it. Small star: the others do.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, materialise(small, name)
        discard(last)
        # Done when every edge goes to a root: no node is both the greater and the lesser of edges, and none has two.
        if e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and e.groupBy("a").count().where("count > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_copies(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size) of each document that has a near or exact copy; keep_id is the least id of its group."""
    f = materialise(fingerprints(docs, text, doc_id), "simhash")
    nodes = f.groupBy("f0", "f1").agg(F.min(F.struct("doc_id", "short", "shards")).alias("x")).select("f0", "f1", F.col("x.doc_id").alias("node"), "x.short", "x.shards")
    shards = nodes.select(F.explode("shards").alias("shard"), "node", "f0", "f1", "short")
    trees = shards.groupBy("shard").agg(F.collect_list(F.struct("node", "f0", "f1", "short")).alias("members")).where("size(members) > 1")
    slices = F.expr(f"sequence(0, (size(members) - 1) div {SLICE})")
    small = trees.where(f"size(members) <= {SLICE}").select("members", F.lit(0).alias("slice"))
    large = trees.where(f"size(members) > {SLICE}").select("members", F.explode(slices).alias("slice"), "shard").repartition("shard", "slice").select("members", "slice")
    root = components(small.unionAll(large).transform(map_arrow, _edge_batches(radius), "a long, b long"))
    named = f.join(nodes.select("f0", "f1", "node"), ["f0", "f1"]).select("doc_id", "node").distinct().join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("keep_id"))
    size = named.groupBy("keep_id").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return named.join(size, "keep_id").select("doc_id", "keep_id", "group_size")


def near_dedup(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one of each group of near copies, that of the least id. Texts are shuffled only where a bitmap of the ids to go may hold theirs."""
    gone = materialise(near_copies(docs, radius, text, doc_id).where("doc_id <> keep_id").select(F.col("doc_id").alias("_nd_id")), "near-gone")
    bits = bits_for(gone.count())
    plain = numbered(docs)
    own = F.col(f"c{docs.columns.index(doc_id)}").cast("bigint")
    d = mark(plain, [own], bitmap_of(gone, [F.col("_nd_id")], bits), "_nd_hit", bits)
    rest = d.where("_nd_hit").join(gone, own == F.col("_nd_id"), "left_anti")
    return d.where("not _nd_hit").select(*columns(plain)).unionAll(rest.select(*columns(plain))).toDF(*docs.columns)
