"""Exact dedup, substring dedup and near-dedup against brute force, and their defined cases."""

import collections
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, messy_rows, words
from tickloom.llm import simhash_dedup as S
from tickloom.llm.bitmaps import bitmap_of, mark
from tickloom.llm.exact_dedup import exact_copies, exact_dedup
from tickloom.llm import substring_dedup as S1
from tickloom.llm.substring_dedup import SUBSTRING_SQL, substring_duplicates


def test_bitmap_keeps_every_key_and_drops_most_others(spark):
    df = spark.range(20_000)
    keys = df.where("id % 10 = 0")
    m = mark(df, [F.col("id")], bitmap_of(keys, [F.col("id")], 20), "hit", 20)
    assert m.where("id % 10 = 0 and not hit").isEmpty()
    assert m.where("id % 10 <> 0 and hit").count() < 200


def test_exact_copies(spark, messy, empty):
    groups = collections.defaultdict(list)
    for r in messy_rows():
        if r[1] is not None:
            groups[r[1]].append(r[0])
    want = collections.Counter((i, min(x for x in g if x is not None), len(g)) for g in groups.values() if len(g) > 1 for i in g)
    assert collections.Counter(map(tuple, exact_copies(messy).collect())) == want
    assert exact_copies(empty).isEmpty()


def test_exact_copies_whatever_the_length_column_says(spark):
    df = spark.createDataFrame([(1, "grün", 4), (2, "grün", 5), (3, "grün", None), (4, "blau", 4)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, exact_copies(df).collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [1, 4]


def test_exact_dedup_keeps_one_of_each(messy, empty):
    out = exact_dedup(messy)
    assert out.columns == messy.columns
    kept = [r["text"] for r in out.collect()]
    want = {r[1] for r in messy_rows() if r[1] is not None}
    assert sorted(t for t in kept if t is not None) == sorted(want)
    assert sum(t is None for t in kept) == sum(r[1] is None for r in messy_rows())
    assert {r["doc_id"] for r in out.where("doc_id = 100 or doc_id = 101").collect()} == set()
    assert exact_dedup(empty).isEmpty()


def brute_passages(rows, w):
    """Words of each row that lie in a window that occurs twice or more, anywhere."""
    where = collections.Counter()
    for _, t in rows:
        x = t.split()
        where.update(tuple(x[k : k + w]) for k in range(len(x) - w + 1))
    out = collections.defaultdict(set)
    for i, t in rows:
        x = t.split()
        for k in range(len(x) - w + 1):
            if where[tuple(x[k : k + w])] > 1:
                out[i] |= set(range(k, k + w))
    return dict(out)


def covered(df, only=lambda r: True):
    out = collections.defaultdict(set)
    for r in df.collect():
        if only(r):
            out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return dict(out)


def passage_rows():
    rng = random.Random(3)
    shared = [words(rng, n) for n in (50, 51, 49, 120, 60)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 200))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = s
        if i % 7 == 0:
            w = w + w  # repeats within the document only
        rows.append((i, " ".join(w)))
    return rows


def test_substrings_match_brute_force(spark):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_passages(rows, 50)
    assert want
    for part in (1 << 24, 3000):
        assert covered(substring_duplicates(df, part=part)) == want
    assert covered(substring_duplicates(df, window=8)) == brute_passages(rows, 8)


def test_substrings_match_sql_whatever_the_parts(spark):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = sorted(con.execute(SUBSTRING_SQL).fetchall())
    assert any(r[6] for r in want) and any(r[0] == r[5] and not r[6] for r in want)
    for part in (1 << 24, 3000):
        assert sorted(map(tuple, substring_duplicates(df, part=part).collect())) == want


def test_every_repeated_window_has_one_keeper(spark):
    rng = random.Random(21)
    p, q = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join(p)), (2, " ".join(p + q)), (3, " ".join(q)), (None, " ".join(q)), (None, " ".join(words(rng, 20) + q + q)), (4, " ".join(q)), (4, " ".join(q))]
    out = substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keep = sorted((r.doc_id, r.start_word, r.end_word) for r in out if r.is_first)
    assert keep == [(1, 0, 60), (2, 60, 120)]  # the second passage stays where it stands first, though the document repeats the first
    assert sum(r.doc_id is None for r in out) >= 2 and all(r.first_doc_id in (1, 2) or r.first_doc_id is None for r in out)
    only = substring_duplicates(spark.createDataFrame([(None, " ".join(q)), (None, " ".join(q))], "doc_id long, text string")).collect()
    assert sorted(r.is_first for r in only) == [False, True] and all(r.first_doc_id is None and r.copies == 2 for r in only)


def test_sketch_loses_nothing():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 1000, 300)) for _ in range(4)]
    more = [rng.random(len(c)) < 0.1 for c in lists]
    total = np.zeros(1000, int)
    for c, m in zip(lists, more):
        total[c] += 1 + m
    for step in (1000, 64):
        for c, got in zip(lists, S1.merge_cells(lists, more, 1000, step)):
            assert (got == (total[c] > 1)).all()
    for c in (*lists, np.array([0, 255, 256, 999]), np.zeros(0, np.int64), np.arange(1000)):
        for block in (1000, 10**6):
            assert (S1.unpack_sorted(S1.pack_sorted(c, block), len(c), block) == c).all()


def test_substrings_defined_cases(messy, empty):
    rows = [(r[0], r[1]) for r in messy_rows() if r[1] is not None]
    got = substring_duplicates(messy).collect()
    assert covered(substring_duplicates(messy)) == brute_passages(rows, 50)
    assert {r.doc_id for r in got} == {0, 1, 2, 100, 101, None}
    assert {r.doc_id for r in got if r.is_first} == {0, 1, 2} and sum(r.is_first for r in got) == 3
    assert substring_duplicates(empty).isEmpty()


def test_bk_tree_search_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64)
        f = base[rng.integers(0, 4, n)]
        for _ in range(int(rng.integers(0, 12))):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, f.shape).astype(np.uint64)) * rng.integers(0, 2, f.shape).astype(np.uint64)
        tree = np.sort(rng.integers(0, 3, n))
        f0, f1 = f[:, 0].copy(), f[:, 1].copy()
        for radius in (0, 3, 18):
            got = sorted((int(a), int(b)) for q, x in S.search_trees(tree, f0, f1, radius) for a, b in zip(q, x))
            want = sorted((i, j) for i in range(n) for j in range(i) if tree[i] == tree[j] and S.distance(f0[i], f1[i], f0[j], f1[j]) <= radius)
            assert got == want


def test_bk_tree_children_are_keyed_by_distance():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (200, 2), dtype=np.uint64)
    parent, edge, roots = S.build_trees(np.zeros(200, np.int64), f[:, 0], f[:, 1])
    assert roots.tolist() == [0]
    kids = [k for k in range(200) if parent[k] != k]
    assert len(kids) == 199 and len({(parent[k], edge[k]) for k in kids}) == 199
    assert all(edge[k] == S.distance(f[k, 0], f[k, 1], f[parent[k], 0], f[parent[k], 1]) for k in kids)


def test_fingerprints_match_plain_simhash():
    texts = ["The cat sat on the mat", "a", "", None, "x y z x y z", "Ünïcode wörds hier"]
    f, n = S.fingerprints_of(pa.array(texts))
    assert n.tolist() == [6, 1, 0, 0, 6, 3] and f[2:4].sum() == 0
    g, _ = S.fingerprints_of(pa.array(["THE CAT sat, on the mat!"]))
    assert (g[0] == f[0]).all()


def near_rows(rng):
    rows = []
    for g in range(30):
        w = words(rng, rng.randrange(80, 300))
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.randrange(0, 5)):
            x = list(w)
            for _ in range(len(x) // 40):
                x[rng.randrange(len(x))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(x)))
    return rows


def groups_of(pairs):
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[b].add(a)
    return {frozenset(v) for v in out.values()}


def test_near_copies_recall_against_brute_force(spark):
    rows = near_rows(random.Random(5))
    f, _ = S.fingerprints_of(pa.array([t for _, t in rows]))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if S.distance(f[i, 0], f[i, 1], f[j, 0], f[j, 1]) <= S.RADIUS]
    got = {r.doc_id: r.keep_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(i in got and got[i] == got.get(j) for i, j in near)
    assert len(near) > 30 and found >= 0.9 * len(near)
    root = S.least_linked(len(rows), iter([(np.array([i]), np.array([j])) for i, j in near]))
    assert all(root[i] == root[k] for i, k in got.items())  # nothing that brute force keeps apart


def test_radius_reaches_the_measured_gap(spark):
    rng = random.Random(11)
    rows = []
    while len(rows) < 120:  # pairs of texts at 19 to 24 bits
        w = words(rng, 150)
        x = [words(rng, 1)[0] if rng.random() < 0.13 else t for t in w]
        f, _ = S.fingerprints_of(pa.array([" ".join(w), " ".join(x)]))
        if 19 <= S.distance(f[:1, 0], f[:1, 1], f[1:, 0], f[1:, 1])[0] <= 24:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(x))]
    got = {r.doc_id: r.keep_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.get(i) == got.get(i + 1, -1) for i in range(0, 120, 2)) >= 20


def test_shards_bring_pairs_together_at_every_distance():
    rng = random.Random(12)
    met = collections.defaultdict(list)
    for k in range(3000):
        w = words(rng, rng.randrange(60, 300))
        rate = rng.uniform(0.005, 0.16)
        x = [words(rng, 1)[0] if rng.random() < rate else t for t in w]
        key, n = S.features_of(pa.array([" ".join(w), " ".join(x)]))
        f, keys = S.signs(key, 2), S.shard_keys(key, 2)
        met[int(S.distance(f[:1, 0], f[:1, 1], f[1:, 0], f[1:, 1])[0])].append((keys[0] == keys[1]).any())
    for d in range(6, S.RADIUS + 1):
        assert len(met[d]) > 20 and np.mean(met[d]) >= 0.9


def test_shards_of_texts_of_few_words():
    key, n = S.features_of(pa.array(["one", "two", "", "one", "one one"]))
    keys = S.shard_keys(key, 5)
    assert (keys[0] == keys[3]).all() and not (keys[0] == keys[1]).any() and n.tolist() == [1, 1, 0, 1, 2]


def test_short_texts_have_the_smaller_radius():
    f = np.zeros((3, 2), np.uint64)
    f[1, 0], f[2, 1] = np.uint64((1 << 20) - 1), np.uint64((1 << 18) - 1)  # 20 and 18 bits from the first
    pairs = lambda r: {(int(a), int(b)) for q, x in S.search_trees(np.zeros(3, np.int64), f[:, 0], f[:, 1], r) for a, b in zip(q, x)}
    assert pairs(np.array([27, 27, 27])) == {(1, 0), (2, 0)}
    assert pairs(np.array([27, 18, 27])) == {(2, 0)} and pairs(np.array([18, 27, 27])) == {(2, 0)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = S.least_linked(400, iter([(np.array([max(e)]), np.array([min(e)])) for e in edges]))
    assert got == {k: int(root[k]) for k in range(400) if root[k] != k}
    assert S.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_shards_stay_small_and_complete_as_the_table_grows():
    for docs in (10**5, 10**7, 10**9, 5 * 10**10):
        picks = S.picks_for(docs)
        assert docs / S.GROWTH**picks <= S.FEW / S.GROWTH**S.PICKS  # unrelated documents that meet in a shard
        assert (1 - S.LEAST_J**picks) ** S.tables_for(picks) <= S.MISSED
    assert S.picks_for(10**5) == S.PICKS and S.tables_for(S.PICKS) == 24
    rng = random.Random(23)
    w = words(rng, 150)
    x = [words(rng, 1)[0] if rng.random() < 0.05 else t for t in w]
    key, _ = S.features_of(pa.array([" ".join(w), " ".join(x)]))
    for picks in (3, 5, 8):
        keys = S.shard_keys(key, 2, picks)
        assert keys.shape == (2, S.tables_for(picks)) and (keys[0] == keys[1]).any()


def test_slices_of_a_shard_find_what_the_whole_does(spark, monkeypatch):
    rng = random.Random(24)
    w = words(rng, 100)
    rows = [(i, " ".join([words(rng, 1)[0] if rng.random() < 0.04 else t for t in w])) for i in range(40)] + [(100 + i, " ".join(words(rng, 100))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, S.near_copies(df).collect()))
    monkeypatch.setattr(S, "SLICE", 7)
    assert sorted(map(tuple, S.near_copies(df).collect())) == want and len(want) == 40


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for op in (exact_copies, substring_duplicates, S.near_copies):
        with pytest.raises(ValueError, match="doc_id must be an integer"):
            op(df)


def test_near_defined_cases(messy, empty):
    got = {r.doc_id: r.keep_id for r in S.near_copies(messy).collect()}
    assert got == {0: 0, 100: 0, 101: 0}
    out = S.near_dedup(messy)
    assert out.columns == messy.columns and out.count() == len(messy_rows()) - 2
    assert S.near_copies(empty).isEmpty() and S.near_dedup(empty).isEmpty()
