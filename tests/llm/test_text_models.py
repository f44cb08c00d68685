"""Toxicity, language ID, LM scoring and BPE: brute force, held-out accuracy, round trips, defined cases."""

import collections
import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import SCHEMA, messy_rows, words
from tickloom.llm import bpe_chunks as B
from tickloom.llm import language_id as L
from tickloom.llm import lm_automaton as A
from tickloom.llm import toxicity as X


def toxic_rows(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, 60)
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "vilething", "vilestuff", "rotter"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    n, nf = 500, 40
    dense = rng.random((n, nf)) * (rng.random((n, nf)) < 0.1)
    dense = np.round(dense, 1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    r, f = np.nonzero(dense)
    index = X.BlockMaxIndex(n, r, f, dense[r, f], nf)
    q = rng.random((300, nf)) * (rng.random((300, nf)) < 0.15)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    qr, qf = np.nonzero(q)
    but = rng.integers(0, n, 300)
    for left_out in (None, but):
        got = {i: (ids, sims) for i, ids, sims in index.search(qr, qf, q[qr, qf], 300, 15, left_out)}
        for i in range(300):
            cos = np.round(dense @ q[i], 12)
            if left_out is not None:
                cos[but[i]] = 0
            want = [j for j in np.lexsort((np.arange(n), -cos)) if cos[j] > 0][:15]
            ids, sims = got.get(i, (np.zeros(0, int), np.zeros(0)))
            assert np.allclose(sims, cos[want], atol=1e-9) and np.allclose(cos[ids], cos[want], atol=1e-9)


def test_search_with_and_without_bounds(monkeypatch):
    """Few postings for their blocks are added up without bounds; what is found is the same to the last digit."""
    rng = np.random.default_rng(3)
    n, nf = 400, 900
    w = rng.random((n, nf)) * (rng.random((n, nf)) < 0.03)
    r, f = np.nonzero(w)
    index = X.BlockMaxIndex(n, r, f, w[r, f], nf)
    but, found = rng.integers(0, n, n), []
    assert len(r) < X.PAYS * len(index.post)  # so the bounds don't pay here
    for pays in (0, X.PAYS):
        monkeypatch.setattr(X, "PAYS", pays)
        found.append([[(i, a.tolist(), b.tolist()) for i, a, b in index.search(r, f, w[r, f], n, 7, x)] for x in (None, but)])
    assert found[0] == found[1] and len(found[0][0]) == n
    monkeypatch.setattr(index, "_bounded", None)
    assert [(i, a.tolist(), b.tolist()) for i, a, b in index.search(r, f, w[r, f], n, 7)] == found[0][0]


def test_toxicity_matches_brute_force(spark):
    """Weights, cosines, neighbours, votes and scores of 500 documents by loops over words."""
    rows, labels = toxic_rows(500)
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), dict(labels)
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in X.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    tf = {i: collections.Counter(t.lower().split()) for i, t in rows}
    df = collections.Counter(w for c in tf.values() for w in c)
    a, b = (collections.Counter(w for i, t in labels if t == k for w in tf[i]) for k in (1, 0))
    relevance = {w: math.log2(2 + max(a[w] - 1, 0) / max(b[w], 1)) ** 2 for w in {*a, *b}}
    weight = {w: math.log(500 / df[w]) * r if df[w] <= 50 or r >= X.RELEVANT else 0 for w, r in relevance.items()}

    def vector(i):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in tf[i].items() if weight.get(w)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: vector(i) for i in y}
    assert sum(map(bool, examples.values())) > 0.95 * len(examples)  # clean ones are in the index as well
    for i, _ in rows:
        v = vector(i)
        cos = {j: round(sum(x * e.get(w, 0) for w, x in v.items()), 12) for j, e in examples.items()}
        near = sorted((-c, j) for j, c in cos.items() if c > 1e-12)[: X.NEIGHBOURS]
        assert np.allclose([e.cosine for e in got[i].evidence], [-c for c, _ in near], atol=2e-6)
        w = [c * c for c, _ in near]
        raw = (sum(x for x, (_, j) in zip(w, near) if y[j]) + X.PRIOR * model.prior) / (sum(w) + X.PRIOR)
        x = min(max(raw, 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(model.beta[0] + model.beta[1] * math.log(x / (1 - x)))))
        assert abs(got[i].score - want) < 1e-3 and got[i].toxic == (got[i].score >= X.THRESHOLD and bool(near))


def test_toxicity_separates_held_out(spark):
    rows, labels = toxic_rows()
    got = {r.doc_id: r for r in X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    known = {i for i, _ in labels}
    held = [i for i, _ in rows if i not in known]
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in range(400)]) > 0.98 and not any(got[i].toxic for i in held if i % 4)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[0].evidence[0].cosine >= got[0].evidence[-1].cosine and got[0].evidence[0].toxic


def test_toxicity_defined_cases(spark, messy, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert X.toxicity(messy, labels).count() == len(messy_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.toxicity(messy, none).collect()
    assert len(out) == len(messy_rows()) and not any(r.toxic for r in out) and all(r.score is None for r in out)
    assert X.drop_toxic(messy, none).count() == len(messy_rows())
    kept = X.drop_toxic(messy, labels)
    assert kept.columns == messy.columns and kept.where("text is null").count() == 2
    assert X.toxicity(empty, labels).isEmpty()


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 30):
        c = L.codewords(n)
        d = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(d) >= max(1, c.shape[1] // 4)
        assert len({tuple(x * x[0]) for x in c.T}) == c.shape[1] == {2: 1, 3: 3, 4: 7}.get(n, c.shape[1])  # no bit is another's copy or opposite


def test_language_decoding_matches_brute_force(spark):
    """Features, losses, decoding, margins and flags by loops, with the classifiers that were fitted."""
    rng = random.Random(22)
    langs = {"aa": "abcd", "bb": "bcde", "cc": "cdef"}
    rows = [(i, "".join(rng.choice(langs[k] + " ") for _ in range(rng.randrange(1, 40))), k) for i in range(150) for k in [rng.choice(list(langs))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.language_id(df, per_lang=30).collect()}
    sample = L.labelled_sample(df, 30)
    m = L.OutputCodes().fit([r["text"] for r in sample], [r["lang"] for r in sample])
    ambiguous = 0
    for i, text, _ in rows:
        grams = collections.Counter()
        raw = text.lower().encode()
        for n in (1, 2, 3):
            for at in range(len(raw) - n + 1):
                key = 0
                for c in raw[at : at + n]:
                    key = (key * 257 + c) % 2**32
                grams[(key + n * 0x51ED27) * 0x9E3779B1 % 2**32 >> 20] += 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in grams.values()))
        f = [sum(math.log1p(c) / norm * m.w[g, b] for g, c in grams.items()) + m.bias[b] for b in range(m.w.shape[1])]
        loss = {lang: sum(w * math.log1p(math.exp(-x * c)) for w, x, c in zip(m.weight, f, code)) for lang, code in zip(m.langs, m.code)}
        first, second = sorted(loss.values())[:2]
        if second - first > 1e-4:
            assert got[i].predicted == min(loss, key=loss.get)
        assert abs(got[i].margin - (second - first)) < 1e-4
        assert abs(second - first - L.AMBIGUOUS) < 1e-4 or got[i].ambiguous == (second - first < L.AMBIGUOUS)
        ambiguous += got[i].ambiguous
    assert 0 < ambiguous < len(rows)


def test_language_id_held_out(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 12, "de" if i % 3 == 0 else "en")), ("de" if i % 3 == 0 else "en") if i < 150 else None) for i in range(400)]
    out = L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=40).collect()
    assert np.mean([r.predicted == ("de" if r.doc_id % 3 == 0 else "en") for r in out if r.doc_id >= 150]) > 0.98


def test_ngram_counts_match_brute_force():
    texts = ["abc abc", "", "é", "zz"]
    from tickloom.llm.shared import text_bytes

    buf, off = text_bytes(pa.array(texts))
    got = L.ngram_counts(buf, off, 4096)
    for k, t in enumerate(texts):
        raw = t.encode()
        assert got[k].sum() == sum(max(0, len(raw) - n + 1) for n in (1, 2, 3))
        one = L.ngram_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 4096)[0] if raw else np.zeros(4096)
        assert (got[k] == one).all()


def test_language_defined_cases(messy, empty):
    out = L.language_id(messy, per_lang=50).collect()
    assert len(out) == len(messy_rows())
    assert all(r.predicted is None and r.ambiguous for r in out if r.doc_id in (102, 103, 104))
    assert L.language_id(empty).isEmpty()
    none = messy.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert all(r.predicted is None and r.ambiguous for r in L.language_id(none).collect())


def local_automaton(texts, least):
    """The whole corpus as one part, asked and answered without Spark."""
    own, through = A.Part(pa.array(texts)), lambda rows: A.merge(A.slices(rows), least)
    pairs = A.hear(through(own.ask_pairs(0, 0)), 1)
    own.kept_triples(pairs[3])
    triples = A.hear(through(own.ask_triples(0, 0)), 2)
    return own, own.automaton(pairs, triples, int(own.times.sum()), A.DISCOUNT)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lm_probabilities_sum_to_one(least):
    rng = random.Random(8)
    vocab = words(rng, 12)
    own, a = local_automaton([" ".join(rng.choices(vocab, k=40)) + f" once{i}" for i in range(60)], least)
    v = len(a.p1)
    for state in range(0, len(a.bow), 7):
        p = a.step(np.full(v, state), np.arange(v))[1]
        new, s = A.DISCOUNT * v / own.times.sum(), state  # words that the corpus doesn't have are reached by failure arcs alone
        while s:
            new, s = new * np.exp(a.bow[s]), a.fail[s]
        assert abs(np.exp(p).sum() + new - 1) < 1e-6
    assert len(a.bow) > v + 1 and len(a.key) > len(a.bow) - v - 1


def test_lm_scores_are_those_of_a_literal_traversal():
    rng = random.Random(15)
    vocab = words(rng, 15)
    own, a = local_automaton([" ".join(rng.choices(vocab, k=rng.randrange(30))) + f" once{i}" * (i % 3) for i in range(50)] + ["", None, "once1"], 2)
    at, want = 0, []
    for n in own.n:
        state, total = np.zeros(1, np.int64), 0.0
        for t in range(at, at + n):
            state, p = a.step(state, own.at[t : t + 1])
            total += p[0]
        at += n
        want.append(total)
    assert np.allclose(a.score(own), want, atol=1e-9)


def test_lm_arcs_are_looked_up_and_not_searched_for(monkeypatch):
    """The part's pairs and triples are numbered as np.unique would, and a text's run takes its arcs by these numbers."""
    rng = np.random.default_rng(2)
    for key, most in ((rng.integers(0, 900, 5000), 900), (rng.integers(0, 1 << 60, 50), 1 << 60), (np.zeros(0, np.int64), 1)):
        for got in (A.ranked(key, most), A.ranked_hashes(key.astype(np.uint64))):
            assert all(np.array_equal(a, b) for a, b in zip(got, np.unique(key, return_inverse=True, return_counts=True)))
    own, a = local_automaton(["a b c a b c d", "a b c", None, "d", "c a b"], 2)
    monkeypatch.setattr(A, "find", None)
    monkeypatch.setattr(A, "PLACES", 3)
    assert np.isfinite(a.score(own)).all() and a.score(own)[2] == 0 > a.score(own)[1]


def test_lm_counts_survive_packing():
    for x in ([], [0], [254, 255, 256, 65534, 65535, 65536, 10**12], [255] * 40, list(range(600))):
        b = A.pack(np.array(x, dtype=np.int64))
        assert A.unpack(b).tolist() == x


def test_lm_parts_and_buckets_change_nothing(spark, messy):
    rng = random.Random(13)
    vocab = words(rng, 40)
    df = spark.createDataFrame([(i, " ".join(rng.choices(vocab, k=rng.randrange(60)))) for i in range(80)], "doc_id long, text string")
    key = lambda d: sorted(d.collect())
    want = key(A.lm_scores(df))
    assert key(A.lm_scores(df, part=2000, bucket=100)) == want and len(want) == 80


def test_lm_scores_match_sql(spark, messy, empty):
    got = A.lm_scores(messy).collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in messy_rows()], "text": [r[1] for r in messy_rows()]}))
    want = con.execute(A.LM_SQL).fetchall()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or math.isclose(g[2], w[2], rel_tol=1e-6, abs_tol=1e-3)
    assert A.lm_scores(empty).isEmpty()


def test_lm_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(14)
    once = [" ".join(words(rng, 120)) for _ in range(40)]
    rows = list(enumerate(once)) + [(100 + i, t) for i, t in enumerate(once[:10])]
    rows += [(1000 + i, "word " * 5_000) for i in range(1400)]  # 7 million words: the count that keeps an n-gram is the same
    got = {r.doc_id: r.mean_logprob for r in A.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in range(10)) > max(got[i] for i in range(10, 40)) + 1


@pytest.mark.parametrize("mask_bits,most", [(7, 16384), (2, 12), (0, 7)])
def test_bpe_equals_encoding_whole_texts(spark, mask_bits, most):
    rng = random.Random(9)
    al = "aé 中文字\n\t  .'s12 !? 　漢字仮名"
    rows = [(i, "".join(rng.choice(al) * rng.choice([1, 1, 1, 30]) for _ in range(rng.randrange(0, 200)))) for i in range(60)] + [r[:2] for r in messy_rows()]
    rows = rows * 2
    enc = B.encoding()
    want = collections.Counter((i, None if t is None else tuple(enc.encode_ordinary(t))) for i, t in rows)
    out = B.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), mask_bits=mask_bits, most=most).collect()
    assert collections.Counter((r.doc_id, None if r.tokens is None else tuple(r.tokens)) for r in out) == want
    assert all(r.round_trip == (r.tokens is not None) for r in out)
    texts = collections.Counter(t for _, t in rows if t is not None)
    assert collections.Counter(B.decode(r.tokens) for r in out if r.tokens is not None) == texts


def test_bpe_chunks_follow_content():
    rng = random.Random(10)
    shared = " ".join(words(rng, 600))
    texts = [" ".join(words(rng, 50)) + " " + shared + " " + " ".join(words(rng, 50)) for _ in range(2)]
    (_, _, _, o, cuts, safe, h1, h2), = B.chunked(pa.array(texts))
    first = cuts < o[1]
    assert safe.all() and len(set(h1[first]) & set(h1[~first])) >= 3


def test_bpe_defined_cases(messy, empty):
    assert B.encode_documents(messy).count() == len(messy_rows())
    assert B.encode_documents(empty).isEmpty()


SCRIPTS = {"cyrillic": (0x430, 0x44F, " "), "greek": (0x3B1, 0x3C9, " "), "cjk": (0x4E00, 0x9FA0, ""), "cjk sentences": (0x4E00, 0x9FA0, "。"), "hangul": (0xAC00, 0xD7A3, " ")}


@pytest.mark.parametrize("script", SCRIPTS)
def test_bpe_reuses_chunks_of_every_script(script):
    rng = random.Random(16)
    lo, hi, space = SCRIPTS[script]
    text = lambda n: space.join("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = text(4000)
    pair = [text(100) + space + shared + space + text(100) for _ in range(2)]
    (_, _, _, o, cuts, safe, h1, h2), = B.chunked(pa.array(pair))
    first = cuts < o[1]
    both = set(h1[first]) & set(h1[~first])
    assert len(both) >= 0.8 * first.sum() >= 5
    assert safe.mean() > 0.95 if space else not safe.all()
    enc = B.encoding()
    for t in pair:  # chunks encoded apart and joined are the text encoded whole
        raw = t.encode()
        (_, _, _, _, cuts, safe, _, _), = B.chunked(pa.array([t]))
        ends = [*cuts[1:], len(raw)]
        pieces = [(bool(s), B.encode_whole(raw[a:z].decode(), enc)) for a, z, s in zip(cuts, ends, safe)]
        assert B.join_tokens(pieces, enc).tolist() == enc.encode_ordinary(t)


def test_bpe_joins_take_time_in_proportion():
    rng = random.Random(17)
    enc, took = B.encoding(), []
    for n in (50_000, 400_000):
        t = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
        raw = t.encode()
        cuts = list(range(0, len(raw), 1500))
        pieces = [(a == 0, B.encode_whole(raw[a : a + 1500].decode(), enc)) for a in cuts]
        began = time.process_time()
        got = B.join_tokens(pieces, enc)
        took.append(time.process_time() - began)
        assert got.tolist() == enc.encode_ordinary(t)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_bpe_chunking_costs_less_than_encoding():
    """Texts are cut and hashed three times and encoded once, so a pass must cost a part of the encoding only."""
    rng = random.Random(20)
    enc, texts = B.encoding(), [" ".join(words(rng, 600, lang)) for lang in ("en", "de") for _ in range(250)]
    cut, encoded = [], []
    for _ in range(4):
        began = time.process_time()
        assert sum(len(cuts) for _, _, _, _, cuts, *_ in B.chunked(pa.array(texts))) > 500
        cut.append(time.process_time() - began)
        began = time.process_time()
        for t in texts:
            enc.encode_ordinary(t)
        encoded.append(time.process_time() - began)
    assert min(cut) < 0.5 * min(encoded)


def test_bpe_safe_places_are_safe():
    rng = random.Random(18)
    enc = B.encoding()
    al = ["a", "é", " ", "\n", "\t", "　", " ", " ", "。", "、", "中", "か", "カ", "한", "'s", "'", "1", "!", "！", "б", "ー", "́"]
    for _ in range(3000):
        t = "".join(rng.choice(al) for _ in range(rng.randrange(1, 14)))
        raw = t.encode()
        for p in B.safe_places(np.frombuffer(raw, np.uint8)):
            assert enc.encode_ordinary(raw[:p].decode()) + enc.encode_ordinary(raw[p:].decode()) == enc.encode_ordinary(t), (t, p)
