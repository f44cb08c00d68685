"""Mixing, sharding, media sequences and the pipeline."""

import collections
import hashlib
import html.parser
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import messy_rows, words
from tickloom.llm import kd_sharding as K
from tickloom.llm import media_sequences as M
from tickloom.llm import mixing as X


def fill(budget, caps, weights):
    """Water-filling by rounds, as a check of the closed form."""
    share = [0.0] * len(caps)
    live = set(range(len(caps)))
    while live and budget > 1e-9:
        total = sum(weights[k] for k in live)
        full = [k for k in live if budget * weights[k] / total >= caps[k] - share[k] - 1e-12]
        if not full:
            for k in live:
                share[k] += budget * weights[k] / total
            return share
        for k in full:
            budget -= caps[k] - share[k]
            share[k] = caps[k]
            live.discard(k)
    return share


def test_shares_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10.0), ("a", "x", "2", 100.0), ("a", "y", "1", 50.0), ("b", "x", "1", 1000.0)]
    w = {0: {"a": 3.0, "b": 1.0}, 1: {}}
    out = {tuple(r)[:3]: r["take"] for r in X.leaf_shares(spark.createDataFrame(leaves, "l_0 string, l_1 string, l_2 string, supply double"), 3, w, 200 / 1160, 1).collect()}
    # a gets 150 of 200: x and y 75 each, y has but 50, so x gets 100; its leaf 1 has but 10.
    assert out == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 50, ("b", "x", "1"): 50}
    rng = random.Random(1)
    for _ in range(5):
        caps, ws = [rng.randrange(1, 100) * 1.0 for _ in range(6)], [rng.random() + 0.1 for _ in range(6)]
        df = spark.createDataFrame([(f"k{i}", c) for i, c in enumerate(caps)], "l_0 string, supply double")
        got = {r["l_0"]: r["take"] for r in X.leaf_shares(df, 1, {0: {f"k{i}": v for i, v in enumerate(ws)}}, 0.5, 1).collect()}
        want = fill(sum(caps) / 2, caps, ws)
        assert all(abs(got[f"k{i}"] - want[i]) <= 1 for i in range(6))


def test_weight_zero_takes_nothing(spark):
    leaves = [("a", "x", 10.0), ("a", "y", 100.0), ("b", "x", 40.0), ("b", "y", 5.0), ("c", "x", 30.0)]
    df = spark.createDataFrame(leaves, "l_0 string, l_1 string, supply double")
    out = {tuple(r)[:2]: r["take"] for r in X.leaf_shares(df, 2, {0: {"c": 0.0}, 1: {"y": 0.0}}, 0.2, 1).collect()}
    assert out == {("a", "x"): 10, ("a", "y"): 0, ("b", "x"): 27, ("b", "y"): 0, ("c", "x"): 0}
    assert set(r["take"] for r in X.leaf_shares(df, 2, {0: {k: 0.0 for k in "abc"}}, 0.2, 1).collect()) == {0}
    with pytest.raises(ValueError, match="negative"):
        X.leaf_shares(df, 2, {0: {"a": -1.0}}, 0.2, 1)


def test_mixture_matches_sql_and_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), rng.choice(["en", "de", "fr"]), f"src{rng.randrange(20) if i % 3 else 0}") for i in range(500)]
    got = collections.Counter(map(tuple, X.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()))
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "text", "lang", "source"))}))
    assert got == collections.Counter(con.execute(X.MIXTURE_SQL).fetchall())
    assert max(r[4] for r in got) <= X.MAX_EPOCHS


def test_mixing_defined_cases(messy, empty):
    out = X.mix_sources(messy)
    assert out.columns == [*messy.columns, "_mx_epoch", "_mx_tokens"] and out.count() > 0
    again = X.mix_sources(messy.repartition(7))
    key = lambda d: sorted(str((r.doc_id, r.source, r._mx_epoch, r._mx_tokens)) for r in d.collect())
    assert key(out) == key(again)
    assert X.mix_sources(empty).isEmpty()


def brute_kd(x, b, target):
    whole, leaves = np.maximum(x.max(0) - x.min(0), 1), []

    def rec(ix):
        share = (x[ix].max(0) - x[ix].min(0)) / whole
        if b[ix].sum() <= target or share.max() <= 0:
            leaves.append(ix)
            return
        v = x[ix, int(share.argmax())]
        o = np.argsort(v, kind="stable")
        cut = v[o][np.searchsorted(np.cumsum(b[ix][o]), b[ix].sum() / 2)]
        cut = v[v < cut].max() if cut == v.max() else cut
        rec(ix[v <= cut])
        rec(ix[v > cut])

    rec(np.arange(len(x)))
    return leaves


def test_kd_tree_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 40, 400) ** 2, rng.integers(-1, 3, 400), rng.integers(0, 1 << 40, 400)], axis=1)
    b = rng.integers(0, 100, 400)
    df = spark.createDataFrame([(*map(int, r), int(w)) for r, w in zip(x, b)], "d0 long, d1 long, d2 long, bytes long").repartition(4)
    for target in (50, 700, 10**9):
        tree, _ = K.grow(df, 3, target)
        at = tree.shards()[K.descend(x.T.copy(), *tree.arrays())]
        want = brute_kd(x, b, target)
        assert all(set(np.flatnonzero(at == k)) == set(ix) for k, ix in enumerate(want)) and at.max() + 1 == len(want)


def test_kd_shards_are_the_same_whoever_splits(spark):
    rng = random.Random(20)
    rows = [(i, "x" * rng.randrange(1, 400), rng.choice(["en", "de", None]), f"src{rng.randrange(4)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    x = np.array([[r[k] for k in K.dimensions()] for r in df.select(*[c.alias(k) for k, c in K.dimensions().items()], "doc_id").orderBy("doc_id").collect()])
    want = {int(i): k for k, ix in enumerate(brute_kd(x, np.array([len(r[1]) for r in rows]), 3000)) for i in ix}
    asked = []
    real = K._ranges
    try:
        K._ranges = lambda points, tree, n, ask: asked.append(len(ask)) or real(points, tree, n, ask)
        for most in (0, 100, 10**6):  # a larger table has more nodes in the top, none of more points
            asked.clear()
            got = {r.doc_id: r.shard for r in K.kd_shards(df, 3000, most_points=most).collect()}
            assert got == want
            assert max(asked, default=0) <= (600 // most if most else 600)
    finally:
        K._ranges = real


def test_pipeline_on_messy_and_empty_tables(spark, messy, empty, tmp_path):
    import corpus_pipeline as P

    labels = [(0, 0, 1), (1, 0, 0), (2, 0, 0), (None, 0, 1), (3, 0, None)]
    for name, docs in (("messy", messy), ("empty", empty)):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        d, sizes = spark.read.parquet(f"{at}/documents.parquet"), []
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, d, at).write.parquet(f"{at}/out-{k}")
            d = spark.read.parquet(f"{at}/out-{k}")
            sizes.append(d.count())
            assert k == 4 or d.columns == docs.columns
        assert P.run(spark, at).count() == sizes[-1]
        if name == "empty":
            assert sizes == [0] * 5
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/messy/out-1").where("text is not null").select("text").collect()]
    assert len(texts) == len(set(texts))  # one of each text
    assert spark.read.parquet(f"{tmp_path}/messy/out-2").where("text is null").count() >= 1  # no stage but mixing leaves texts out that nothing is wrong with
    assert all(r.round_trip == (r.tokens is not None) for r in d.collect())


def test_kd_defined_cases(messy, empty):
    out = K.kd_shards(messy, target=2000).collect()
    assert len(out) == len(messy_rows())
    assert K.kd_shards(empty).isEmpty()
    assert len({r.shard for r in out if r.doc_id == 2}) == 1  # repeated rows can't be told apart


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>Hi <b>bold</b> x<!-- c --><figure><img src="/a.png#f" alt="A"><img src='b.png'>
<figcaption>Cap &amp; tion</figcaption></figure>after <a href="q">link <i>t</i></a> tail<img src="data:image/png;base64,AAAA" title="D"><script>x="<p>"</script><p>one<p>two <img></body>"""


def test_media_items_in_order():
    items = M.parse(PAGE, "http://e.com/d/p.html", frozenset((*M.MEDIA_TAGS, "a")))
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [(x["kind"], x.get("text") or (x["tag"], x["src"], x["caption"])) for x in items] == [
        ("text", "Hi bold x"), ("media", ("img", "http://e.com/a.png#f", "Cap & tion")), ("media", ("img", "http://e.com/d/b.png", "Cap & tion")),
        ("text", "after"), ("media", ("a", "http://e.com/d/q", "link t")), ("text", "tail"), ("media", ("img", "data:image/png;base64,AAAA", "D")), ("text", "one"), ("text", "two"),
    ]
    assert items[6]["digest"] == __import__("hashlib").sha256(b"\0\0\0").hexdigest()


def test_media_payloads_are_joined_by_digest(spark):
    pages = spark.createDataFrame([(1, "http://e.com/d/p.html", PAGE), (2, None, PAGE), (None, "u", None), (3, "http://e.com/x", ""), (1, "http://e.com/d/p.html", PAGE), (4, "http://e.com/", "<img src=a.png>" * 2 + "a < b &bogus; <p" + "z" * 100000)], "page_id long, url string, html string")
    d = M.address_digest("http://e.com/a.png")
    pay = spark.createDataFrame([(d, "image/png", 5, "aa"), (d, "image/jpeg", 9, "bb"), (None, "x", 1, "c"), ("unused", "x", 1, "c")], "digest string, mime string, n_bytes long, content string")
    out = M.media_sequences(pages.selectExpr("*", "1 as rid", "2 as sequence"), pay).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    assert len(out) == 6 and [len(by[k]) for k in (1, 2, 3, 4, None)] == [2, 1, 1, 1, 1]
    first = by[1][0]
    assert first.n_resolved == 2 and [x.content for x in first.sequence if x.mime] == ["aa", "AAAA"] and first.sequence[1].caption == "Cap & tion"
    assert by[2][0].n_resolved == 1 and by[3][0].sequence == [] and by[None][0].n_text == 0
    assert by[4][0].n_resolved == 2 and [x.position for x in by[4][0].sequence] == [0, 1, 2]
    assert M.media_sequences(pages.limit(0), pay).isEmpty()
    assert M.page_payloads(pages).where("digest is not null").count() == 4


def test_media_content_that_is_easily_lost():
    tags = frozenset((*M.MEDIA_TAGS, "a", "style", "script"))
    say = lambda page: [x.get("text") or (x["tag"], x.get("src"), x.get("caption")) for x in M.parse(page, None, tags)]
    assert say("<head><title>T</title><meta x><p>one<figure><pre>code</pre><figcaption>Listing <b>one</b></figcaption></figure>two") == ["one", "code", "Listing one", "two"]
    assert say("<head><title>T</title><body>one") == ["one"] and say("<head><title>T</title></head>one") == ["one"] and say("<head>lost") == []
    assert say("<noscript><img data-src=a.png></noscript>x") == [("img", "a.png", None), "x"]
    assert say('<img srcset="a.png 1x, b.png 2x"><video src=v poster=p>') == [("img", "a.png", None), ("video", "v", None), ("video", "p", None)]
    assert say("<figure><a href=x>Link</a><img src=i><figcaption>Cap</figcaption></figure>") == [("a", "x", "Link"), ("img", "i", "Cap")]
    assert say("<figure><a href=x>Link</a><figcaption>Cap</figcaption></figure>") == [("a", "x", "Link"), "Cap"]
    assert say("<head><style>p{}</style></head>a<svg><text>t</text></svg>b<script> </script>") == [("style", None, None), "a", ("svg", None, None), "b"]


class Simple(html.parser.HTMLParser):
    """Another reading of simple pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.link = [], "", None

    def end(self):
        if folded := " ".join(self.text.split()):
            self.out.append(folded)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "p":
            self.end()
        elif tag == "img":
            self.end()
            self.out.append(["img", a["src"], a.get("alt")])
        elif tag == "a":
            self.end()
            self.out.append(["a", a["href"], ""])
            self.link = self.out[-1]

    def handle_endtag(self, tag):
        if tag == "a":
            self.link[2] = " ".join(self.link[2].split())
            self.link = None
        elif tag == "p":
            self.end()

    def handle_data(self, data):
        if self.link is not None:
            self.link[2] += data
        else:
            self.text += data


def test_media_sequences_match_brute_force(spark):
    rng = random.Random(19)
    pages = []
    for i in range(60):
        body = ""
        for _ in range(rng.randrange(8)):
            body += rng.choice(["<p>%s</p>", "<p>%s &amp; <b>%s</b> %s</p>", "<img src='data:image/gif;base64,R0lG%s' alt='%s'>", "<img src='/i/%s.png' alt='x'>", "<a href='/l/%s'>%s <i>t</i></a>"])
            body = body.replace("%s", rng.choice(["AAAA", "BBBB", "CCCC"]))
        pages.append((i if i % 9 else None, f"http://h{i % 3}.com/", body))
    store = {M.address_digest(f"http://h{h}.com/i/{n}.png"): (f"c{h}{n}", "image/png", h) for h in (0, 1) for n in ("AAAA", "BBBB")}
    pay = spark.createDataFrame([(d, m, n, c) for d, (c, m, n) in store.items()] + [("unused", "x", 1, "c")], "digest string, mime string, n_bytes long, content string")
    got = collections.Counter()
    for r in M.media_sequences(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), pay, (*M.MEDIA_TAGS, "a")).collect():
        assert [x.position for x in r.sequence] == list(range(len(r.sequence)))
        got[r.page_id, r.n_text, r.n_media, r.n_resolved, tuple(x.text or (x.tag, x.src, x.caption, x.content) for x in r.sequence)] += 1
    want = collections.Counter()
    for i, url, body in pages:
        x = Simple()
        x.feed(body)
        x.end()
        seq, resolved = [], 0
        for item in x.out:
            if isinstance(item, str):
                seq.append(item)
                continue
            tag, src, caption = item
            src = src if src.startswith("data:") else url[:-1] + src
            content = src.partition(",")[2] if src.startswith("data:") else store.get(hashlib.sha256(src.encode()).hexdigest(), (None,))[0]
            resolved += content is not None
            seq.append((tag, src, caption, content))
        n = sum(isinstance(s, str) for s in seq)
        want[i, n, len(seq) - n, resolved, tuple(seq)] += 1
    assert got == want and any(k[3] for k in want)


def test_media_links_resolve_to_whole_pages(spark):
    """A page is the payload of its address: its text, not a hash of it; of an address with several pages the least one."""
    html = {1: "<p>one <a href=/b#top>b</a> <a href=/none>none</a>", 2: "<p>two <a href='http://h.com/a'>a</a>", 3: "<p>a third ü of the address of 2"}
    pages = spark.createDataFrame([(1, "http://h.com/a", html[1]), (2, "http://h.com/b", html[2]), (3, "http://h.com/b#x", html[3]), (4, "http://h.com/c", None)], "page_id long, url string, html string")
    out = {r.page_id: r for r in M.media_sequences(pages, M.page_payloads(pages), (*M.MEDIA_TAGS, "a")).collect()}
    got = {k: [(x.mime, x.n_bytes, x.content) for x in r.sequence if x.kind == "media"] for k, r in out.items()}
    least = min(html[2], html[3])
    assert got == {1: [("text/html", len(least.encode()), least), (None, None, None)], 2: [("text/html", len(html[1]), html[1])], 3: [], 4: []}
    assert {k: r.n_resolved for k, r in out.items()} == {1: 1, 2: 1, 3: 0, 4: 0}


def shuffled(spark) -> dict[int, int]:
    """Bytes that the stages so far wrote to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_media_pages_with_payloads_of_their_own_are_not_shuffled(spark):
    rng = random.Random(23)
    text = lambda: "".join(chr(rng.randrange(97, 123)) for _ in range(6000))
    pages = [(i, f"http://h.com/{i}", f"<style>{text()}</style><p>{text()}<a href=/{i + 1000}>x</a><script>{i}</script>") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    before = shuffled(spark)
    out = M.media_sequences(df, M.page_payloads(df), (*M.MEDIA_TAGS, "a", "style", "script")).collect()
    new = [n for k, n in shuffled(spark).items() if k not in before]
    assert new and sum(new) < 0.2 * sum(len(h) for *_, h in pages)
    assert all(r.n_media == 3 and r.n_resolved == 2 for r in out)
    assert {r.page_id: "<style>%s</style><p>%s<a href=/%d>x</a><script>%s</script>" % (r.sequence[0].content, r.sequence[1].text, r.page_id + 1000, r.sequence[3].content) for r in out} == {i: h for i, _, h in pages}


def test_media_least_payload_counts_wherever_it_is_held(spark):
    """The same bytes as a style and as a script, on one page or on two, and with a given payload: all items get the least of them."""
    rows = [(1, "<style>a</style><script>a</script>"), (2, "<script>b</script>"), (3, "<style>b</style>"), (4, "<script>c</script>"), (5, "<script>d</script>"), (6, "<style>d</style><img src='data:text/plain,d'>")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    pay = spark.createDataFrame([(hashlib.sha256(b"c").hexdigest(), None, 7, "a given one")], "digest string, mime string, n_bytes long, content string")
    out = M.media_sequences(pages, pay, (*M.MEDIA_TAGS, "style", "script")).collect()
    css = [("text/css", 1, x) for x in "ab"]
    assert {r.page_id: [(x.mime, x.n_bytes, x.content) for x in r.sequence] for r in out} == {1: css[:1] * 2, 2: css[1:], 3: css[1:], 4: [(None, 7, "a given one")], 5: [("text/plain", 1, "ZA==")], 6: [("text/plain", 1, "ZA==")] * 2}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 60)
        if i % 6 == 0:
            w[5:5] = ["scum", "rotter", "vilething", "scum"]
        rows.append((i, " ".join(w), "en", f"src{i % 4}", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "src9", 0) for i in range(1, 5)]
    near = rows[7][1].split()
    near[3] = "changed"
    rows.append((2000, " ".join(near), "en", "src9", 0))
    rows = [(*r[:4], len(r[1])) for r in rows]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({c: [r[k] for r in rows] for k, c in enumerate(names)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({c: [r[k] for r in labels] for k, c in enumerate(("doc_id", "quality", "toxic"))}), tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/out-{len(seen)}")
        seen.append(docs)
        if len(seen) < len(P.STAGES):
            assert docs.columns == names
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[0]) == {r[0] for r in rows if r[0] % 6 or r[0] >= 1000} - {r[0] for r in rows if r[0] >= 1000 and (r[0] - 1000) % 6 == 0 and r[0] < 2000}
    assert set(ids[0]) - set(ids[1]) == {1001, 1002, 1003, 1004} and set(ids[1]) - set(ids[2]) == {2000}
    assert set(ids[3]) <= set(ids[2]) and len(ids[4]) == len(ids[3])
    assert all(r.round_trip for r in seen[4].collect())
    assert P.run(spark, str(tmp_path)).count() == len(ids[4])
