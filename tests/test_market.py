"""The engine's own operators: fixture values, invariants and oracles."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as X
from tickloom.operators import models as M
from tickloom.operators import stateful as S
from tickloom.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_steps(spark):
    assert one(spark, X.floor_to_step(F.lit(0.0109), 0.002)) == pytest.approx(0.01)
    assert one(spark, X.align_to_step(F.lit(100.06), 0.1, "floor")) == pytest.approx(100)
    assert one(spark, X.align_to_step(F.lit(100.06), 0.1, "ceil")) == pytest.approx(100.1)


def test_poisson_tail_of_large_means(spark):
    """From 746 on, e^-lam is 0."""
    for k, lam in ((900, 900.0), (1700, 1667.25), (3, 2.5), (20, 0.05), (1, 4.0), (0, 2.0)):
        below = math.fsum(math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(k))
        assert one(spark, M.poisson_tail(F.lit(k), F.lit(lam))) == pytest.approx(max(0.0, 1 - below), abs=1e-9)


def test_safe_number_and_clamp(spark):
    assert one(spark, X.safe_number(F.lit(None).cast("string"), 7)) == 0
    assert one(spark, X.safe_number(F.lit("x"), 7)) == 7
    assert one(spark, X.safe_number(F.lit("2.5"), 7)) == 2.5
    assert one(spark, X.clamp(F.lit(None).cast("double"), 0, 1)) is None


def test_normal_cdf(spark):
    for v in (-2.0, 0.0, 0.7):
        assert one(spark, X.normal_cdf(F.lit(v))) == pytest.approx(0.5 * (1 + math.erf(v / math.sqrt(2))), abs=1e-6)


def test_models_on_a_drifting_series(spark):
    r = [0.0008 + math.sin(i / 5) * 0.00045 for i in range(96)]
    m = M.hmm(M.garch(M.gbm(spark.createDataFrame([(r,)], "r array<double>")))).first()
    assert m.g_up > 0.5 and m.v_alpha + m.v_beta < 1 and m.m_bull > m.m_bear
    assert m.m_bull + m.m_bear + m.m_range == pytest.approx(1, abs=1e-9)


def test_poisson_tail(spark):
    for k, lam in ((0, 1.5), (1, 0.5), (4, 2.2)):
        want = 1 - sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))
        assert one(spark, M.poisson_tail(F.lit(k), F.lit(lam))) == pytest.approx(want, abs=1e-12)


def test_capped_weights():
    w = S.capped_weights(np.array([10.0, 1, 1, 1]), 0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-9


def test_stop_is_never_lowered_and_ends_at_the_first_touch(spark):
    rows = [("s", 1, t, t, float(p)) for t, p in enumerate([100.0, 104, 106, 109, 112, 108, 103, 120])]
    got = S.protection_replay(spark.createDataFrame(rows, "symbol string, user_id long, ts long, seq long, price double")).first()
    assert got.exit_seq == 6 and got.stop_r == pytest.approx(0.7) and got.mfe_r == pytest.approx(1.2)


def test_positions_are_replayed_many_in_a_call(spark, monkeypatch):
    """Groups of a call don't touch each other, and there are as many calls as ROWS asks for, not one a group."""
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["s", "t"])) if k % 50 else None, int(rng.integers(0, 30)), int(rng.integers(0, 90)), k, float(rng.choice([90, 96, 100, 105, 108, 115]))) for k in range(900)]
    df = spark.createDataFrame(rows, "symbol string, user_id long, ts long, seq long, price double")
    want = {}
    for key in {r[:2] for r in rows}:
        mine = sorted((r[2:] for r in rows if r[:2] == key), key=lambda r: r[:2])
        mfe, stop, end = 0.0, -1.0, None
        for _, seq, price in mine:
            r, before = (price / mine[0][2] - 1) / 0.1, stop
            mfe = max(mfe, r)
            if mfe >= S.BREAK_EVEN:
                stop = max(stop, 0.0, mfe - S.GIVEBACK)
            elif mfe >= S.ACTIVATION:
                stop = max(stop, S.FIRST_STOP * (1 - (mfe - S.ACTIVATION) / (S.BREAK_EVEN - S.ACTIVATION)))
            if r <= before:
                end = seq
                break
        want[key] = (end, before, mfe)
    for most in (1 << 17, 40):
        monkeypatch.setattr(S, "ROWS", most)
        got = S.protection_replay(df)
        got = {(r.symbol, r.user_id): r[2:] for r in got.collect()}
        assert got.keys() == want.keys()
        for key, (end, before, mfe) in want.items():
            assert got[key][0] == end and got[key][1:] == pytest.approx((before, mfe), abs=2e-6)


def test_clusters_cut_each_title_once(monkeypatch):
    """Titles' tokens are cut once each, however many anchors they are compared with."""
    import pandas as pd

    class Messages:
        def groupBy(self, *_):
            return self

        def applyInPandas(self, run, _):
            return run

    cut = []
    monkeypatch.setattr(S.re, "findall", lambda p, t, f=__import__("re").findall: cut.append(t) or f(p, t))
    out = S.leader_clusters(Messages())(pd.DataFrame({"batch": 0, "seq": range(40), "title": [f"word{k} other{k} {'x' * (k % 3)}" for k in range(38)] + ["", None]}))
    assert out.anchor.tolist() == list(range(40)) and len(cut) == 38


def test_first_beyond_by_halving():
    """The first tick of an hour beyond a signal's bounds, as by looking at every one."""
    import pyarrow as pa

    from tickloom.plans.event_queries import first_beyond

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 200):
        ts, price = rng.integers(0, 50, n), np.where(rng.random(n) < 0.02, np.nan, np.round(rng.normal(100, 6, n), 1))
        when = lambda x: pa.array(x).cast(pa.timestamp("us"))
        opened, tp, sl = rng.integers(-5, 55, 80), rng.uniform(101, 118, 80), rng.uniform(82, 99, 80)
        signals = pa.table({"symbol": ["s"] * 80, "user_id": np.arange(80), "opened": when(opened), "until": when(opened + 30), "tp": tp, "sl": sl})
        got = first_beyond(pa.table({"ts": when(ts), "event_id": np.arange(n), "price": price}), signals)
        got = {u: (t, repr(p)) for u, t, p in zip(*(got.column(c).to_pylist() for c in ("user_id", "ts", "price")))}
        want = {}
        for u in range(80):
            for k in np.lexsort((np.arange(n), ts)):
                if opened[u] < ts[k] <= opened[u] + 30 and (price[k] >= tp[u] or price[k] <= sl[u] or np.isnan(price[k])):
                    want[u] = (when(ts)[int(k)].as_py(), repr(float(price[k])))
                    break
        assert got == want


@pytest.mark.parametrize("n", [4, 9, 300])
def test_challenger_without_numbering_all_trades(spark, tmp_path, n):
    """Equal trades at the border between the parts are shared out as their numbers would; no window holds all trades."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT k::bigint AS o_orderkey, (k % 3)::bigint AS o_custkey FROM range({n}) t(k)")
    con.execute(f"""CREATE TABLE lineitem AS SELECT (k // 30)::bigint AS l_orderkey, 1::bigint AS l_partkey, 2::bigint AS l_suppkey, (k // 7 % 4)::int AS l_linenumber, 5.0::double AS l_quantity, 100.0 + k // 7 AS l_extendedprice,
      (k // 7 % 11) / 100.0::double AS l_discount, (k // 7 % 8) / 100.0::double AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (k // 14)::int AS l_shipdate FROM range({n}) t(k)""")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = QUERIES["champion_challenger"](spark, str(tmp_path))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(ORACLES["champion_challenger"]).fetchall())


def test_change_or_period(spark):
    rows = [(1, t, k, m) for k, (t, m) in enumerate([(0, "a"), (10, "a"), (20, "b"), (61, "b"), (81, "b")])]
    got = S.change_or_period_log(spark.createDataFrame(rows, "key long, ts_s long, seq long, mark string"))
    assert sorted(r.seq for r in got.collect()) == [0, 2, 4]


def test_source_dedup_and_clusters(spark):
    rows = [("s", 1, "u1", "A"), ("s", 2, "u1", "B"), ("s", 3, "u2", "B"), ("s", 4, "u3", "B"), ("t", 5, "u1", "A"), ("s", 6, "", "")]
    got = S.source_dedup(spark.createDataFrame(rows, "source string, seq long, url string, title string"))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5]
    rows = [(0, 1, "fed cuts rates by half"), (0, 2, "other news today"), (0, 3, "fed cuts rates by a half"), (0, 4, "other news today")]
    got = S.leader_clusters(spark.createDataFrame(rows, "batch long, seq long, title string"))
    assert {r.seq: r.anchor for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_title_pairs_by_rare_tokens(spark, tmp_path, monkeypatch):
    """Equal titles are one class, cut into slices; every pair of a source is found once, without joining all rows of a frequent token."""
    from tickloom.plans import stateful_queries as Q

    monkeypatch.setattr(Q, "SLICE", 3, raising=False)
    rng = np.random.default_rng(5)
    titles = [["the", *rng.choice(list("abcdefgh"), 4)] for _ in range(60)] + [["the", "same"]] * 9 + [["the"], []]
    rows = [(k, f"s{k % 2}", " ".join(w * 2 for w in t) + ". more") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets, want = [set(t) for t in titles], set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][1] == rows[b][1] and sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.5:
                want.add((a, b, round(j, 4)))
    df = Q.title_pairs(spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()  # compared where they meet, not by counting shared tokens


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["candles_1h", "atr14", "market_analysis", "calibration_grouping_sets", "asof_forward_settlement", "equity_drawdown", "stream_candles", "feed_rss_items", "feed_exchange_rules", "feed_price_sentiment", "event_classify", "symbol_event_aggregate", "signal_first_touch", "exit_score", "exit_factor_stats", "trade_history_upsert", "archive_retention", "market_tracking", "similar_titles", "portfolio_variance"])
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "documents", "part"):
        p = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    flat = lambda v: round(v, 4) if isinstance(v, float) else str(v)
    got = sorted(str([flat(r[c]) for c in cols]) for r in df.collect())
    q = con.execute(ORACLES[name])
    at = [[x[0] for x in q.description].index(c) for c in cols]
    assert got == sorted(str([flat(r[k]) for k in at]) for r in q.fetchall())
