"""Operators whose rows depend on what was accepted before: in order within small keyed groups, so groups run in parallel."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ratchet of the protective stop, in units of the initial risk.
ACTIVATION, BREAK_EVEN, FIRST_STOP, GIVEBACK = 0.5, 0.9, -0.75, 0.5


#: Rows of small groups that are handled in one call.
ROWS = 1 << 17


def in_buckets(rows: DataFrame, keys: list[str], run, kind: str) -> DataFrame:
    """run over many whole groups at a time: the groups are spread over buckets of about ROWS rows, for a call costs more than a small group."""
    n = max(1, -(-rows.count() // ROWS))
    return rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("_bucket")).applyInPandas(run, kind)


def by_group(pdf: pd.DataFrame, keys: list[str], order: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows group by group, each in order, and where the groups begin."""
    pdf = pdf.assign(_group=pdf.groupby(keys, dropna=False, sort=False).ngroup()).sort_values(["_group", *order])
    return pdf, np.flatnonzero(np.diff(pdf._group.to_numpy(), prepend=-1))


def source_dedup(messages: DataFrame) -> DataFrame:
    """Messages (source, seq, url, title): the first of each address and of each title within its source; dropped ones register no key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        urls, titles, keep = set(), set(), []
        for u, t in zip(pdf.sort_values("seq").url, pdf.sort_values("seq").title):
            ok = bool(u or t) and not (u and u in urls) and not (t and t in titles)
            keep.append(ok)
            if ok:
                urls.add(u)
                titles.add(t)
        return pdf.sort_values("seq")[keep][["source", "seq"]]

    return messages.groupBy("source").applyInPandas(run, "source string, seq long")


def tokens_of(title: str | None) -> set[str]:
    return set(re.findall(r"[a-z0-9]{2,}", title)) if title else set()


def similarity(a: str, b: str, x: set[str] | None = None, y: set[str] | None = None) -> float:
    """x, y: the titles' tokens where they are known."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 12 and short in long:
        return 0.86
    x, y = tokens_of(a) if x is None else x, tokens_of(b) if y is None else y
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def leader_clusters(messages: DataFrame, least: float = 0.5) -> DataFrame:
    """Messages (batch, seq, title): each joins the first cluster whose anchor has its title or is similar to it, else it is an anchor. Greedy and in order within a bounded batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        anchors, by_title, out = [], {}, []
        for seq, title in zip(pdf.seq, pdf.title):
            at = by_title.get(title) if title else None
            if at is None:
                x = tokens_of(title)  # once a title, not once a comparison
                at = next((s for s, t, y in anchors if similarity(title, t, x, y) >= least), None)
            if at is None:
                at = seq
                anchors.append((seq, title, x))
            by_title.setdefault(title, at)
            out.append(at)
        return pd.DataFrame({"batch": pdf.batch, "seq": pdf.seq, "anchor": out})

    return messages.groupBy("batch").applyInPandas(run, "batch long, seq long, anchor long")


def change_or_period_log(points: DataFrame, period_s: int = 60) -> DataFrame:
    """Points (key, ts_s, seq, mark): kept if the mark changed since the last one kept or the period is over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, mark, keep = None, None, []
        pdf = pdf.sort_values(["ts_s", "seq"])
        for t, m in zip(pdf.ts_s, pdf["mark"]):
            ok = last is None or t - last >= period_s or m != mark
            keep.append(ok)
            if ok:
                last, mark = t, m
        return pdf[keep][["key", "seq"]]

    return points.groupBy("key").applyInPandas(run, "key long, seq long")


def protection_replay(points: DataFrame, risk: float = 0.1) -> DataFrame:
    """Points (symbol, user_id, ts, seq, price): a long position from the first one on, with a stop that is only ever raised.

    Between activation and break-even the stop moves from FIRST_STOP to 0 in proportion; beyond it trails the best by GIVEBACK. Ends at the first price at or under the stop.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, begin = by_group(pdf, ["symbol", "user_id"], ["ts", "seq"])
        n = np.diff(np.append(begin, len(pdf)))
        group = np.repeat(np.arange(len(n)), n)
        price = pdf.price.to_numpy()
        r = (price / np.repeat(price[begin], n) - 1) / risk
        # The best so far of each group, by ranks, which groups keep apart.
        each, rank = np.unique(r, return_inverse=True)
        mfe = np.maximum(each[np.maximum.accumulate(group * np.int64(len(each)) + rank) - group * np.int64(len(each))], 0)
        rise = FIRST_STOP + np.clip((mfe - ACTIVATION) / (BREAK_EVEN - ACTIVATION), 0, 1) * -FIRST_STOP
        stop = np.where(mfe < ACTIVATION, -1.0, np.where(mfe < BREAK_EVEN, rise, np.maximum(0, mfe - GIVEBACK)))  # rises with the best, so it is never lowered
        before = np.concatenate([[-1.0], stop[:-1]])
        before[begin] = -1.0
        out = np.flatnonzero(r <= before)
        closed, first = np.unique(group[out], return_index=True)
        k = begin + n - 1
        k[closed] = out[first]
        seq = pd.Series(pd.array(pdf.seq.to_numpy()[k], dtype="Int64"))
        seq[~np.isin(np.arange(len(k)), closed)] = pd.NA
        rounded = lambda x: [round(float(v), 6) for v in x[k]]
        return pd.DataFrame({"symbol": pdf.symbol.to_numpy()[k], "user_id": pdf.user_id.to_numpy()[k], "exit_seq": seq, "stop_r": rounded(before), "mfe_r": rounded(mfe)})

    return in_buckets(points, ["symbol", "user_id"], run, "symbol string, user_id long, exit_seq long, stop_r double, mfe_r double")


def capped_weights(scores: np.ndarray, cap: float) -> np.ndarray:
    scores = np.maximum(scores, 0)
    scores = np.ones_like(scores) if not scores.any() else scores
    out, live, left = np.zeros(len(scores)), np.ones(len(scores), bool), 1.0
    while live.any():
        total = scores[live].sum()
        due = np.where(live, left * (scores / total if total > 0 else 1 / live.sum()), 0)
        over = live & (due > cap + 1e-12)
        if not over.any():
            out[live] = due[live]
            break
        out[over] = cap
        left -= cap * over.sum()
        live &= ~over
    return out / out.sum() if out.sum() > 0 else out


def markowitz(rows: DataFrame) -> DataFrame:
    """Rows (symbol, mu, returns): mean-variance weights of a universe of a few symbols, in one group: covariance shrunk off the diagonal, positive part, capped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        n = min(len(r) for r in pdf.returns)
        x = np.stack([np.asarray(r)[len(r) - n :] for r in pdf.returns])
        cov = np.atleast_2d(np.cov(x, bias=True))
        var = np.diag(cov)
        s = cov * 0.8
        np.fill_diagonal(s, var + 0.2 * var.mean())
        mu = np.maximum(pdf.mu.to_numpy(), 1e-6)
        w = np.maximum(np.linalg.solve(s, mu), 0)
        w = w if w.any() else mu / np.sqrt(np.maximum(var, 1e-12))
        w = capped_weights(w, max(0.35, 1 / len(pdf)))
        return pd.DataFrame({"symbol": pdf.symbol, "weight": np.round(w, 6)})

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda p: run(p), "symbol string, weight double")
