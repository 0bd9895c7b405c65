"""Covariance-based weighting.

The covariance of every rebalance is a distributed aggregate (:func:`covariance`).  Only
the dense solve of one rebalance's k x k matrix runs in a grouped pandas function; k is
the number of names that portfolio selects.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import calendar, nz, stage
from panelloom.operators.portfolio import KEYS, strategy

c = F.col


def covariance(selected: DataFrame, returns: DataFrame, panel: DataFrame, window: int = 252) -> DataFrame:
    """``(portfolio_id, rebal_date, i, j, cov)`` over the trailing ``window`` calendar days.

    A day without a trade is a zero return, so only days on which both names traded
    contribute products: the sums run over existing rows and no dense grid is built.
    Only selected names are paired.
    """
    cal = calendar(panel)
    sel = stage(selected.select(*KEYS, "ticker").join(cal.select(c("date").alias("rebal_date"), c("idx").alias("ridx")), "rebal_date"), "sel")
    r = returns.select("date", "ticker", "ret").join(cal, "date").select("ticker", "idx", "ret")
    hit = stage(sel.join(r, "ticker").where((c("idx") <= c("ridx")) & (c("idx") > c("ridx") - window)).select(
        *KEYS, "ticker", "idx", "ridx", "ret"), "window")
    days = F.least(F.lit(window), c("ridx")).cast("double")
    sums = hit.groupBy(*KEYS, "ticker").agg(F.sum("ret").alias("s"))
    a = hit.select(*KEYS, "idx", c("ticker").alias("i"), c("ret").alias("ri"))
    b = hit.select(*KEYS, "idx", c("ticker").alias("j"), c("ret").alias("rj"))
    cross = a.join(b, KEYS + ["idx"]).groupBy(*KEYS, "i", "j").agg(F.sum(c("ri") * c("rj")).alias("x"))
    one = lambda t, s: sel.select(*KEYS, "ridx", c("ticker").alias(t)).join(
        sums.select(*KEYS, c("ticker").alias(t), c("s").alias(s)), KEYS + [t], "left")
    grid = one("i", "si").join(one("j", "sj").drop("ridx"), KEYS)
    z = lambda x: F.coalesce(c(x), F.lit(0.0))
    return grid.join(cross, KEYS + ["i", "j"], "left").select(
        *KEYS, "i", "j", ((z("x") - z("si") * z("sj") / days) / (days - 1.0)).alias("cov"))


def mean_returns(selected: DataFrame, returns: DataFrame, panel: DataFrame, window: int = 252) -> DataFrame:
    """``(portfolio_id, rebal_date, ticker, mean)`` over the same days as :func:`covariance`."""
    cal = calendar(panel)
    sel = selected.select(*KEYS, "ticker").join(cal.select(c("date").alias("rebal_date"), c("idx").alias("ridx")), "rebal_date")
    r = returns.select("date", "ticker", "ret").join(cal, "date").select("ticker", "idx", "ret")
    near = (c("idx") <= c("ridx")) & (c("idx") > c("ridx") - window)
    days = F.least(F.lit(window), F.first("ridx")).cast("double")
    total = F.coalesce(F.sum(F.when(near, c("ret"))), F.lit(0.0))
    return sel.join(r, "ticker", "left").groupBy(*KEYS, "ticker").agg((total / days).alias("mean"))


def _risk_parity(cov, score, sweeps: int = 500, tolerance: float = 1e-12):
    """Equal risk shares, to convergence.

    The weights minimise w'Cw / 2 - mean(log w): one coordinate at a time, whose optimum is
    the positive root of a quadratic.  Every sweep lowers the target, so no start or guard
    matters, and weights stay positive."""
    n, own = len(cov), np.maximum(np.diag(cov), 1e-12)
    w = 1.0 / np.sqrt(own * n)
    pull = cov @ w
    for _ in range(sweeps):
        before = w.copy()
        for i in range(n):
            others = pull[i] - cov[i, i] * w[i]
            root = (np.sqrt(others * others + 4.0 * own[i] / n) - others) / (2.0 * own[i])
            pull += cov[:, i] * (root - w[i])
            w[i] = root
        if np.abs(w - before).max() <= tolerance * w.max():
            break
    return w


def risk_shares(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """``(portfolio_id, rebal_date, ticker, share)`` of each name in its portfolio's variance."""
    w = weights.select(*KEYS, c("ticker").alias("i"), c("weight").alias("wi"))
    v = weights.select(*KEYS, c("ticker").alias("j"), c("weight").alias("wj"))
    pulls = cov.select(*KEYS, "i", "j", "cov").join(w, [*KEYS, "i"]).join(v, [*KEYS, "j"])
    own = pulls.groupBy(*KEYS, "i").agg(F.sum(c("wi") * c("cov") * c("wj")).alias("part"))
    total = own.groupBy(*KEYS).agg(F.sum("part").alias("variance"))
    return own.join(total, KEYS).select(*KEYS, c("i").alias("ticker"), (c("part") / nz("variance")).alias("share"))


def _capped_simplex(v, cap):
    """Euclidean projection on {0 <= w <= cap, sum w = 1} by bisection on the shift."""
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, cap)


def _min_variance(cov, score, cap: float = 0.20, rounds: int = 1000):
    n = len(cov)
    if n * cap <= 1.0:
        return np.full(n, 1.0 / n)
    w, step = np.full(n, 1.0 / n), 1.0 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
    y, t = w, 1.0
    for _ in range(rounds):
        nxt = _capped_simplex(y - step * (cov @ y), cap)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - w)
        if np.abs(nxt - w).max() < 1e-10:
            return nxt
        w, t = nxt, t2
    return w


def _black_litterman(cov, score, tau: float = 0.05, aversion: float = 2.5):
    n = len(cov)
    prior = aversion * cov @ np.full(n, 1.0 / n)
    views = (score - 0.5) * 0.10
    prec, view_prec = np.linalg.pinv(tau * cov), np.diag(1.0 / np.maximum(np.diag(tau * cov), 1e-18))
    mean = np.linalg.solve(prec + view_prec, prec @ prior + view_prec @ views)
    return np.maximum(0.0, np.linalg.pinv(cov) @ mean / aversion)


def _kelly(cov, score, fraction: float = 0.5):
    return np.maximum(0.0, fraction * np.linalg.pinv(cov) @ ((score - 0.5) * 0.001))


def _leaf_order(dist):
    """Single linkage by Prim's tree: merge along sorted edges, concatenating member lists."""
    n = len(dist)
    seen, near = [0], [(dist[0, j], 0, j) for j in range(1, n)]
    edges = []
    while near:
        d, a, b = min(near)
        edges.append((d, a, b))
        seen.append(b)
        near = [min((x, i, j), (dist[b, j], b, j)) for x, i, j in near if j != b]
    # clusters are numbered in the order they form; the lower number comes first
    members, owner = {i: [i] for i in range(n)}, list(range(n))
    for step, (_, a, b) in enumerate(sorted(edges)):
        first, second = sorted((owner[a], owner[b]))
        members[n + step] = members.pop(first) + members.pop(second)
        for m in members[n + step]:
            owner[m] = n + step
    return members[owner[0]]


def _hrp(cov, score):
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    order = _leaf_order(np.sqrt(0.5 * (1 - corr)))
    w = np.ones(len(cov))

    def cluster_variance(ix):
        iv = 1.0 / np.maximum(np.diag(cov)[ix], 1e-18)
        iv /= iv.sum()
        return iv @ cov[np.ix_(ix, ix)] @ iv

    todo = [order]
    while todo:
        ix = todo.pop()
        if len(ix) < 2:
            continue
        left, right = ix[: len(ix) // 2], ix[len(ix) // 2:]
        vl, vr = cluster_variance(left), cluster_variance(right)
        w[left] *= 1 - vl / (vl + vr)
        w[right] *= vl / (vl + vr)
        todo += [left, right]
    return w


def solve(cov: DataFrame, fn, scores: DataFrame | None = None) -> DataFrame:
    """Apply ``fn(matrix, score vector) -> weights`` to every rebalance, normalised."""
    if scores is not None:
        s = scores.select(c("date").alias("rebal_date"), c("ticker").alias("i"), "score")
        cov = cov.join(s, ["rebal_date", "i"], "left")
    elif "score" not in cov.columns:
        cov = cov.withColumn("score", F.lit(None).cast("double"))
    cov = cov.withColumn("score", F.coalesce("score", F.lit(0.5)))

    def one(pdf):
        import pandas as pd

        m = pdf.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        score = pdf.groupby("i")["score"].first().reindex(m.index).to_numpy()
        n = len(m)
        w = np.ones(1) if n == 1 else np.asarray(fn(m.to_numpy(), score))
        w = w / w.sum() if np.isfinite(w).all() and w.sum() > 0 else np.full(n, 1.0 / n)
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "rebal_date": pdf["rebal_date"].iloc[0],
                             "ticker": m.index, "weight": w})

    return cov.groupBy(*KEYS).applyInPandas(one, "portfolio_id int, rebal_date date, ticker string, weight double")


@strategy("risk_parity")
def risk_parity(selected: DataFrame, cov: DataFrame, **_) -> DataFrame:
    return solve(cov, _risk_parity)


@strategy("min_variance")
def min_variance(selected: DataFrame, cov: DataFrame, **_) -> DataFrame:
    return solve(cov, _min_variance)


@strategy("black_litterman")
def black_litterman(selected: DataFrame, cov: DataFrame, scores: DataFrame | None = None, **_) -> DataFrame:
    return solve(cov, _black_litterman, scores)


@strategy("kelly")
def kelly(selected: DataFrame, cov: DataFrame, scores: DataFrame | None = None, means: DataFrame | None = None, **_) -> DataFrame:
    """Half-Kelly weights; expected returns from scores, else from ``means`` (:func:`mean_returns`)."""
    if scores is not None or means is None:
        return solve(cov, _kelly, scores)
    own = means.select(*KEYS, c("ticker").alias("i"), c("mean").alias("score"))
    return solve(cov.join(own, KEYS + ["i"], "left"), lambda m, mu: np.maximum(0.0, 0.5 * np.linalg.pinv(m) @ mu))


@strategy("hrp")
def hrp(selected: DataFrame, cov: DataFrame, **_) -> DataFrame:
    return solve(cov, _hrp)


def inverse_volatility(cov: DataFrame) -> DataFrame:
    """The closed-form start of risk parity, as plain columns."""
    from panelloom.operators.portfolio import normalize

    own = cov.where("i = j").select(*KEYS, c("i").alias("ticker"), "cov")
    sd = F.when(c("cov") > 0, F.sqrt("cov")).otherwise(1e-4)
    return normalize(own.select(*KEYS, "ticker", (F.lit(1.0) / sd).alias("weight")))
