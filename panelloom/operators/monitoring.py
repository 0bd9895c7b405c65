"""Drift, strategy health, operation log and alert throttling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, nz, stage
from panelloom.functions.columns import TRADING_DAYS
from panelloom.functions.order_stats import SLICE_ROWS, STEPS

c = F.col


def two_samples(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Long ``(feature, value, is_ref)`` of both samples without nulls."""
    long = lambda df, ref: df.select(*[c(f).cast("double").alias(f) for f in features]).unpivot(
        [], features, "feature", "value").dropna().withColumn("is_ref", F.lit(ref))
    return stage(long(reference, 1).unionByName(long(current, 0)), "samples")


def _by_feature():
    """A function for the tasks, nested so that it travels with them."""

    def parts(batch):
        """``(feature, values, is_ref)`` of a batch; one zero only."""
        codes = batch.column("feature").dictionary_encode()
        at, value = codes.indices.to_numpy(), batch.column("value").to_numpy(zero_copy_only=False) + 0.0
        ref = batch.column("is_ref").to_numpy(zero_copy_only=False) == 1
        for i, name in enumerate(codes.dictionary.to_pylist()):
            own = at == i
            yield name, value[own], ref[own]

    return parts


def _counted(samples: DataFrame, bins: dict[str, np.ndarray], place) -> DataFrame:
    """``(feature, bin, r, k)``: values of both samples in each bin, added up inside the tasks;
    ``place(edges, values)`` finds the bins, from 0 to the number of edges."""
    parts = _by_feature()

    def count(batches):
        found = {f: np.zeros((2, len(e) + 1), "int64") for f, e in bins.items()}
        for batch in batches:
            for f, v, ref in parts(batch):
                if f in bins:
                    at = place(bins[f], v)
                    found[f][0] += np.bincount(at[ref], minlength=len(bins[f]) + 1)
                    found[f][1] += np.bincount(at[~ref], minlength=len(bins[f]) + 1)
        for f, (r, k) in found.items():
            yield pa.RecordBatch.from_pydict({"feature": pa.array([f] * len(r)), "bin": pa.array(np.arange(len(r), dtype="int32")), "r": r, "k": k})

    return samples.mapInArrow(count, "feature string, bin int, r long, k long").groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))


class Profile:
    """Exact places of the values of two samples, by slices between approximate cut points.

    Cut points (at most ``STEPS`` a feature) and slice counts reach the driver.  The values cross
    one shuffle, packed by slice; equal ones are counted before, so copies do not pile up.  Each
    slice gives its largest distance of the two distributions and the reference's order
    statistics at the edges of ``bins`` quantile bins.
    """

    def __init__(self, samples: DataFrame, bins: int = 10, slice_rows: int = SLICE_ROWS, flush: int = 1_000_000):
        self.samples, self.bins = samples, bins
        steps = F.percentile_approx("value", F.lit([i / STEPS for i in range(1, STEPS)]), F.lit(4 * STEPS))
        seen = samples.groupBy("feature").agg(F.sum("is_ref").alias("n"), F.sum(1 - c("is_ref")).alias("m"), steps.alias("q")).collect()
        self.sizes = sizes = {x.feature: (x.n, x.m) for x in seen}
        pieces = {x.feature: min(STEPS, -(-(x.n + x.m) // slice_rows)) for x in seen}
        cuts = {x.feature: np.unique(np.array([x.q[i * STEPS // pieces[x.feature] - 1] for i in range(1, pieces[x.feature])], "float64") + 0.0) for x in seen}
        place = lambda e, v: np.searchsorted(e, v, "left")
        before: dict = {}
        total = {f: (0, 0) for f in cuts}
        for x in _counted(samples, cuts, place).orderBy("feature", "bin").collect():
            before[x.feature, x.bin] = total[x.feature]
            total[x.feature] = total[x.feature][0] + x.r, total[x.feature][1] + x.k
        parts = _by_feature()

        def pack(batches):
            held: dict = {}

            def emptied():
                for f, pieces in held.items():
                    v, at = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
                    r = np.bincount(at, np.concatenate([p[1] for p in pieces]), len(v)).astype("int64")
                    k = np.bincount(at, minlength=len(v)) - r
                    bounds = np.searchsorted(v, cuts[f], "right")  # a slice ends with its cut point
                    for i, (x, y) in enumerate(zip([0, *bounds], [*bounds, len(v)], strict=True)):
                        if x < y:
                            yield f, i, v[x:y].tobytes(), r[x:y].tobytes(), k[x:y].tobytes()
                held.clear()

            def batch_of(rows):
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["feature", "slice", "v", "r", "k"])

            n = 0
            for batch in batches:
                for f, v, ref in parts(batch):
                    held.setdefault(f, []).append((v, ref))
                n += batch.num_rows
                if n >= flush:
                    yield batch_of(list(emptied()))
                    n = 0
            if n:
                yield batch_of(list(emptied()))

        def measure(key, table):
            f, i = key[0].as_py(), key[1].as_py()
            read = lambda x, t: np.concatenate([np.frombuffer(b, t) for b in table.column(x).to_pylist()])
            v, at = np.unique(read("v", "float64"), return_inverse=True)
            (r0, k0), (n, m) = before[f, i], sizes[f]
            r = r0 + np.cumsum(np.bincount(at, read("r", "int64"), len(v)).astype("int64"))
            k = k0 + np.cumsum(np.bincount(at, read("k", "int64"), len(v)).astype("int64"))
            gap = float(np.abs(r / n - k / m).max()) if n and m else None
            ranks = {min(int((n - 1) * (j / bins)) + s, n) for j in range(bins + 1) for s in (1, 2)} if n else set()
            own = sorted(p for p in ranks if r0 < p <= r[-1])
            return pa.table({"feature": [f], "gap": pa.array([gap], pa.float64()), "at": pa.array([own], pa.list_(pa.int64())),
                             "value": pa.array([v[np.searchsorted(r, own, "left")] if own else []], pa.list_(pa.float64()))})

        packed = samples.mapInArrow(pack, "feature string, slice int, v binary, r binary, k binary")
        self.slices = stage(packed.groupBy("feature", "slice").applyInArrow(measure, "feature string, gap double, at array<bigint>, value array<double>"), "profile")

    def edges(self) -> dict[str, np.ndarray]:
        """Distinct linear-interpolated quantiles of the reference, for features that have one."""
        values: dict = {}
        for x in self.slices.where(F.size("at") > 0).collect():
            values.setdefault(x.feature, {}).update(zip(x.at, x.value, strict=True))
        out = {}
        for f, at in values.items():
            n, edges = self.sizes[f][0], []
            for j in range(self.bins + 1):
                h = (n - 1) * (j / self.bins)
                lo, hi = at[int(h) + 1], at[min(int(h) + 2, n)]
                edges.append(lo + (hi - lo) * (h - int(h)))
            out[f] = np.unique(np.array(edges) + 0.0)
        return out


def psi(samples: DataFrame, bins: int = 10, min_values: int = 10, profile: Profile | None = None) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins.

    Equal edges merge; fewer than three edges or too few values give 0.  Values outside
    the reference range are dropped, the last bin is closed.
    """
    profile = profile or Profile(samples, bins)
    edges = profile.edges()

    def place(e, v):
        at = np.searchsorted(e, v, "right")
        return np.where(v == e[-1], len(e) - 1, np.where(v > e[-1], 0, at))

    sizes = [(f, len(e), *profile.sizes[f]) for f, e in edges.items()]
    features = samples.sparkSession.createDataFrame(sizes, "feature string, n_edges int, n_ref long, n_cur long")
    per_bin = stage(_counted(samples, edges, place).where("bin > 0"), "bins")
    inside = per_bin.groupBy("feature").agg(F.sum("r").alias("in_ref"), F.sum("k").alias("in_cur"))
    grid = features.join(inside, "feature", "left").withColumn(
        "bin", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), c("n_edges") - 1)))).join(per_bin, ["feature", "bin"], "left")
    share = lambda n, total: F.greatest(F.coalesce(c(n), F.lit(0)) / F.greatest(F.coalesce(c(total), F.lit(0)), F.lit(1)), F.lit(1e-6))
    r, k = share("r", "in_ref"), share("k", "in_cur")
    usable = (F.max("n_ref") >= min_values) & (F.max("n_cur") >= min_values) & (F.max("n_edges") >= 3)
    return grid.groupBy("feature").agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
        F.when(usable, F.sum((k - r) * F.ln(k / r))).otherwise(0.0).alias("psi"))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    t = d * F.sqrt(n * m / (n + m))
    series = sum((F.lit(2.0 * (-1.0) ** (k - 1)) * F.exp(-2.0 * k * k * t * t) for k in range(1, 51)), F.lit(0.0))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_test(samples: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Largest distance of the two empirical distributions per feature, and its p-value."""
    profile = profile or Profile(samples)
    sizes = samples.sparkSession.createDataFrame([(f, *nm) for f, nm in profile.sizes.items()], "feature string, n long, m long")
    g = profile.slices.groupBy("feature").agg(F.max("gap").alias("ks_statistic")).join(F.broadcast(sizes), "feature")
    return g.select("feature", "ks_statistic", kolmogorov_p(c("ks_statistic"), c("n"), c("m")).alias("ks_pvalue"))


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], min_samples: int = 30, psi_limit: float = 0.2, p_limit: float = 0.05) -> DataFrame:
    samples = two_samples(reference, current, features)
    profile = Profile(samples)
    df = psi(samples, profile=profile).join(ks_test(samples, profile), "feature").where((c("n_ref") >= min_samples) & (c("n_cur") >= min_samples))
    bad = (c("psi") > psi_limit) | (c("ks_pvalue") < p_limit)
    return df.select("feature", "psi", "ks_statistic", "ks_pvalue", bad.alias("drifted"),
                     F.when(c("psi") > psi_limit, "CRITICAL").when(bad, "WARNING").otherwise("OK").alias("severity"))


def drift_rate(report: DataFrame, n_features: int) -> DataFrame:
    return report.agg((F.coalesce(F.sum(c("drifted").cast("double")), F.lit(0.0)) / max(n_features, 1)).alias("drift_rate"))


def prediction_drift(reference: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """Stricter PSI limit, and the shifts of mean and population deviation."""
    samples = two_samples(reference, current, [score])
    pick = lambda ref: F.when(c("is_ref") == ref, c("value"))
    shift = samples.groupBy("feature").agg(
        (F.avg(pick(0)) - F.avg(pick(1))).alias("mean_shift"), (F.stddev_pop(pick(0)) - F.stddev_pop(pick(1))).alias("std_shift"))
    return feature_drift(reference, current, [score], psi_limit=0.1).join(shift, "feature").select(
        "feature", "psi", "ks_statistic", "ks_pvalue", "mean_shift", "std_shift", "drifted")


# -- strategy --------------------------------------------------------------------------

def sharpe_check(daily: DataFrame, window: int = 63, minimum: float = 0.5, risk_free: float = 0.065) -> DataFrame:
    fr = Frames(Window.partitionBy("portfolio_id").orderBy("date"))
    rf = (1 + risk_free) ** (1 / TRADING_DAYS) - 1
    s = (fr.roll(F.avg, "net", window) - rf) / nz(fr.roll(F.stddev_samp, "net", window)) * math.sqrt(TRADING_DAYS)
    df = fr.add(daily, {"s": s})
    # the struct keeps the last day even where its value is null
    latest = F.coalesce(F.max(F.struct("date", "s"))["s"], F.lit(0.0))
    return df.groupBy("portfolio_id").agg(
        latest.alias("latest_sharpe"), F.avg("s").alias("mean_sharpe"), F.min("s").alias("min_sharpe"),
        F.avg((c("s") > 0).cast("double")).alias("pct_positive"), (latest < minimum).alias("breach"))


def ic_check(ic: DataFrame, dates: DataFrame, window: int = 21, minimum: float = 0.02) -> DataFrame:
    """Rolling IC over ``dates``; a date without a usable IC counts 0 (``ic``: date, ic)."""
    df = dates.select("date").distinct().join(ic.select("date", "ic"), "date", "left").fillna(0.0, ["ic"]).withColumn("series", F.lit(0))
    fr = Frames(Window.partitionBy("series").orderBy("date"))
    df = fr.add(df, {"m": fr.roll(F.avg, "ic", window)})
    latest, sd = F.coalesce(F.max(F.struct("date", "m"))["m"], F.lit(0.0)), F.stddev_samp("ic")
    return df.agg(latest.alias("latest_ic"), F.avg("m").alias("mean_ic"),
                  F.when(sd > 0, F.avg("ic") / nz(sd)).otherwise(0.0).alias("ic_ir"),
                  F.avg((c("ic") > 0).cast("double")).alias("pct_positive"), (latest < minimum).alias("breach"))


def drawdown_check(daily: DataFrame, breach: float = -0.20) -> DataFrame:
    """Current and worst drawdown; duration from the trough to the last day below -0.01 %."""
    now = F.max_by("drawdown", "date")
    days = F.datediff(F.max(F.when(c("drawdown") < -1e-4, c("date"))), F.min(F.struct("drawdown", "date"))["date"])
    return daily.groupBy("portfolio_id").agg(
        now.alias("current_drawdown"), F.min("drawdown").alias("max_drawdown"),
        F.greatest(F.lit(0), F.coalesce(days, F.lit(0))).alias("duration_days"), (now < breach).alias("breach"))


# -- operations ------------------------------------------------------------------------

def latency_summary(log: DataFrame, since=None) -> DataFrame:
    """Latency per operation over the whole log, or over its records from ``since`` on."""
    recent = log if since is None else log.where(c("ts") >= F.lit(since))
    p = lambda q: F.percentile("latency_ms", F.lit(q))
    return recent.groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"), F.avg("latency_ms").alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"),
        p(0.99).alias("p99_ms"), F.max("latency_ms").alias("max_ms"))


def error_summary(log: DataFrame) -> DataFrame:
    """Error rate of every operation that had an error."""
    g = log.groupBy("operation").agg(F.sum((~c("success")).cast("bigint")).alias("errors"), F.count(F.lit(1)).alias("calls"))
    return g.where("errors > 0").withColumn("error_rate", c("errors") / c("calls"))


def threshold_alerts(log: DataFrame, warn_ms: float = 500.0, critical_ms: float = 2000.0, warn_rate: float = 0.01, critical_rate: float = 0.05) -> DataFrame:
    """Severity counts per operation: slow records and the error rate."""
    sev = F.when(c("latency_ms") >= critical_ms, "CRITICAL").when(c("latency_ms") >= warn_ms, "WARNING")
    slow = log.withColumn("severity", sev).where("severity is not null").groupBy("operation", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("value")).withColumn("metric", F.lit("latency"))
    rate = F.when(c("error_rate") >= critical_rate, "CRITICAL").when(c("error_rate") >= warn_rate, "WARNING")
    errors = error_summary(log).withColumn("severity", rate).where("severity is not null").select(
        "operation", "severity", c("errors").alias("n"), c("error_rate").alias("value"), F.lit("error_rate").alias("metric"))
    return slow.unionByName(errors)


def health(alerts: DataFrame) -> DataFrame:
    worst = F.max(F.when(c("severity") == "CRITICAL", 2).when(c("severity") == "WARNING", 1).otherwise(0))
    return alerts.agg(
        F.sum((c("severity") == "CRITICAL").cast("bigint")).alias("critical"), F.sum((c("severity") == "WARNING").cast("bigint")).alias("warning"),
        F.when(worst == 2, "CRITICAL").when(worst == 1, "WARNING").otherwise("HEALTHY").alias("overall_health"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def recent_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(c("ts").desc(), c("event_id").desc()).limit(n)


KEY = ("category", "metric", "severity")


def quiet_periods(alerts: DataFrame, cooldown: float = 300.0) -> DataFrame:
    """Add ``episode``: alerts of one key between two pauses of at least ``cooldown`` seconds.

    The first alert after such a pause always fires, so episodes are independent.  Pauses
    are found on the first and last time per key and time cell of one cool-down (a pause
    cannot hide inside a cell), so the alerts themselves are not sorted per key.
    """
    df = alerts.withColumn("t", c("ts").cast("double")).withColumn("cell", F.floor(c("t") / cooldown))
    cells = df.groupBy(*KEY, "cell").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = Window.partitionBy(*KEY).orderBy("cell")
    fresh = F.coalesce(c("a") - F.lag("b").over(w) >= cooldown, F.lit(True)).cast("int")
    cells = cells.withColumn("__f", fresh).withColumn("episode", F.sum("__f").over(w))
    return df.join(cells.select(*KEY, "cell", "episode"), [*KEY, "cell"])


def cooldown_filter(alerts: DataFrame, cooldown: float = 300.0) -> DataFrame:
    """Alerts that fire when a key stays silent for ``cooldown`` seconds after each firing.

    Whole episodes lie in one partition in time order and stream through it batch by
    batch; the state is the episode at hand and its last firing.
    """

    def fire(batches: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:
        current, last = None, 0.0
        for pdf in batches:
            keep = []
            for *episode, t in pdf[[*KEY, "episode", "t"]].itertuples(index=False):
                hit = episode != current or t - last >= cooldown
                current, last = episode, t if hit else last
                keep.append(hit)
            yield pdf.loc[keep, ["event_id"]]

    rows = quiet_periods(alerts, cooldown).select(*KEY, "episode", "t", "event_id")
    ordered = rows.repartition(*KEY, "episode").sortWithinPartitions(*KEY, "episode", "t", "event_id")
    return alerts.join(ordered.mapInPandas(fire, "event_id bigint"), "event_id", "left_semi")


def throttle(alerts: DataFrame, cooldown: float = 300.0, hourly_cap: int = 100) -> DataFrame:
    """Cool-down per key plus a cap on firings per rolling hour over all keys of a ``service``.

    The cap couples the keys, so a service is one ordered pass.  It streams through its
    group batch by batch: the state is the last firing of each key and at most ``cap`` times.
    """

    def fire(batches: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:
        from collections import deque

        last: dict[tuple, float] = {}
        hour: deque = deque()
        for pdf in batches:
            keep = []
            for t, *key in pdf[["t", *KEY]].itertuples(index=False):
                while hour and t - hour[0] >= 3600.0:
                    hour.popleft()
                hit = t - last.get(tuple(key), -float("inf")) >= cooldown and len(hour) < hourly_cap
                if hit:
                    last[tuple(key)] = t
                    hour.append(t)
                keep.append(hit)
            yield pdf.loc[keep, ["event_id"]]

    import pandas as pd

    fire.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    rows = alerts.select("service", "event_id", *KEY, c("ts").cast("double").alias("t"))
    ordered = rows.repartition("service").sortWithinPartitions("service", "t", "event_id")
    fired = ordered.groupBy("service").applyInPandas(fire, "event_id bigint")
    return alerts.join(fired, "event_id", "left_semi")
