"""Walk-forward splits, distributed boosted trees, scores, confidence and importance."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import average_rank, calendar, nz, percent_rank, quantiles, stage, with_stats
from panelloom.operators.alpha import spearman

c = F.col


# -- splits ------------------------------------------------------------------------------

def walk_forward_splits(panel: DataFrame, train_years: int = 3, horizon: int = 60, embargo: int = 10, min_rows: int = 500, months: int = 1) -> DataFrame:
    """Rolling splits: monthly prediction dates on trading days, training up to horizon + embargo
    calendar days earlier and ``train_years`` back, at least ``min_rows`` rows.

    Everything is decided on rows-per-day counts, one row per calendar day.
    """
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    start = F.add_months("a", 12 * train_years)
    month = F.trunc(start, "month")
    first = F.when(month == start, month).otherwise(F.add_months(month, 1))
    ticks = span.where(first <= c("b")).select(F.explode(F.sequence(
        first, c("b"), F.make_interval(months=F.lit(months)))).alias("tick"))
    # next trading day: line ticks up with the calendar, nearest day at or after
    lined = ticks.select(c("tick").alias("date"), F.lit(0).alias("t")).unionByName(days.select("date", F.lit(1).alias("t")))
    w = Window.partitionBy(F.lit(0)).orderBy(c("date").desc(), c("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = lined.withColumn("pred_date", F.last(F.when(c("t") == 1, c("date")), ignorenulls=True).over(w))
    preds = near.where("t = 0 and pred_date is not null").select("pred_date").distinct()
    splits = preds.withColumn("train_end", F.date_sub("pred_date", horizon + embargo)).withColumn(
        "train_start", F.add_months("train_end", -12 * train_years))
    hit = (c("date") >= c("train_start")) & (c("date") <= c("train_end"))
    sized = splits.join(days, hit).groupBy("pred_date", "train_start", "train_end").agg(F.sum("rows").alias("train_rows"))
    return sized.where(c("train_rows") >= min_rows).withColumn(
        "split_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pred_date")))


def time_split(df: DataFrame, validation: float = 0.2) -> DataFrame:
    """``role`` train or validation by date order; the last share of dates validates."""
    cal = calendar(df)
    n = cal.agg(F.max("idx")).first()[0]
    cut = int(n * (1 - validation))
    return df.join(cal.select("date", F.when(c("idx") <= cut, "train").otherwise("validation").alias("role")), "date")


def cv_folds(df: DataFrame, n_folds: int = 5, first: float = 0.4, expanding: bool = True, min_train: int = 200, min_test: int = 50) -> DataFrame:
    """Fold table over date positions: expanding or fixed-width training, then one test block."""
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    days = days.join(calendar(df), "date")
    n = days.agg(F.max("idx")).first()[0]
    head = int(n * first)
    block = int(n * (1 - first) / n_folds)
    if block == 0:
        raise ValueError("not enough dates for the requested number of folds")
    starts = [(k + 1, head + k * block) for k in range(n_folds)]
    # (fold, first and last training position, first and last test position); the very last date is never tested
    bounds = [(k, 1 if expanding else at - head + 1, at, at + 1, min(at + block, n - 1)) for k, at in starts if at < n - 1]
    table = F.explode(F.array(*[F.struct(*[F.lit(v).alias(nm) for v, nm in zip(b, ("fold", "a", "b", "s", "e"))]) for b in bounds]))
    role = F.when(c("idx").between(c("f.a"), c("f.b")), "train").when(c("idx").between(c("f.s"), c("f.e")), "test")
    g = days.withColumn("f", table).withColumn("role", role).where("role is not null").groupBy(c("f.fold").alias("fold")).agg(
        *[agg for r in ("train", "test") for agg in (
            F.min(F.when(c("role") == r, c("date"))).alias(f"{r}_start"), F.max(F.when(c("role") == r, c("date"))).alias(f"{r}_end"),
            F.sum(F.when(c("role") == r, c("rows"))).alias(f"{r}_rows"))])
    return g.where((c("train_rows") >= min_train) & (c("test_rows") >= min_test))


# -- fitting -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Params:
    """Boosted trees; fixed values: depth and learning rate of the default learner.

    The number of rounds is a parameter: every round is a distributed pass over the data.
    """

    depth: int = 4
    rate: float = 0.04
    rounds: int = 20
    subsample: float = 0.8
    min_rows: int = 20
    seed: int = 42


@dataclass
class Ensemble:
    features: list[str]
    models: list = field(default_factory=list)
    params: list[Params] = field(default_factory=list)
    report: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add one prediction column per member and their mean ``prediction``."""
        out = assemble(df, self.features)
        for i, m in enumerate(self.models):
            out = m.setPredictionCol(f"member_{i}").transform(out)
        n = len(self.models)
        mean = sum((c(f"member_{i}") for i in range(n)), F.lit(0.0)) / float(n)
        return out.drop("__x").withColumn("prediction", mean)

    @property
    def members(self) -> list[str]:
        return [f"member_{i}" for i in range(len(self.models))]


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df)


def fit_one(train: DataFrame, features: list[str], target: str, p: Params):
    gbt = GBTRegressor(
        featuresCol="__x", labelCol=target, maxDepth=p.depth, stepSize=p.rate, maxIter=p.rounds, subsamplingRate=p.subsample,
        minInstancesPerNode=p.min_rows, seed=p.seed)
    return gbt.fit(assemble(train, features))


def pooled_ic(df: DataFrame, score: str = "prediction", target: str = "target") -> float:
    """Rank correlation over all rows; fewer than 10 rows give 0."""
    row = spearman(df, [], score, target).first()
    return float(row.ic) if row.n >= 10 and row.ic is not None else 0.0


def fit_guarded(train: DataFrame, valid: DataFrame, features: list[str], target: str, p: Params, gap: float = 0.05, max_rounds: int = 3):
    """Refit with shallower, stricter trees while training IC exceeds validation IC by ``gap``."""
    for attempt in range(max_rounds + 1):
        model = fit_one(train, features, target, p)
        ics = [pooled_ic(model.transform(assemble(part, features)), "prediction", target) for part in (train, valid)]
        report = {"seed": p.seed, "depth": p.depth, "train_ic": ics[0], "val_ic": ics[1], "refits": attempt}
        if ics[0] - ics[1] <= gap or attempt == max_rounds:
            return model, p, report
        p = replace(p, depth=max(1, p.depth - 1), min_rows=int(p.min_rows * 1.5))


def fit_ensemble(df: DataFrame, features: list[str], target: str = "target", n_models: int = 2, p: Params = Params(), guard: bool = True, validation: float = 0.2) -> Ensemble:
    """``n_models`` members with seeds p.seed, p.seed + 1, ... on a date split."""
    data = stage(time_split(df.select("date", "ticker", *features, target).dropna(), validation), "train")
    train, valid = data.where("role = 'train'"), data.where("role = 'validation'")
    out = Ensemble(features)
    for i in range(n_models):
        model, q, rep = fit_guarded(train, valid, features, target, replace(p, seed=p.seed + i), max_rounds=3 if guard else 0)
        out.models.append(model)
        out.params.append(q)
        out.report.append(rep)
    return out


def cross_validate(df: DataFrame, features: list[str], target: str = "target", p: Params = Params(), **folds) -> DataFrame:
    """IC of every fold; one distributed fit per fold."""
    data = stage(df.select("date", "ticker", *features, target).dropna(), "cv")
    rows = []
    for f in cv_folds(data, **folds).orderBy("fold").collect():
        train = data.where(c("date").between(f.train_start, f.train_end))
        test = data.where(c("date").between(f.test_start, f.test_end))
        model = fit_one(train, features, target, p)
        ic = pooled_ic(model.transform(assemble(test, features)), "prediction", target)
        rows.append((f.fold, f.train_rows, f.test_rows, ic))
    return df.sparkSession.createDataFrame(rows, "fold int, train_rows bigint, test_rows bigint, ic double")


def cv_summary(folds: DataFrame) -> DataFrame:
    mean, sd = F.avg("ic"), F.stddev_pop("ic")
    return folds.agg(mean.alias("mean_ic"), sd.alias("std_ic"), (sd / (F.abs(mean) + 1e-8)).alias("stability"))


def grid_search(df: DataFrame, features: list[str], candidates: list[Params], target: str = "target") -> DataFrame:
    """Validation IC of every candidate, best first."""
    data = stage(time_split(df.select("date", "ticker", *features, target).dropna()), "grid")
    rows = []
    for p in candidates:
        model = fit_one(data.where("role = 'train'"), features, target, p)
        rows.append((p.depth, p.rate, p.rounds, pooled_ic(model.transform(assemble(data.where("role = 'validation'"), features)), "prediction", target)))
    return df.sparkSession.createDataFrame(rows, "depth int, rate double, rounds int, val_ic double").orderBy(c("val_ic").desc(), "depth", "rate")


# -- scores ------------------------------------------------------------------------------

def normalize_scores(df: DataFrame, score: str = "prediction", method: str = "rank", out: str = "score") -> DataFrame:
    """Per date: percentile rank, or z-score."""
    if method == "rank":
        return percent_rank(df, ["date"], score, out)
    if method != "zscore":
        raise ValueError("method is rank or zscore")
    z = with_stats(df, ["date"], __m=F.avg(score), __s=F.stddev_samp(score))
    return z.withColumn(out, (c(score) - c("__m")) / (c("__s") + 1e-8)).drop("__m", "__s")


def scores_at(scores: DataFrame, dates: DataFrame) -> DataFrame:
    """Scores of the given dates only."""
    return scores.join(dates.select("date").distinct(), "date", "left_semi")


def smooth_scores(scores: DataFrame, rebalances: DataFrame, members: DataFrame | None = None, window: int = 5) -> DataFrame:
    """Mean score over the ``window`` calendar dates up to each rebalance, members only.

    ``members``: (date, ticker) pairs that belong to the universe.
    """
    cal = calendar(scores)
    days = rebalances.select(c("rebal_date").alias("date")).distinct().join(cal, "date").select(
        c("date").alias("rebal_date"), F.explode(F.sequence(F.greatest(F.lit(1), c("idx") - (window - 1)), c("idx"))).alias("idx"))
    pairs = days.join(cal, "idx").select("rebal_date", "date")
    df = scores.join(pairs, "date")
    if members is not None:
        df = df.join(members.select("date", "ticker").distinct(), ["date", "ticker"], "left_semi")
    return df.groupBy("rebal_date", "ticker").agg(F.avg("score").alias("score"))


# -- confidence --------------------------------------------------------------------------

def dispersion(df: DataFrame, members: list[str], out: str = "dispersion") -> DataFrame:
    """Sample standard deviation across the members' columns of a row; null for a single member."""
    if len(members) < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    n = float(len(members))
    mean = sum((c(m) for m in members), F.lit(0.0)) / n
    ss = sum((F.pow(c(m) - mean, 2.0) for m in members), F.lit(0.0))
    return df.withColumn(out, F.sqrt(ss / (n - 1.0)))


def confidence_tiers(df: DataFrame, value: str = "dispersion", low: float = 0.25, high: float = 0.75) -> DataFrame:
    """HIGH for low dispersion, LOW for high; LOW wins where the cuts meet."""
    cuts = quantiles(df, [], value, {"__lo": low, "__hi": high})
    tier = F.when(c(value) >= c("__hi"), "LOW").when(c(value) <= c("__lo"), "HIGH").otherwise("MEDIUM")
    return df.join(F.broadcast(cuts)).withColumn("tier", tier).drop("__lo", "__hi")


def conformal(calibration: DataFrame, df: DataFrame, prediction: str = "prediction", target: str = "target", coverage: float = 0.9) -> DataFrame:
    """Split-conformal interval around every prediction."""
    resid = calibration.select(F.abs(c(target) - c(prediction)).alias("__r")).dropna()
    level = F.least(F.lit(1.0), F.lit(coverage) * (1.0 + 1.0 / c("total")))
    q = quantiles(resid, [], "__r", {"__q": level})
    return df.join(F.broadcast(q)).withColumns({
        "lower": c(prediction) - c("__q"), "upper": c(prediction) + c("__q"), "width": 2.0 * c("__q")}).drop("__q")


def confidence_report(df: DataFrame, members: list[str], calibration: DataFrame, coverage: float = 0.9) -> DataFrame:
    return conformal(calibration, confidence_tiers(dispersion(df, members)), coverage=coverage)


# -- importance --------------------------------------------------------------------------

def importance_table(model: Ensemble, spark) -> DataFrame:
    """Long ``(member, feature, importance)``; one row per member and feature."""
    rows = [(i, f, float(v)) for i, m in enumerate(model.models) for f, v in zip(model.features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "member int, feature string, importance double")


def importance_summary(table: DataFrame, top: int | None = None) -> DataFrame:
    """Mean, deviation, rank and stability (coefficient of variation at .10 / .30) per feature."""
    g = table.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std_importance"))
    w = Window.partitionBy(F.lit(0)).orderBy(c("mean_importance").desc(), "feature")
    cv = c("std_importance") / (c("mean_importance") + 1e-8)
    g = g.withColumns({"rank": F.row_number().over(w), "cv": cv}).withColumn(
        "stability", F.when(c("cv") <= 0.10, "stable").when(c("cv") <= 0.30, "moderate").otherwise("unstable"))
    return g if top is None else g.where(c("rank") <= top)


def attribution_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution and rank per feature."""
    g = attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c("mean_abs").desc(), "feature")))


def local_explanation(attributions: DataFrame, keys: list[str]) -> DataFrame:
    """All contributions of a row, largest size first."""
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "feature")
    return attributions.where("value is not null").withColumn("rank", F.row_number().over(w))


def mean_shift(reference: DataFrame, current: DataFrame, features: list[str], scaled: bool = True) -> DataFrame:
    """|difference of means| per feature, by default over the reference deviation."""
    long = lambda df: df.select(*features).unpivot([], features, "feature", "value")
    a = long(reference).groupBy("feature").agg(F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"))
    b = long(current).groupBy("feature").agg(F.avg("value").alias("m1"))
    d = F.abs(c("m1") - c("m0"))
    return a.join(b, "feature").select("feature", (d / nz("s0") if scaled else d).alias("shift"))


def mean_shift_verdict(shifts: DataFrame, threshold: float = 0.15, top: int = 5) -> DataFrame:
    w = F.sort_array(F.collect_list(F.struct(c("shift"), c("feature"))), asc=False)
    return shifts.agg(F.avg("shift").alias("mean_shift"), (F.avg("shift") > threshold).alias("drifted"),
                      F.array_join(F.transform(F.slice(w, 1, top), lambda x: x["feature"]), ",").alias("top_features"))


def run_log_latest(runs: DataFrame) -> DataFrame:
    """Latest record per run of an append-only log (``run_id, seq, ...``), best validation IC first."""
    rest = [x for x in runs.columns if x != "run_id"]
    last = runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return last.select("run_id", *[c(f"r.{x}").alias(x) for x in rest]).orderBy(c("val_ic").desc_nulls_last(), "run_id")


def promote(versions: DataFrame, version_id: str | Column) -> DataFrame:
    """Exactly one champion."""
    v = version_id if isinstance(version_id, Column) else F.lit(version_id)
    return versions.withColumn("is_champion", c("version_id") == v)
