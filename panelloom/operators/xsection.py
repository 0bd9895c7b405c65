"""Cross-sectional transforms: per date, over all instruments."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import Frames, column_quantiles, per_instrument, rank_columns, stage, with_stats
from panelloom.operators.features import CORE_FAMILIES, DESCENDING

c = F.col


def winsorize(df: DataFrame, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip every feature at its per-date quantiles (linear interpolation).

    All features share one pass; only one row of limits per date is staged and joined back.
    """
    limits = stage(column_quantiles(df, ["date"], features, {"__lo": low, "__hi": high}), "limits")
    return _clipped(df, limits, features)


def _clipped(df: DataFrame, limits: DataFrame, features: list[str]) -> DataFrame:
    clip = lambda f: F.when(c(f).isNotNull(), F.least(F.greatest(c(f), c(f"__lo_{f}")), c(f"__hi_{f}")))
    rest = [x for x in df.columns if x not in features]
    return df.join(limits, "date", "left").select(*rest, *[clip(f).alias(f) for f in features])


def zscore(df: DataFrame, features: list[str], zero_sd: float = 1e-6) -> DataFrame:
    aggs: dict[str, Column] = {}
    for f in features:
        aggs |= {f"__m_{f}": F.avg(f), f"__s_{f}": F.stddev_samp(f)}
    sd = lambda f: F.when(c(f"__s_{f}") == 0.0, F.lit(zero_sd)).otherwise(c(f"__s_{f}"))
    rest = [x for x in df.columns if x not in features]
    # One row per date, staged: Spark sees its true size and need not move the rows to join it.
    stats = stage(df.groupBy("date").agg(*[v.alias(k) for k, v in aggs.items()]), "moments")
    return df.join(stats, "date", "left").select(*rest, *[((c(f) - c(f"__m_{f}")) / sd(f)).alias(f) for f in features])


def neutralize(df: DataFrame, features: list[str], sectors: DataFrame) -> DataFrame:
    """Subtract the (date, sector) mean; an unmapped instrument belongs to ``Other``."""
    tagged = df.join(sectors.select("ticker", c("sector").alias("__sector")), "ticker", "left").withColumn(
        "__sector", F.coalesce("__sector", F.lit("Other")))
    rest = [x for x in df.columns if x not in features]
    return with_stats(tagged, ["date", "__sector"], **{f"__m_{f}": F.avg(f) for f in features}).select(
        *rest, *[(c(f) - c(f"__m_{f}")).alias(f) for f in features]
    )


def rank_features(df: DataFrame, features: list[str], descending: list[str] = DESCENDING, like: DataFrame | None = None) -> DataFrame:
    """Percentile rank in (0, 1] per date; ``descending`` features rank the other way round.
    ``like``: a table with the same rows per date that is cheaper to count."""
    rest = [x for x in df.columns if x not in features]
    return rank_columns(df, ["date"], features, descending, like=like).select(*rest, *features)


def correlation_table(df: DataFrame, features: list[str], threshold: float = 0.6, min_rows: int = 500) -> DataFrame:
    """Pruning decision per feature from one pass over the complete rows.

    A feature is dropped when it correlates above ``threshold`` with any earlier one,
    unless it is the first of its family.  Dropped features still count for later ones.
    """
    present = {f: F.count(f) for f in features}
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in present.items()]).first()
    live = [f for f in features if seen[f] > 0]
    full = df.select(*live).dropna()
    sd = lambda f: F.stddev_samp(f)
    pairs = [
        F.abs(F.covar_samp(a, b) / F.nullif(sd(a) * sd(b), F.lit(0.0))).alias(f"{a}|{b}") for a, b in combinations(live, 2)
    ]
    one = full.agg(F.count(F.lit(1)).alias("__n"), *pairs)
    first_of = {next((m for m in members if m in live), None) for members in CORE_FAMILIES.values()}
    rows = []
    for i, f in enumerate(live):
        earlier = [c(f"`{a}|{f}`") for a in live[:i]]
        top = F.greatest(*earlier) if len(earlier) > 1 else (earlier[0] if earlier else F.lit(None).cast("double"))
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f).alias("feature"), top.alias("max_earlier_corr"),
                             F.lit(f in first_of).alias("protected")))
    enough = seen["rows"] >= min_rows
    return one.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.*",
        F.coalesce((c("r.max_earlier_corr") > threshold) & ~c("r.protected") & F.lit(enough), F.lit(False)).alias("dropped"),
    )


def drop_correlated(df: DataFrame, features: list[str], threshold: float = 0.6) -> DataFrame:
    doomed = [r.feature for r in correlation_table(df, features, threshold).where("dropped").collect()]
    return df.drop(*doomed)


def own_history_zscore(df: DataFrame, features: list[str], low=0.01, high=0.99, epsilon=1e-6, dealt: bool = False) -> DataFrame:
    """Winsorize on the instrument's whole history, then rolling z-score (252 rows, 60 needed).
    ``dealt``: rows lie as frames leave them (see :class:`Frames`); else they cross one exchange."""
    fr, rest = Frames(), [x for x in df.columns if x not in features]
    df = df.select(*rest, *[c(f).cast("double").alias(f) for f in features])
    z = lambda x: (c(x) - fr.roll(F.avg, x, 252, 60)) / (fr.roll(F.stddev_samp, x, 252, 60) + epsilon)
    return fr.add(_clipped_history(df, features, low, high, dealt), {f"__z_{f}": z(f) for f in features}, dealt=True).select(
        *rest, *[c(f"__z_{f}").alias(f) for f in features])


def _clipped_history(df: DataFrame, features: list[str], low: float, high: float, dealt: bool = False) -> DataFrame:
    """Columns clipped at their quantiles over the instrument's rows, in date order: an instrument's
    history is one Arrow table, bounded by the calendar.  NaN is the greatest value, as in Spark."""

    def level(x, q):
        h = (len(x) - 1) * q
        k, up = math.floor(h), math.ceil(h)
        return x[k] if k == up or x[k] == x[up] else (up - h) * x[k] + (h - k) * x[up]

    def clip(table):
        for f in features:
            column = table.column(f).combine_chunks()
            x = column.drop_null().to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            s = np.sort(x)
            lo, hi = level(s, low), level(s, high)
            x = np.where((x > lo) | np.isnan(x), x, lo)
            has, out = column.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(column))
            out[has] = np.where((x < hi) | np.isnan(hi), x, hi)
            table = table.set_column(table.column_names.index(f), f, pa.array(out, mask=~has))
        return table

    return per_instrument(df, clip, df.schema, dealt)
