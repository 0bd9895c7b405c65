"""Anomalies, text signals, explanations and rule-based recommendations."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import Frames, nz

c = F.col

# Phrases counted as positive and negative signals.
POSITIVE = [
    "growth", "beat", "outperform", "record", "expansion", "profitability", "margin expansion", "strong demand",
    "raise guidance", "dividend increase", "accelerating", "robust", "cash flow", "breakthrough", "synergies",
]
NEGATIVE = [
    "miss", "decline", "headwind", "margin compression", "cut guidance", "impairment", "lawsuit", "investigation",
    "slowdown", "weakness", "supply chain disruption", "loss", "restructuring", "default", "attrition",
]

# Stances by predicted return, anomaly and alert words.
DIRECTIONS = ("BULLISH", "BEARISH", "NEUTRAL")
STANCES = ("Strong Outperform", "Moderate Outperform", "Strong Underperform", "Moderate Underperform", "Market Perform")
ALERTS = ("HIGH TAIL RISK", "HIGH CONCENTRATION", "MANDATE BREACH")
# Advice by domain: priority, recommendation, form of the rationale.
ADVICE = {
    "MODEL_TUNING": ("HIGH", "Perform hyperparameter optimization and feature pruning.", "Backtest Sharpe ratio (%.2f) is below target threshold 0.80."),
    "RISK_CONTROL": ("HIGH", "Tighten volatility targeting scalar and lower position cap limits.", "Max drawdown (%.1f%%) exceeds risk threshold of -20%%."),
    "EXECUTION_COSTS": ("MEDIUM", "Switch rebalance frequency from weekly to monthly or apply turnover constraints.", "Annualised turnover (%.1fx) generates %.0f bps in transaction costs."),
    "PORTFOLIO_DELEVERAGING": ("CRITICAL", "Reduce gross exposure by 20% and allocate to cash buffer.", "Risk profile grade is HIGH with active risk alerts: %d alerts triggered."),
    "MODEL_RETRAINING": ("HIGH", "Trigger automated model retraining pipeline on latest 12-month window.", "Significant feature distribution drift detected (PSI > 0.20)."),
    "DATA_PIPELINE": ("CRITICAL", "Audit data ingest pipeline for missing values or index staleness.", "Data quality checks failed on incoming market feeds."),
    "MAINTENANCE": ("LOW", "Maintain current portfolio allocation and monitoring schedule.", "All quantitative systems operate within nominal risk and performance parameters."),
}


# -- anomalies ---------------------------------------------------------------------------

def return_spikes(returns: DataFrame, window: int = 60, limit: float = 3.0) -> DataFrame:
    """Returns further than ``limit`` deviations from the rolling mean that includes them."""
    fr = Frames()
    z = (c("ret") - fr.roll(F.avg, "ret", window)) / nz(fr.roll(F.stddev_samp, "ret", window))
    df = fr.add(returns.where("ret is not null").select("date", "ticker", "ret"), {"z_score": z})
    return df.where(F.abs("z_score") > limit).select(
        "ticker", "date", "ret", "z_score", F.when(c("z_score") > 0, "SPIKE UP").otherwise("CRASH DOWN").alias("anomaly_type"))


def spike_rate(returns: DataFrame, spikes: DataFrame, n_cells: Column | None = None) -> DataFrame:
    """Share of spikes in all cells of the date x instrument grid."""
    cells = returns.agg((F.countDistinct("date") * F.countDistinct("ticker")).alias("cells"))
    return spikes.agg(F.count(F.lit(1)).alias("total")).join(cells).select(
        c("total").alias("total_anomalies"), (c("total") / F.greatest(c("cells"), F.lit(1))).alias("anomaly_rate"))


def prediction_outliers(predictions: DataFrame, baseline: DataFrame, score: str = "score", limit: float = 3.0) -> DataFrame:
    stats = baseline.agg(F.avg(score).alias("__m"), F.stddev_samp(score).alias("__s"))
    sd = F.when(c("__s") > 0, c("__s")).otherwise(1.0)
    df = predictions.join(F.broadcast(stats)).withColumn("z_score", (c(score) - c("__m")) / sd).drop("__m", "__s")
    return df.where(F.abs("z_score") > limit).withColumn("severity", F.when(F.abs("z_score") > 4.0, "HIGH").otherwise("MEDIUM"))


def factor_shift(current: DataFrame, baseline: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Factors whose beta moved by more than ``threshold`` (unknown baseline 0)."""
    df = current.select(*keys, c("beta").alias("current_beta")).join(baseline.select(*keys, c("beta").alias("baseline_beta")), keys, "left")
    df = df.withColumn("baseline_beta", F.coalesce("baseline_beta", F.lit(0.0))).withColumn("shift", c("current_beta") - c("baseline_beta"))
    return df.where(F.abs("shift") > threshold).withColumn("direction", F.when(c("shift") > 0, "ROTATION IN").otherwise("ROTATION OUT"))


# -- text --------------------------------------------------------------------------------

def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Whole-word occurrences, each phrase counted on its own."""
    return sum((F.regexp_count(text, F.lit(rf"\b{re.escape(p)}\b")) for p in phrases), F.lit(0))


def sentiment_columns(score: Column) -> dict[str, Column]:
    label = F.when(score > 0.25, "POSITIVE").when(score < -0.25, "NEGATIVE").otherwise("NEUTRAL")
    impact = (F.when(score > 0.6, "HIGH BULLISH").when(score > 0.25, "MODERATE BULLISH")
              .when(score < -0.6, "HIGH BEARISH").when(score < -0.25, "MODERATE BEARISH").otherwise("LOW IMPACT"))
    return {"sentiment_label": label, "market_impact": impact}


def news_sentiment(news: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """Phrase counts over headline and whole content, score, label and impact."""
    text = F.lower(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("content", F.lit(""))))
    df = news.withColumn("__t", text).withColumns({"n_positive": phrase_count(c("__t"), positive), "n_negative": phrase_count(c("__t"), negative)})
    n = c("n_positive") + c("n_negative")
    df = df.withColumn("sentiment_score", F.when(n > 0, (c("n_positive") - c("n_negative")) / nz(n.cast("double"))).otherwise(0.0))
    return df.withColumns(sentiment_columns(c("sentiment_score"))).drop("__t")


def takeaways(content: Column, headline: Column, n: int = 3, longer_than: int = 20) -> Column:
    """First sentences longer than 20 characters, or the headline."""
    blank = r"^\s+|\s+$"
    parts = F.transform(F.split(content, "[.!?]", -1), lambda x: F.regexp_replace(x, blank, ""))
    kept = F.slice(F.filter(parts, lambda x: F.length(x) > longer_than), 1, n)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(headline))


def earnings_summary(news: DataFrame, quarter: str, year: int, positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """Transcript view: sentiment, guidance and margin flags, memo line."""
    titled = news.withColumn("headline", F.format_string(f"%s {quarter} {year} Earnings Call", "symbol"))
    df = news_sentiment(titled, positive, negative)
    low = F.lower("content")
    df = df.withColumns({"guidance_discussed": low.contains("guidance"), "margin_discussed": low.contains("margin")})
    memo = F.concat(
        c("symbol"), F.lit(f" {quarter} {year}: tone "), c("sentiment_label"), F.lit(", impact "), c("market_impact"),
        F.when(c("guidance_discussed"), ", guidance discussed").otherwise(""), F.when(c("margin_discussed"), ", margins discussed").otherwise(""))
    return df.withColumn("executive_memo", memo)


# -- explanations ------------------------------------------------------------------------

def top_drivers(attributions: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The ``n`` largest contributions by size per row; ties by feature name.

    A row's contributions are as many as there are features.
    """
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "feature")
    return attributions.where("value is not null").withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def _drivers(attributions: DataFrame, keys: list[str], n: int, features: list[str] | None) -> DataFrame:
    """One row per key with its drivers in order: rank, feature, value, impact.

    Contributions held in columns are ranked row by row inside the tasks; a row without any
    has null drivers.
    """
    if features is None:
        impact = F.when(c("value") > 0, "positive").otherwise("negative")
        own = top_drivers(attributions, keys, n).withColumn("impact", impact)
        return own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "value", "impact"))).alias("drivers"))
    names = sorted(features)
    kept = attributions.select(*keys)
    one = T.StructType().add("rank", T.IntegerType()).add("feature", T.StringType()).add("value", T.DoubleType()).add("impact", T.StringType())
    schema = T.StructType([*kept.schema.fields, T.StructField("drivers", T.ArrayType(one))])

    def run(batches):
        for batch in batches:
            has = np.column_stack([batch.column(f).is_valid().to_numpy(zero_copy_only=False) for f in names])
            value = np.column_stack([batch.column(f).fill_null(0.0).to_numpy(zero_copy_only=False) for f in names])
            value[np.isnan(value)] = np.nan
            # Bits of sizes rise with them, NaN above all; a stable sort leaves ties in the order of names.
            order = np.argsort(np.where(has, -np.abs(value).view(np.int64), 1), axis=1, kind="stable")[:, :n]
            counts = np.minimum(has.sum(axis=1), n)
            some = np.arange(order.shape[1]) < counts[:, None]
            v = np.take_along_axis(value, order, axis=1)[some]
            rank = np.broadcast_to(np.arange(1, order.shape[1] + 1, dtype=np.int32), order.shape)[some]
            told = pa.array(["negative", "positive"]).take(pa.array((v > 0) | np.isnan(v)).cast(pa.int8()))
            parts = [pa.array(rank), pa.array(names).take(pa.array(order[some])), pa.array(v), told]
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, mask=np.append(counts == 0, False)), pa.StructArray.from_arrays(parts, [f.name for f in one.fields]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], names=schema.names)

    return attributions.select(*keys, *[c(f).cast("double").alias(f) for f in names]).mapInArrow(run, schema)


def explain_predictions(
    predictions: DataFrame, attributions: DataFrame, keys: list[str], n: int = 5, features: list[str] | None = None
) -> DataFrame:
    """Direction, stance, main drivers and a sentence for every predicted return.

    ``attributions`` has a row per key and ``feature``, or with ``features`` a row per key
    that holds them as columns, which are ranked where they stand.

    ``predictions`` may hold ``probability`` and an interval ``lower``, ``upper``; the
    sentence tells what is there; figures half-way between two are rounded to the even one.  ``drivers`` lists feature, signed value and impact.
    """
    s = c("score")
    up, down, flat = map(F.lit, DIRECTIONS)
    much_up, some_up, much_down, some_down, even = map(F.lit, STANCES)
    direction = F.when(s > 0.02, up).when(s < -0.02, down).otherwise(flat)
    stance = F.when(s > 0.05, much_up).when(s > 0.02, some_up).when(s < -0.05, much_down).when(s < -0.02, some_down).otherwise(even)
    drivers = _drivers(attributions, keys, n, features)
    drivers = drivers.withColumn("key_drivers", F.array_join(F.transform("drivers", lambda x: x["feature"]), ","))
    part = lambda names, text: F.when(F.concat(*[c(x).cast("string") for x in names]).isNull(), "").otherwise(text) if set(names) <= set(predictions.columns) else F.lit("")
    df = predictions.join(drivers, keys, "left").withColumns({"direction": direction, "stance": stance})
    told = F.concat(
        F.format_string("The model maintains a %s stance (%s) on %s with an expected return of %+.2f%%", "direction", "stance", "ticker", F.bround(100.0 * s, 2)),
        part(["probability"], F.format_string(" with %.1f%% probability", F.bround(100.0 * c("probability"), 1))),
        part(["lower", "upper"], F.format_string(" [95%% CI: %.3f to %.3f]", "lower", "upper")), F.lit("."),
    )
    return df.withColumn("narrative", told)


def attribution_split(
    attributions: DataFrame, keys: list[str], base: float = 0.0, n: int = 5, features: list[str] | None = None
) -> DataFrame:
    """Total attribution, final value and the signed drivers among the top ``n``; ``features``
    as in :func:`explain_predictions`."""
    if features is not None:
        total = sum((F.coalesce(c(f), F.lit(0.0)) for f in features), F.lit(0.0))
        total = F.when(F.coalesce(*[c(f) for f in features]).isNotNull(), total)
        own = _drivers(attributions.select("*", total.alias("total_attribution")), [*keys, "total_attribution"], n, features)
        keyed = F.concat(*[c(k).cast("string") for k in keys]).isNotNull()  # as in the join below
        named = lambda cond: F.when(keyed, F.array_join(F.transform(F.filter("drivers", cond), lambda x: x["feature"]), ","))
        return own.select(
            *keys, "total_attribution", named(lambda x: x["value"] > 0).alias("positive_drivers"),
            named(lambda x: x["value"] < 0).alias("negative_drivers"),
        ).withColumn("final_prediction", c("total_attribution") + base)
    total = attributions.groupBy(*keys).agg(F.sum("value").alias("total_attribution"))
    names = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("rank", "feature")))), lambda x: x["feature"]), ",")
    signed = top_drivers(attributions, keys, n).groupBy(*keys).agg(
        names(c("value") > 0).alias("positive_drivers"), names(c("value") < 0).alias("negative_drivers"))
    return total.join(signed, keys, "left").withColumn("final_prediction", c("total_attribution") + base)


# -- risk grade and advice -----------------------------------------------------------------

def risk_grade(profile: DataFrame) -> DataFrame:
    """Grade from ``var, cvar, top_5, mandate_met`` by the number of alerts."""
    alerts = F.array_compact(F.array(
        *[F.when(when, word) for when, word in zip((c("var") > 0.03, c("top_5") > 0.40, ~c("mandate_met")), ALERTS)]))
    df = profile.withColumn("alerts", F.array_join(alerts, ",")).withColumn("n_alerts", F.size(alerts))
    ratio = F.when(c("var") > 0, c("cvar") / nz("var")).otherwise(1.0)
    return df.withColumns({
        "risk_grade": F.when(c("n_alerts") == 0, "LOW").when(c("n_alerts") == 1, "MODERATE").otherwise("HIGH"),
        "tail": F.when(ratio > 1.4, "Fat-tailed").otherwise("Normal")})


def dominant_factor(exposures: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max(F.struct(F.abs("exposure").alias("a"), c("factor"), c("exposure")))
    return exposures.groupBy(*keys).agg(top.alias("t")).select(*keys, c("t.factor").alias("factor"), c("t.exposure").alias("exposure"))


def recommendations(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Rules over ``sharpe_ratio, max_drawdown, ann_fixed_cost_bp, ann_turnover, risk_grade,
    n_alerts, drift_detected, quality_passed``: one row per rule that fires, with priority,
    domain, recommendation and rationale; a maintenance row when none does."""

    def advice(domain: str, *figures: Column) -> Column:
        priority, text, form = ADVICE[domain]
        why = F.format_string(form, *figures) if figures else F.lit(form)
        return F.struct(F.lit(priority).alias("priority"), F.lit(domain).alias("domain"), F.lit(text).alias("recommendation"), why.alias("rationale"))

    alerts = c("n_alerts").cast("int") if "n_alerts" in inputs.columns else F.lit(0)
    fired = F.array_compact(F.array(
        F.when(c("sharpe_ratio") < 0.6, advice("MODEL_TUNING", c("sharpe_ratio"))),
        F.when(F.abs("max_drawdown") > 0.20, advice("RISK_CONTROL", 100.0 * c("max_drawdown"))),
        F.when((c("ann_fixed_cost_bp") > 100.0) | (c("ann_turnover") > 6.0), advice("EXECUTION_COSTS", c("ann_turnover"), c("ann_fixed_cost_bp"))),
        F.when(c("risk_grade") == "HIGH", advice("PORTFOLIO_DELEVERAGING", alerts)),
        F.when(c("drift_detected"), advice("MODEL_RETRAINING")), F.when(~c("quality_passed"), advice("DATA_PIPELINE"))))
    rows = F.explode(F.when(F.size(fired) > 0, fired).otherwise(F.array(advice("MAINTENANCE"))))
    return inputs.select(*keys, rows.alias("r")).select(*keys, "r.*")
