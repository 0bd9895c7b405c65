"""Price cleaning, feed checks and audits of feature and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, by_ticker, nz

c = F.col
OHLC = ("open", "high", "low", "close")


def first_per_key(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Keep the first row of each (date, ticker).

    A minimum over structs combines map-side, so copies of a hot key never meet in one task.
    """
    rest = [x for x in df.columns if x not in ("date", "ticker", order)]
    return df.groupBy("date", "ticker").agg(F.min(F.struct(order, *rest)).alias("r")).select(
        "date", "ticker", *[c(f"r.{x}").alias(x) for x in rest])


def flag_steps(df: DataFrame, max_move: float = 0.30, stale_days: int = 5) -> DataFrame:
    """De-duplicated rows with ``drop_reason``: missing, price, jump, stale or null.

    Each rule sees only rows that passed the earlier ones, so jumps are measured against
    the previous surviving row.  Rows already dropped form their own window partition.
    """
    df = first_per_key(df)
    gap = c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull()
    df = df.withColumn("drop_reason", F.when(gap, "missing").when(c("close") <= 0, "price"))
    live = lambda: Window.partitionBy("ticker", c("drop_reason").isNotNull()).orderBy("date")
    move = F.abs(c("close") / nz(F.lag("close").over(live())) - 1.0)
    df = df.withColumn("__m", move).withColumn("drop_reason", F.coalesce(
        "drop_reason", F.when(c("__m") > max_move, F.lit("jump")))).drop("__m")
    same = (c("close") - F.lag("close").over(live()) == 0).cast("int")
    df = df.withColumn("__same", F.coalesce(same, F.lit(0)))
    k = stale_days - 1
    run = F.sum("__same").over(live().rowsBetween(-(k - 1), 0))
    return df.withColumn("__run", run).withColumn("drop_reason", F.coalesce(
        "drop_reason", F.when(c("__run") == k, F.lit("stale")))).drop("__same", "__run")


def audit(raw: DataFrame, max_fail: float = 0.05, **rules) -> DataFrame:
    """One-row report: counts per rule, rows left, dropped share and verdict."""
    n = raw.agg(F.count(F.lit(1)).alias("initial_rows"))
    reason = lambda r: F.sum((c("drop_reason") == r).cast("bigint"))
    z = lambda x: F.coalesce(x, F.lit(0))
    steps = flag_steps(raw, **rules).agg(
        F.count(F.lit(1)).alias("__u"), z(reason("missing")).alias("dropped_missing"), z(reason("price")).alias("dropped_price"),
        z(reason("jump")).alias("dropped_jump"), z(reason("stale")).alias("dropped_stale"),
        F.sum(c("drop_reason").isNull().cast("bigint")).alias("final_rows"))
    share = (c("initial_rows") - c("final_rows")) / c("initial_rows")
    return n.join(steps).select(
        "initial_rows", "final_rows", (c("initial_rows") - c("__u")).alias("dropped_duplicates"), "dropped_missing",
        "dropped_price", "dropped_jump", "dropped_stale", share.alias("fail_share"), (share <= max_fail).alias("passed"))


def validate_panel(raw: DataFrame, max_fail: float = 0.05, **rules) -> DataFrame:
    """The clean rows; raises when more than ``max_fail`` of the input was dropped."""
    report = audit(raw, max_fail, **rules).first()
    if not report.passed:
        raise ValueError(f"{report.fail_share:.1%} of {report.initial_rows} rows dropped, {max_fail:.1%} allowed")
    return flag_steps(raw, **rules).where("drop_reason is null").drop("drop_reason")


# -- feed checks -------------------------------------------------------------------------

def check_table(one: DataFrame, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Long form ``check, value, passed, severity`` of a one-row table."""
    rows = [F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), p.alias("passed"), s.alias("severity")) for n, v, p, s in checks]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feed_statistics(df: DataFrame, numeric: list[str], keys: list[str], date: str = "date") -> DataFrame:
    """Counts and moments of a feed in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max(date).alias("last_date")]
    for x in numeric:
        aggs += [F.avg(c(x).isNull().cast("double")).alias(f"null_{x}"), F.avg(x).alias(f"m_{x}"), F.stddev_samp(x).alias(f"s_{x}")]
    return df.agg(*aggs)


def feed_checks(df: DataFrame, numeric: list[str], keys: list[str], as_of: str, date: str = "date") -> DataFrame:
    """Row count, missing share, outliers, staleness, duplicate keys and constant columns.

    ``as_of`` is the day of the check.  Distinct keys are counted by a shuffle on the key.
    """
    s = feed_statistics(df, numeric, keys, date)
    z = [F.abs(c(x) - c(f"m_{x}")) / (c(f"s_{x}") + 1e-8) > 5.0 for x in numeric]
    outliers = df.select(*numeric).join(F.broadcast(s.select(*[f"{p}_{x}" for x in numeric for p in ("m", "s")]))).agg(
        F.sum(sum((F.coalesce(v, F.lit(False)).cast("bigint") for v in z), F.lit(0))).alias("outliers"))
    unique = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("unique_keys"))
    one = s.join(outliers).join(unique)
    k = float(len(numeric))
    missing = sum((c(f"null_{x}") for x in numeric), F.lit(0.0)) / k
    rate = c("outliers") / F.greatest(c("n") * k, F.lit(1.0))
    stale = F.datediff(F.lit(as_of).cast("date"), c("last_date").cast("date"))
    constant = sum((F.coalesce(c(f"s_{x}") < 1e-10, F.lit(False)).cast("int") for x in numeric), F.lit(0))
    none, warn = F.lit("OK"), F.lit("WARNING")
    grade = lambda bad, worse: F.when(worse, "CRITICAL").when(bad, "WARNING").otherwise("OK")
    dup = c("n") - c("unique_keys")
    return check_table(one, [
        ("row_count", c("n"), c("n") >= 10, grade(c("n") < 10, c("n") == 0)),
        ("missing_values", missing, missing <= 0.05, grade(missing > 0.05, missing > 0.20)),
        ("outliers", rate, rate < 0.01, F.when(rate >= 0.01, warn).otherwise(none)),
        ("staleness", stale, stale <= 3, grade(stale > 3, stale > 7)),
        ("duplicates", dup, dup == 0, F.when(dup > 0, warn).otherwise(none)),
        ("constant_columns", constant, constant == 0, F.when(constant > 0, F.lit("INFO")).otherwise(none)),
    ])


def worst_column(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric column with the largest missing share (the first of equals)."""
    one = df.agg(*[F.avg(c(x).isNull().cast("double")).alias(x) for x in numeric])
    long = one.select(F.explode(F.array(*[
        F.struct(c(x).alias("missing"), F.lit(-i).alias("o"), F.lit(x).alias("column")) for i, x in enumerate(numeric)])).alias("r"))
    return long.agg(F.max("r").alias("r")).select("r.column", "r.missing")


def feed_report(checks: DataFrame) -> DataFrame:
    """Overall verdict and the failed checks, alphabetically."""
    return checks.agg(
        F.min("passed").alias("passed"),
        F.array_join(F.sort_array(F.collect_list(F.when(~c("passed"), c("check")))), ",").alias("failed_checks"))


# -- feature and label audits --------------------------------------------------------------

def column_audit(df: DataFrame, rules: dict[str, dict], required: list[str] = ()) -> DataFrame:
    """Audit columns in one aggregate: ``column, check, value, passed``.

    ``rules[column]`` may set ``max_null``, ``min_filled``, ``low``, ``high``, ``binary``,
    ``balance``.  Infinite values always fail; ``required`` columns must exist.
    """
    aggs, rows = [], []
    has = set(df.columns)
    row = lambda col_, chk, v, ok: rows.append(F.struct(
        F.lit(col_).alias("column"), F.lit(chk).alias("check"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(True)).alias("passed")))
    for r in required:
        row(r, "exists", F.lit(1.0 if r in has else 0.0), F.lit(r in has))
    for x, rule in rules.items():
        if x not in has:
            continue
        v = c(x)
        aggs += [F.avg(v.isNull().cast("double")).alias(f"n|{x}"), F.min(v).alias(f"lo|{x}"), F.max(v).alias(f"hi|{x}"), F.avg(v).alias(f"m|{x}"),
                 F.sum(F.coalesce(F.abs(v) == float("inf"), F.lit(False)).cast("bigint")).alias(f"i|{x}"),
                 F.sum(F.coalesce(~v.isin(0.0, 1.0), F.lit(False)).cast("bigint")).alias(f"b|{x}")]
        g = lambda p: c(f"`{p}|{x}`")
        row(x, "infinite", g("i"), g("i") == 0)
        if "max_null" in rule:
            row(x, "null_share", g("n"), g("n") <= rule["max_null"])
        if "min_filled" in rule:
            row(x, "filled_share", 1.0 - g("n"), 1.0 - g("n") >= rule["min_filled"])
        if "low" in rule:
            row(x, "minimum", g("lo"), g("lo") >= rule["low"])
        if "high" in rule:
            row(x, "maximum", g("hi"), g("hi") <= rule["high"])
        if rule.get("binary"):
            row(x, "not_binary", g("b"), g("b") == 0)
        if "balance" in rule:
            lo, hi = rule["balance"]
            row(x, "positive_share", g("m"), (g("m") >= lo) & (g("m") <= hi))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_rules() -> dict[str, dict]:
    """Audit rules of the feature families."""
    half = ("return_1m", "return_3m", "return_6m", "return_12m", "residual_momentum", "bollinger_distance", "rolling_sharpe",
            "pe_proxy", "pb_proxy", "earnings_yield", "distance_52w_high", "distance_52w_low", "price_to_trend")
    rules: dict[str, dict] = {x: {"max_null": 0.5} for x in half}
    rules |= {x: {"max_null": 0.75} for x in ("price_acceleration", "volume_growth_1m", "volume_growth_3m", "revenue_proxy_growth", "expansion_breakout")}
    rules |= {x: {"min_filled": 0.1} for x in ("roe", "roa", "earnings_growth", "market_beta")}
    rules |= {x: {"low": 0.0} for x in ("realized_vol_20d", "realized_vol_60d", "downside_deviation", "vol_of_vol", "parkinson_vol", "idio_volatility")}
    return rules | {"rsi_14": {"low": 0.0, "high": 100.0}}


def label_rules(horizons, custom=()) -> dict[str, dict]:
    """Audit rules of the label families; ``custom``: names of registered labels."""
    rules: dict[str, dict] = {}
    for h in horizons:
        rules[f"ret_fwd_{h}d"] = {"min_filled": 0.5}
        rules[f"binary_fwd_{h}d"] = {"binary": True, "balance": (0.2, 0.8)}
        rules[f"rank_pct_fwd_{h}d"] = {"low": 0.0, "high": 1.0}
    return rules | {f"custom_{name}": {"max_null": 0.9} for name in custom}


def common_dates(a: DataFrame, b: DataFrame, threshold: int = 100) -> DataFrame:
    """Number of dates both tables share and whether it suffices."""
    n = a.select("date").distinct().join(b.select("date").distinct(), "date", "left_semi").agg(F.count(F.lit(1)).alias("n_common"))
    return n.select("n_common", (c("n_common") >= threshold).alias("passed"))
