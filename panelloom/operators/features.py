"""Per-instrument feature columns.

All features are frames over one window specification (``ticker`` by ``date``).  They
are added level by level: the frames of a level are one pass over the instruments, however
many columns read them.  Rows are dealt by instrument once; every level finds them as the one
before left them and hands on only what a later one reads.  The last level lags every feature by one
row: a feature on a date only knows earlier rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, by_ticker, nz, pct_change, sqrt0
from panelloom.functions.columns import TRADING_DAYS

ANNUAL = math.sqrt(TRADING_DAYS)
Level = dict[str, Column]
c = F.col


def flag(cond: Column) -> Column:
    """1.0 / 0.0; an undecidable condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def missing() -> Column:
    return F.lit(None).cast("double")


def prepare(panel: DataFrame, context: DataFrame | None) -> DataFrame:
    """Add the daily return and, with a context return, the paired series.

    ``context`` holds ``date``, ``ctx_ret`` and possibly a group key also present in the
    panel (for example ``sector``).  Its 21-row sum runs on its own calendar.
    """
    df = panel.withColumn("_ret", pct_change("close", by_ticker()))
    if context is None:
        return df.withColumns({k: missing() for k in ("_ctx", "_ctx21")} | {"_pairs": F.lit(0)})
    keys = [k for k in context.columns if k in panel.columns and k != "ctx_ret"]
    groups = [k for k in keys if k != "date"]
    fc = Frames(Window.partitionBy(*(groups or [F.lit(0)])).orderBy("date"))
    ctx = fc.add(context.select(*keys, c("ctx_ret").alias("_ctx")), {"_ctx21": fc.roll(F.sum, "_ctx", 21)})
    ctx = ctx.select(*keys, "_ctx", "_ctx21")
    df = df.join(ctx, keys, "left").withColumn("_pair", c("_ret").isNotNull() & c("_ctx").isNotNull())
    return df.withColumn("_pairs", F.sum(c("_pair").cast("int")).over(Window.partitionBy("ticker")))


def paired_beta(fr: Frames, has: set[str]) -> Column:
    """60-row beta on the context over the rows where both returns exist."""
    return F.when(c("_pair"), fr.beta("_ret", "_ctx", 60, only="_pair")) if "_pair" in has else missing()


def change(fr: Frames, x: str, k: int) -> Column:
    """Relative change over ``k`` rows."""
    return c(x) / nz(fr.past(x, k)) - 1.0


# -- families: each yields its levels; a level may use the columns of earlier ones ----

def momentum(fr: Frames, has: set[str]) -> Iterator[Level]:
    base = {f"return_{n}": change(fr, "close", k) for n, k in
            [("1m", 21), ("3m", 63), ("6m", 126), ("12m", 252), ("5d", 5), ("10d", 10)]}
    base |= {
        "_beta1": fr.beta("_ret", "_ctx", 60, only="_pair", held=True, default=1.0) if "_pair" in has else missing(),
        "_ctx21f": fr.held("_ctx21"),
        "bollinger_distance": (c("close") - fr.roll(F.avg, "close", 20)) / nz(fr.roll(F.stddev_samp, "close", 20)),
        "rolling_sharpe": fr.roll(F.avg, "_ret", 60) / nz(fr.roll(F.stddev_samp, "_ret", 60)) * ANNUAL,
    }
    yield base
    residual = F.when(c("_pairs") > 60, c("return_1m") - c("_beta1") * c("_ctx21f")).otherwise(c("return_1m"))
    yield {"residual_momentum": residual}


def value(fr: Frames, has: set[str]) -> Iterator[Level]:
    pe = nz("pe_ratio") if "pe_ratio" in has else c("close") / nz(fr.roll(F.avg, "close", 252))
    pb = nz("pb_ratio") if "pb_ratio" in has else c("close") / nz(fr.roll(F.avg, "close", 756))
    trend = fr.roll(F.avg, "close", 504)
    yield {
        "pe_proxy": pe, "pb_proxy": pb,
        "distance_52w_high": c("close") / nz(fr.roll(F.max, "close", 252)) - 1.0,
        "distance_52w_low": c("close") / nz(fr.roll(F.min, "close", 252)) - 1.0,
        "price_to_trend": (c("close") - trend) / nz(trend),
    }
    yield {"earnings_yield": F.lit(1.0) / nz("pe_proxy")}


def quality(fr: Frames, has: set[str]) -> Iterator[Level]:
    level = {k: nz(k) if k in has else missing() for k in ("roe", "roa", "earnings_growth")}
    level = {f"_q_{k}": v for k, v in level.items()}
    level["_ret1"] = fr.past("_ret")
    level["earnings_stability"] = -fr.roll(F.stddev_samp, "_ret", 126)
    level["gross_margin"] = -fr.roll(F.avg, (c("high") - c("low")) / nz("close"), 21)
    yield level
    # lag-1 autocorrelation inside 21 rows: 20 pairs, all 21 returns present
    autocorr = F.when(fr.count("_ret", 21) == 21, fr.corr("_ret", "_ret1", 20))
    yield {"accruals_ratio": autocorr}


def growth(fr: Frames, has: set[str]) -> Iterator[Level]:
    vol, money = nz("volume"), c("close") * nz("volume")
    long_run = lambda x, n: fr.roll(F.avg, x, n) / nz(fr.roll(F.avg, x, 126)) - 1.0
    yield {
        "price_acceleration": change(fr, "close", 21) - change(fr, "close", 63) / 3.0,
        "volume_growth_1m": long_run(vol, 21), "volume_growth_3m": long_run(vol, 63),
        "revenue_proxy_growth": long_run(money, 21),
        "expansion_breakout": c("close") / nz(fr.roll(F.max, "close", 252)) - 1.0,
    }


def liquidity(fr: Frames, has: set[str]) -> Iterator[Level]:
    vol = nz("volume")
    level = {
        "amihud_21": fr.roll(F.avg, F.abs("_ret") / nz(c("close") * vol), 21) * 1e6,
        "turnover_ratio": vol / nz(fr.roll(F.avg, vol, 63)),
        "volume_consistency": -(fr.roll(F.stddev_samp, vol, 21) / nz(fr.roll(F.avg, vol, 21))),
        "hl_spread_proxy": fr.roll(F.avg, F.ln(c("high") / nz("low")), 21),
    }
    yield level
    z = lambda x: (c(x) - fr.roll(F.avg, x, 252)) / nz(fr.roll(F.stddev_samp, x, 252))
    scored = {"_z1": -z("amihud_21"), "_z2": -z("hl_spread_proxy"), "_z3": z("turnover_ratio")}
    # inputs that never exist for a ticker are left out; at least two must exist
    scored["_usable"] = fr.ever("amihud_21") + fr.ever("hl_spread_proxy") + fr.ever("turnover_ratio")
    yield scored
    parts = ["_z1", "_z2", "_z3"]
    total = sum((F.coalesce(c(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((c(p).isNotNull().cast("double") for p in parts), F.lit(0.0))
    yield {"liquidity_score": F.when(c("_usable") >= 2, total / nz(n))}


def volatility(fr: Frames, has: set[str]) -> Iterator[Level]:
    hl2 = F.pow(F.ln(c("high") / nz("low")), 2.0)
    level = {
        "_sd20": fr.roll(F.stddev_samp, "_ret", 20), "_sd60": fr.roll(F.stddev_samp, "_ret", 60),
        "downside_deviation": F.sqrt(fr.roll(F.avg, F.pow(F.when(c("_ret") < 0, c("_ret")).otherwise(c("_ret") * 0.0), 2.0), 60)) * ANNUAL,
        "parkinson_vol": fr.roll(F.avg, F.sqrt(hl2 / (4.0 * math.log(2.0))), 20) * ANNUAL,
        "_resid": c("_ret") - paired_beta(fr, has) * c("_ctx"),
    }
    yield level
    idio = F.when(c("_pairs") > 60, fr.roll(F.stddev_samp, "_resid", 60)).otherwise(c("_sd60")) * ANNUAL
    yield {
        "realized_vol_20d": c("_sd20") * ANNUAL, "realized_vol_60d": c("_sd60") * ANNUAL,
        "vol_of_vol": fr.roll(F.stddev_samp, "_sd20", 60), "idio_volatility": idio,
    }


def macro(fr: Frames, has: set[str]) -> Iterator[Level]:
    level = {"_mkt": F.coalesce(c("_ctx"), F.lit(0.0)) if "_pair" in has else missing()}
    yield level
    if "vix" in has:
        stressed = c("vix") > 20.0
    else:
        stressed = fr.roll(F.stddev_samp, "_ret", 20) > fr.roll(F.stddev_samp, "_ret", 252) * 1.5
    yield {
        "market_beta": fr.beta("_ret", "_mkt", 60),
        "macro_correlation": fr.corr("_ret", "_mkt", 60),
        "vix_regime": flag(stressed), "above_200dma": flag(c("close") > fr.roll(F.avg, "close", 200)),
    }
    yield {"macro_regime_score": 0.5 * c("above_200dma") - 0.5 * c("vix_regime")}


def sentiment(fr: Frames, has: set[str]) -> Iterator[Level]:
    delta = c("close") - fr.past("close")
    typical = (c("high") + c("low") + c("close")) / 3.0
    yield {
        "_obv": F.when(c("_ret").isNotNull(), fr.total(c("volume") * F.signum("_ret"))),
        "_gain": F.greatest(delta, F.lit(0.0) * delta), "_loss": -F.least(delta, F.lit(0.0) * delta),
        "_typ": typical, "_typ1": fr.past(typical),
    }
    flow = c("_typ") * nz("volume")
    h14, l14 = fr.roll(F.max, "high", 14), fr.roll(F.min, "low", 14)
    yield {
        "_obv21": fr.roll(F.avg, "_obv", 21),
        "williams_pct_r": (h14 - c("close")) / nz(h14 - l14) * -100.0,
        "_rs": fr.roll(F.avg, "_gain", 14) / nz(fr.roll(F.avg, "_loss", 14)),
        "_mf_up": F.when(c("_typ") > c("_typ1"), flow).otherwise(F.lit(0.0)),
        "_mf_down": F.when(c("_typ") < c("_typ1"), flow).otherwise(F.lit(0.0)),
        "close_location_value": fr.roll(
            F.avg, ((c("close") - c("low")) - (c("high") - c("close"))) / nz(c("high") - c("low")), 21),
    }
    yield {
        "obv_trend": (c("_obv") - c("_obv21")) / nz(F.abs("_obv21")),
        "rsi_14": 100.0 - 100.0 / (1.0 + c("_rs")),
        "_mfr": fr.roll(F.sum, "_mf_up", 14) / nz(fr.roll(F.sum, "_mf_down", 14)),
    }
    yield {"money_flow_index": 100.0 - 100.0 / (1.0 + c("_mfr"))}


def alternative(fr: Frames, has: set[str]) -> Iterator[Level]:
    prev = fr.past("close")
    yield {
        "weekday_effect": F.weekday("date").cast("double"),
        "month_end_effect": (F.dayofmonth("date") >= 28).cast("double"),
        "overnight_gap": (c("open") - prev) / nz(prev),
        "_doji": flag(F.abs(c("close") - c("open")) / nz(c("high") - c("low")) < 0.05),
    }
    yield {
        "gap_frequency": fr.roll(F.avg, flag(F.abs("overnight_gap") > 0.005), 21),
        "doji_signal": fr.roll(F.sum, "_doji", 5) / 5.0,
    }


@dataclass(frozen=True)
class Family:
    name: str
    category: str
    version: str
    columns: tuple[str, ...]
    levels: Callable[[Frames, set[str]], Iterator[Level]]


# Family names, categories and output columns of the feature registry.
FAMILIES: dict[str, Family] = {f.name: f for f in [
    Family("Momentum", "Momentum & Trend", "1.0.0",
           ("return_1m", "return_3m", "return_6m", "return_12m", "residual_momentum", "return_5d",
            "return_10d", "bollinger_distance", "rolling_sharpe"), momentum),
    Family("Quality", "Fundamental Quality", "1.0.0",
           ("roe", "roa", "earnings_growth", "earnings_stability", "gross_margin", "accruals_ratio"), quality),
    Family("Value", "Fundamental Valuation", "1.0.0",
           ("pe_proxy", "pb_proxy", "earnings_yield", "distance_52w_high", "distance_52w_low",
            "price_to_trend"), value),
    Family("Growth", "Fundamental Growth", "1.0.0",
           ("price_acceleration", "volume_growth_1m", "volume_growth_3m", "revenue_proxy_growth",
            "expansion_breakout"), growth),
    Family("Liquidity", "Market Microstructure", "1.0.0",
           ("amihud_illiquidity", "turnover_ratio", "hl_spread_proxy", "volume_consistency",
            "liquidity_score"), liquidity),
    Family("Volatility", "Volatility & Risk", "1.0.0",
           ("realized_vol_20d", "realized_vol_60d", "downside_deviation", "vol_of_vol", "parkinson_vol",
            "idio_volatility"), volatility),
    Family("Macro", "Macroeconomic Sensitivity", "1.0.0",
           ("market_beta", "macro_correlation", "vix_regime", "above_200dma", "macro_regime_score"), macro),
    Family("Sentiment", "Market Sentiment & Behavioral", "1.0.0",
           ("obv_trend", "williams_pct_r", "rsi_14", "money_flow_index", "close_location_value"), sentiment),
    Family("Alternative", "Alternative Data", "1.0.0",
           ("weekday_effect", "month_end_effect", "overnight_gap", "gap_frequency", "doji_signal"), alternative),
]}

# Output columns whose working name differs (the name is taken by an input or another definition).
_WORKING = {"amihud_illiquidity": "amihud_21", "roe": "_q_roe", "roa": "_q_roa", "earnings_growth": "_q_earnings_growth"}


def _read(*columns: Column) -> set[str]:
    """Names that may be columns which the expressions read."""
    return {x for v in columns for x in re.findall(r"\w+", repr(v))}


def _levels(names: list[str], fr: Frames, has: set[str]) -> Iterator[Level]:
    """The levels of the families side by side."""
    for level in zip_longest(*[FAMILIES[n].levels(fr, has) for n in names], fillvalue={}):
        yield {k: v for part in level for k, v in part.items()}


def compute_families(panel: DataFrame, context: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """The chosen families (default: all) as ``date, ticker`` plus their lagged columns.

    Rows cross one exchange, with the panel's columns and the context: see :class:`Frames`."""
    names = names or list(FAMILIES)
    df = prepare(panel, context)
    has = set(df.columns)
    working = {x: _WORKING.get(x, x) for n in names for x in FAMILIES[n].columns}
    # what each level reads, and with it the levels after it
    fr, reads = Frames(), []
    for level in _levels(names, fr, has):
        reads.append(_read(*level.values(), *fr.inputs.values()) | {part[3] for part in fr.parts.values() if part[3]})
        fr.clear()
    reads.append({"date", "ticker", *working.values()})
    later = [set().union(*reads[i:]) for i in range(len(reads))]
    fr, dealt = Frames(), False
    for i, level in enumerate(_levels(names, fr, has)):
        df = fr.add(df, level, [x for x in df.columns if x in later[i]], dealt)
        df, dealt = df.select(*[x for x in df.columns if x in later[i + 1]]), dealt or bool(fr.parts)
        fr.clear()
    last = Frames()
    lagged = {name: last.past(w) for name, w in working.items()}
    df = last.add(df, {f"__out_{name}": v for name, v in lagged.items()}, ["date", "ticker"], dealt)
    return df.select("date", "ticker", *[c(f"__out_{name}").alias(name) for name in lagged])


def core_features(panel: DataFrame, context: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """The core feature set: momentum, reversion, liquidity, volatility and quality, lagged.

    Every part is lagged where it is read: prices by Spark's windows, frames by
    ``Frames(lag=True)``.  So rows cross one exchange, before the frames.  With ``only``,
    the frames and columns that no asked feature reads stay out of the exchange.
    """
    asked = [x for x in CORE_COLUMNS if only is None or x in only]
    needs = lambda *names: any(x in asked for x in names)
    paired = needs("residual_momentum", "idiosyncratic_volatility")
    w = by_ticker()
    df = prepare(panel, context)
    has = set(df.columns)
    past = lambda x, k=0: F.lag(x, k + 1).over(w)
    reach = {"return_1m": 21, "return_3m": 63, "return_6m": 126, "return_5d": 5, "return_10d": 10}
    given = [q for q in ("roe", "roa", "earnings_growth") if q in has]
    df = df.withColumns({"_close": past("close"), "_volume": past("volume"), "_ret1": past("_ret")}
                        | {f"_close{k}": past("close", k) for k in reach.values()}
                        | {"_known": past(F.lit(1)), "_ctx21f": F.last("_ctx21", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))}
                        | {f"_{q}": past(q) for q in given})
    df = df.withColumns({name: c("_close") / nz(f"_close{k}") - 1.0 for name, k in reach.items()} | {
        "amihud_illiquidity": F.abs("_ret1") / nz(c("_volume") * c("_close")),
        "_paired": c("_known").isNotNull() & (c("_pairs") > 60)})
    fr = Frames(lag=True)
    keep = {"_close": needs("bollinger_distance"), "_volume": needs("volume_shock"), "_ctx21f": needs("residual_momentum"), "_paired": paired}
    keep |= {x: needs(x) for x in [*reach, "amihud_illiquidity"]} | {f"_{q}": needs(q) for q in given}
    keep["return_1m"] |= needs("residual_momentum")
    framed = {}
    if needs("bollinger_distance"):
        framed["bollinger_distance"] = (c("_close") - fr.roll(F.avg, "close", 20)) / nz(fr.roll(F.stddev_samp, "close", 20))
    if needs("volume_shock"):
        framed["volume_shock"] = c("_volume") / nz(fr.roll(F.avg, "volume", 20))
    if needs("volatility_regime"):
        framed["volatility_regime"] = fr.roll(F.stddev_samp, "_ret", 20) / nz(fr.roll(F.stddev_samp, "_ret", 60))
    if paired:
        framed["_beta1"] = fr.beta("_ret", "_ctx", 60, only="_pair", held=True, default=1.0) if "_pair" in has else missing()
    if needs("idiosyncratic_volatility"):
        framed |= {"_sd20": fr.roll(F.stddev_samp, "_ret", 20), "_vy": fr.roll(F.var_samp, "_ret", 60), "_vx": fr.roll(F.var_samp, "_ctx", 60)}
    df = fr.add(df, framed, ["date", "ticker", "close", *[k for k, read in keep.items() if read]])
    if needs("residual_momentum"):
        df = df.withColumn("residual_momentum", F.when(c("_paired"), c("return_1m") - c("_beta1") * c("_ctx21f")).otherwise(c("return_1m")))
    if needs("idiosyncratic_volatility"):
        # greatest() skips nulls, so an unknown residual variance must stay unknown
        residual = F.when(c("_vy").isNotNull() & c("_vx").isNotNull() & c("_beta1").isNotNull(), sqrt0(c("_vy") - F.pow(c("_beta1"), 2.0) * c("_vx")))
        df = df.withColumn("idiosyncratic_volatility", F.when(c("_paired"), residual).otherwise(c("_sd20")))
    return df.select("date", "ticker", "close", *[
        c(f"_{x}").alias(x) if x in given else missing().alias(x) if x in ("roe", "roa", "earnings_growth") else c(x) for x in asked])


# Core feature names, those ranked in descending order, and their families.
CORE_COLUMNS = [
    "return_1m", "return_3m", "return_6m", "residual_momentum", "return_5d", "return_10d",
    "bollinger_distance", "volume_shock", "amihud_illiquidity", "idiosyncratic_volatility",
    "volatility_regime", "roe", "roa", "earnings_growth",
]
DESCENDING = [
    "return_5d", "return_10d", "bollinger_distance", "amihud_illiquidity",
    "idiosyncratic_volatility", "volatility_regime",
]
CORE_FAMILIES = {
    "Momentum": ["return_1m", "return_3m", "return_6m", "residual_momentum"],
    "Reversion": ["return_5d", "return_10d", "bollinger_distance"],
    "Liquidity": ["volume_shock", "amihud_illiquidity"],
    "Volatility": ["idiosyncratic_volatility", "volatility_regime"],
    "Quality": ["roe", "roa", "earnings_growth"],
}


def family_registry(spark: SparkSession) -> DataFrame:
    """Registry metadata: one row per family."""
    rows = [(f.name, f.category, f.version, list(f.columns)) for f in FAMILIES.values()]
    return spark.createDataFrame(rows, "name string, category string, version string, columns array<string>")
