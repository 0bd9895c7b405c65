"""Portfolio construction on long weight tables ``(portfolio_id, rebal_date, ticker, weight)``.

A rebalance holds as many rows as the portfolio selects; sums over a rebalance go
through :func:`with_stats`, so even a very wide portfolio is combined map-side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import nz, row_positions, with_stats
from panelloom.functions.sequence import walk

c = F.col
KEYS = ["portfolio_id", "rebal_date"]


@dataclass(frozen=True)
class Constraints:
    """Default bounds of the portfolio engine."""

    min_weight: float = 0.0
    max_weight: float = 0.10
    max_adv_pct: float = 0.05
    portfolio_value: float = 1e7
    sector_deviation: float = 0.05
    beta_min: float = 0.8
    beta_max: float = 1.2


def normalize(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Scale every rebalance to sum 1; a zero or negative sum is left alone."""
    total = with_stats(df, KEYS, __sum=F.sum(weight))
    return total.withColumn(weight, F.when(c("__sum") > 0, c(weight) / c("__sum")).otherwise(c(weight))).drop("__sum")


def top_k_schedule(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Equal weight of the ``k`` best scores on each month's first scored date."""
    first = scores.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("date")
    best = row_positions(scores.join(first, "date").withColumn("__neg", -c("score")), ["date"], "__neg", "ticker", "rn")
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    return best.withColumn("portfolio_id", k).where("rn <= portfolio_id").select(
        "portfolio_id", c("date").alias("rebal_date"), "ticker",
        (F.lit(1.0) / F.least(c("portfolio_id"), c("total"))).alias("weight"))


# -- selection ------------------------------------------------------------------------

def score_ranks(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranks per date (1..limit, if one is asked for), highest score first, ties by ticker."""
    ranked = row_positions(scores.withColumn("__neg", -c("score")), ["date"], "__neg", "ticker", "rank")
    return (ranked if limit is None else ranked.where(c("rank") <= limit)).select("date", "ticker", "score", "rank")


def _held(rows: DataFrame, buffer_ratio: float, min_hold: int, emergency_rank: int, step_days: int) -> DataFrame:
    """Holdings from ``(portfolio_id, rebal_date, ticker, rank, top_n)``, rebalance by rebalance.

    State is the holding age of the names held; a portfolio's rebalances stream by in date
    order, so its history may be of any length."""

    def step(held, portfolio, day, rows):
        import pandas as pd

        top = int(rows["top_n"].iloc[0])
        buffer = int(top * buffer_ratio)
        place = dict(zip(rows["ticker"], rows["rank"]))
        stays = {
            t: age for t, age in (held or {}).items()
            if t in place and not (place[t] > buffer and (age >= min_hold or place[t] > emergency_rank))
        }
        room = max(0, top - len(stays))
        entering = [t for t, r in place.items() if r <= top and t not in stays][:room]
        held = {t: age + step_days for t, age in {**stays, **dict.fromkeys(entering, 0)}.items()}
        return held, pd.DataFrame({
            "portfolio_id": portfolio, "rebal_date": day, "ticker": list(held), "rank": [int(place[t]) for t in held], "days_held": list(held.values())})

    return walk(rows, "portfolio_id", "rebal_date", ["rank"], step, "portfolio_id int, rebal_date date, ticker string, rank int, days_held int")


def hysteresis_schedule(
    scores: DataFrame, portfolios: dict[int, int], buffer_ratio: float = 1.4, min_hold: int = 20,
    emergency_rank: int = 80, step_days: int = 21,
) -> DataFrame:
    """Holdings per rebalance with buy and sell thresholds that differ.

    ``portfolios`` maps an id to its size N.  A holding is sold when it left the scores or
    ranks beyond ``floor(N * buffer_ratio)`` and has been held ``min_hold`` days or ranks
    beyond ``emergency_rank``; free places go to the best-ranked names within N.  Only names
    that can matter reach the walk: a held name ranked beyond both thresholds is sold
    whatever its age.
    """
    need = {p: max(n, int(n * buffer_ratio), emergency_rank) for p, n in portfolios.items()}
    ranks = score_ranks(scores, max(need.values()))
    table = F.explode(F.array(*[F.struct(
        F.lit(p).alias("portfolio_id"), F.lit(n).alias("top_n"), F.lit(need[p]).alias("need")) for p, n in portfolios.items()]))
    rows = ranks.withColumn("p", table).where(c("rank") <= c("p.need")).select(
        "p.portfolio_id", "p.top_n", c("date").alias("rebal_date"), "ticker", "rank")
    return _held(rows, buffer_ratio, min_hold, emergency_rank, step_days)


def dynamic_schedule(
    scores: DataFrame, portfolio_id: int = 1, share: float = 0.15, least: int = 12, buffer_ratio: float = 1.4, min_hold: int = 20,
    emergency_rank: int = 80, step_days: int = 21,
) -> DataFrame:
    """As :func:`hysteresis_schedule`, with N = max(``least``, floor(``share`` x names scored)) anew at each rebalance."""
    sized = with_stats(score_ranks(scores), ["date"], __n=F.count(F.lit(1)))
    top = F.greatest(F.lit(least), F.floor(F.lit(share) * c("__n"))).cast("int")
    need = F.greatest(top, F.floor(top * F.lit(buffer_ratio)), F.lit(emergency_rank))
    rows = sized.withColumn("top_n", top).where(c("rank") <= need).select(
        F.lit(portfolio_id).alias("portfolio_id"), "top_n", c("date").alias("rebal_date"), "ticker", "rank")
    return _held(rows, buffer_ratio, min_hold, emergency_rank, step_days)


# -- weights --------------------------------------------------------------------------

def equal_weight(selected: DataFrame, adv: DataFrame | None = None, k: Constraints = Constraints()) -> DataFrame:
    """1/n, capped by traded value with one redistribution of the rest, then normalised.

    ``adv``: ``(rebal_date, ticker, adv)``; an instrument without one may hold nothing.
    """
    df = with_stats(selected.select(*KEYS, "ticker"), KEYS, __n=F.count(F.lit(1)).cast("double"))
    df = df.withColumn("weight", F.lit(1.0) / c("__n"))
    if adv is not None:
        df = df.join(adv.select("rebal_date", "ticker", "adv"), ["rebal_date", "ticker"], "left")
        cap = F.coalesce("adv", F.lit(0.0)) * k.max_adv_pct / k.portfolio_value
        df = df.withColumn("__capped", c("weight") > cap).withColumn(
            "weight", F.when(c("__capped"), cap).otherwise(c("weight")))
        df = with_stats(df, KEYS, __sum=F.sum("weight"), __free=F.sum((~c("__capped")).cast("double")))
        rest = F.lit(1.0) - c("__sum")
        df = df.withColumn("weight", F.when(
            ~c("__capped") & (rest > 0.001) & (c("__free") < c("__n")), c("weight") + rest / nz("__free")
        ).otherwise(c("weight")))
    return normalize(df.select(*KEYS, "ticker", "weight"))


def sector_neutralize(weights: DataFrame, sectors: DataFrame, benchmark: DataFrame, deviation: float = 0.05) -> DataFrame:
    """Scale sectors into the band around their benchmark weight, then normalise."""
    df = weights.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Other"))).join(benchmark, "sector", "left")
    df = with_stats(df, KEYS + ["sector"], __sw=F.sum("weight"))
    b = c("benchmark_weight")
    target = F.greatest(F.least(c("__sw"), b + deviation), b - deviation)
    scaled = F.when(b.isNotNull() & (c("__sw") > 0), c("weight") * target / nz("__sw")).otherwise(c("weight"))
    return normalize(df.select(*KEYS, "ticker", scaled.alias("weight")))


def beta_target(weights: DataFrame, betas: DataFrame, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Scale the whole portfolio when its beta leaves the range; unknown betas count as 1."""
    on = [x for x in ("rebal_date", "ticker") if x in betas.columns]
    df = weights.join(betas, on, "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    df = with_stats(df, KEYS, __b=F.sum(c("weight") * c("beta")))
    scale = F.when((c("__b") < low) & (c("__b") > 0), low / nz("__b")).when(c("__b") > high, high / nz("__b")).otherwise(1.0)
    return df.select(*KEYS, "ticker", (c("weight") * scale).alias("weight"))


def clip_normalize(weights: DataFrame, low: float = 0.0, high: float = 0.10, passes: int = 10) -> DataFrame:
    """Clip to [low, high] and hand the rest to the unclipped names, at most ``passes`` times.

    A rebalance stops early when it sums to 1, when nothing is left to scale, or when the
    clipped names already take everything.  Every pass is a set of totals over the rows of a
    rebalance; all passes share one exchange and no row holds more than one name.
    """
    whole = Window.partitionBy(*KEYS)
    df = weights.select(*KEYS, "ticker", c("weight").alias("__w"), F.lit(False).alias("__done"))
    inner = (c("__x") > low) & (c("__x") < high)
    for _ in range(passes):
        clipped = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c("__w")))
        df = df.withColumn("__x", F.when(c("__done"), c("__w")).otherwise(clipped)).withColumns({
            "__sum": F.sum("__x").over(whole), "__in": F.sum(F.when(inner, c("__x")).otherwise(0.0)).over(whole),
            "__k": F.count_if(inner).over(whole), "__n": F.count(F.lit(1)).over(whole)})
        rest = 1.0 - (c("__sum") - c("__in"))
        settled = F.abs(c("__sum") - 1.0) < 1e-5
        after = (
            F.when(c("__done") | settled, c("__x"))
            .when(c("__sum") == 0, F.lit(1.0) / c("__n"))
            .when(c("__k") == 0, c("__x") / nz("__sum"))
            .when(inner, F.when(rest <= 0, F.lit(0.0)).otherwise(c("__x") / nz("__in") * rest))
            .otherwise(c("__x"))
        )
        done = c("__done") | settled | (c("__sum") == 0) | (c("__k") == 0) | (rest <= 0)
        df = df.select(*KEYS, "ticker", after.alias("__w"), done.alias("__done"))
    return df.select(*KEYS, "ticker", c("__w").alias("weight"))


def constrain(
    weights: DataFrame, adv: DataFrame | None = None, sectors: DataFrame | None = None,
    benchmark: DataFrame | None = None, betas: DataFrame | None = None, k: Constraints = Constraints(),
) -> DataFrame:
    """Traded-value cap, sector band, beta range, then weight bounds."""
    if adv is not None:
        cap = F.coalesce("adv", F.lit(0.0)) * k.max_adv_pct / k.portfolio_value
        weights = weights.join(adv, ["rebal_date", "ticker"], "left").select(
            *KEYS, "ticker", F.least("weight", cap).alias("weight"))
    if sectors is not None and benchmark is not None:
        weights = sector_neutralize(weights, sectors, benchmark, k.sector_deviation)
    if betas is not None:
        weights = beta_target(weights, betas, k.beta_min, k.beta_max)
    return clip_normalize(weights, k.min_weight, k.max_weight)


# -- rebalancing ----------------------------------------------------------------------

def consecutive(weights: DataFrame) -> DataFrame:
    """Old and new weight of every name at every rebalance but the first.

    Each row is emitted for its own and for the following rebalance; one grouping then
    replaces the full outer join of neighbouring rebalances.
    """
    dates = weights.select(*KEYS).distinct()
    w = Window.partitionBy("portfolio_id").orderBy("rebal_date")
    dates = dates.select(*KEYS, F.lead("rebal_date").over(w).alias("__next"), F.lag("rebal_date").over(w).alias("__prev"))
    df = weights.join(dates, KEYS)
    new = df.where("__prev is not null").select(*KEYS, "ticker", F.lit(0.0).alias("old"), c("weight").alias("new"))
    old = df.where("__next is not null").select(
        "portfolio_id", c("__next").alias("rebal_date"), "ticker", c("weight").alias("old"), F.lit(0.0).alias("new"))
    return new.unionByName(old).groupBy(*KEYS, "ticker").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))


def no_trade_zone(pairs: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Keep the old weight where the change is small, then normalise (one step)."""
    kept = F.when(F.abs(c("new") - c("old")) > threshold, c("new")).otherwise(c("old"))
    return normalize(pairs.select(*KEYS, "ticker", kept.alias("weight")))


def no_trade_schedule(weights: DataFrame, threshold: float = 0.005) -> DataFrame:
    """The same rule over time: each rebalance starts from the weights the rule left.

    The normalisation ties all names of a date to one another and to the date before, so a
    portfolio is one sequence; its rebalances stream by, and memory holds the last weights.
    Returns the names held or targeted on a date, or held on the one before.
    """

    def step(held, portfolio, day, rows):
        import pandas as pd

        asked = rows.set_index("ticker")["weight"]
        if held is None:
            given = asked
        else:
            names = asked.index.union(held.index)
            old, new = held.reindex(names, fill_value=0.0), asked.reindex(names, fill_value=0.0)
            given = new.where((new - old).abs() > threshold, old)
            given = given / given.sum() if given.sum() > 0 else given
        out = pd.DataFrame({"portfolio_id": portfolio, "rebal_date": day, "ticker": given.index, "weight": given.to_numpy()})
        return given[given != 0], out  # a name that was sold shows once, with weight 0

    return walk(weights.select("portfolio_id", "rebal_date", "ticker", "weight"), "portfolio_id", "rebal_date", ["ticker"], step,
                "portfolio_id int, rebal_date date, ticker string, weight double")


def rebalance_report(pairs: DataFrame, trigger: float = 0.05) -> DataFrame:
    """Largest change, whether it triggers, and one-way turnover."""
    d = F.abs(c("new") - c("old"))
    return pairs.groupBy(*KEYS).agg(
        F.max(d).alias("max_drift"), (F.max(d) > trigger).alias("rebalance"), (F.sum(d) / 2.0).alias("turnover"))


def trade_costs(
    pairs: DataFrame, adv: DataFrame, vol: DataFrame, value: float = 1e7, fixed_bps: float = 15.0, coef: float = 0.10
) -> DataFrame:
    """Cost of every trade in currency: fixed rate plus square-root impact."""
    df = pairs.join(adv, ["rebal_date", "ticker"], "left").join(vol, ["rebal_date", "ticker"], "left")
    trade = F.abs(c("new") - c("old")) * value
    part = F.sqrt(F.coalesce(trade / nz(F.coalesce("adv", F.lit(1e8))), F.lit(0.0)))
    impact = coef * F.coalesce("vol", F.lit(0.015)) * part * trade
    return df.select(*KEYS, "ticker", "old", "new", trade.alias("trade"), (trade * (fixed_bps / 1e4) + impact).alias("cost"))


def net_weights(costs: DataFrame, value: float = 1e7) -> DataFrame:
    """Target weights after paying the trades from the portfolio."""
    df = with_stats(costs, KEYS, total_cost=F.sum("cost"), __sum=F.sum("new"))
    left = value - c("total_cost")
    net = F.when(left > 0, c("new") / nz("__sum")).otherwise(c("new"))
    return df.select(*KEYS, "ticker", net.alias("weight"), "total_cost")


# -- sizing ---------------------------------------------------------------------------

def portfolio_variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """w' C w per rebalance from the long covariance table ``(.., i, j, cov)``, both halves present."""
    wi = weights.select(*KEYS, c("ticker").alias("i"), c("weight").alias("wi"))
    wj = weights.select(*KEYS, c("ticker").alias("j"), c("weight").alias("wj"))
    return cov.join(wi, KEYS + ["i"]).join(wj, KEYS + ["j"]).groupBy(*KEYS).agg(
        F.sum(c("wi") * c("wj") * c("cov")).alias("variance"))


def volatility_target(weights: DataFrame, cov: DataFrame, target: float = 0.15, max_scale: float = 1.5) -> DataFrame:
    df = weights.join(portfolio_variance(weights, cov), KEYS, "left")
    vol = F.sqrt(F.greatest(c("variance"), F.lit(0.0)) * 252.0)
    scale = F.when(c("variance") > 0, F.least(target / nz(vol), F.lit(max_scale))).otherwise(1.0)
    return df.select(*KEYS, "ticker", (c("weight") * scale).alias("weight"))


def conviction_tilt(weights: DataFrame, scores: DataFrame, power: float = 2.0) -> DataFrame:
    """Multiply by score**power (missing score 0.5) and normalise."""
    s = scores.select(c("date").alias("rebal_date"), "ticker", "score")
    df = weights.join(s, ["rebal_date", "ticker"], "left").withColumn(
        "__t", c("weight") * F.pow(F.coalesce("score", F.lit(0.5)), power))
    df = with_stats(df, KEYS, __sum=F.sum("__t"))
    return df.select(*KEYS, "ticker", F.when(c("__sum") > 0, c("__t") / nz("__sum")).otherwise(c("weight")).alias("weight"))


def cash_buffer(weights: DataFrame, cash: float = 0.02) -> DataFrame:
    df = with_stats(weights, KEYS, __sum=F.sum("weight"))
    return df.select(*KEYS, "ticker", F.when(c("__sum") > 0, c("weight") / nz("__sum") * (1.0 - cash)).otherwise(c("weight")).alias("weight"))


# -- orders ---------------------------------------------------------------------------

def money(x: Column) -> Column:
    return F.floor(x * 100.0 + 0.5).cast("double") / 100.0


def order_list(weights: DataFrame, panel: DataFrame, capital: float = 100_000.0, exact_day: bool = False) -> DataFrame:
    """Whole-share orders of each portfolio's latest weights.

    Prices are the instrument's latest close; ``exact_day`` admits only instruments
    priced on the panel's last day.
    """
    newest = weights.groupBy("portfolio_id").agg(F.max("rebal_date").alias("rebal_date"))
    live = weights.join(newest, KEYS).where("weight > 0")
    price = panel.groupBy("ticker").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"))
    if exact_day:
        price = price.join(F.broadcast(panel.agg(F.max("date").alias("price_date"))), "price_date")
    shares = F.floor(c("weight") * capital / nz("price"))
    return live.join(price, "ticker").withColumn("shares", shares).where("shares > 0").select(
        *KEYS, "ticker", money(c("weight") * 100.0).alias("target_weight_pct"),
        money(c("weight") * capital).alias("allocated_capital"), money(c("price")).alias("latest_price"), "shares"
    ).orderBy("portfolio_id", c("target_weight_pct").desc(), "ticker")


def daily_summary(orders: DataFrame, stop: float = 0.98, target: float = 1.05) -> DataFrame:
    """Orders with stop-loss and target prices.  Works on the rounded price of the order list."""
    return orders.select("*", money(c("latest_price") * stop).alias("stop_loss"), money(c("latest_price") * target).alias("target"))


def order_actions(orders: DataFrame, summary: DataFrame) -> DataFrame:
    """Full outer match of orders and summary with the action each implies."""
    o = orders.select("portfolio_id", "ticker", c("shares").alias("shares_to_buy"), "latest_price")
    s = summary.select("portfolio_id", "ticker", c("shares").alias("shares"), "stop_loss", "target")
    action = F.when(c("shares_to_buy") > 0, "Buy").when(c("shares_to_buy") < 0, "Sell/Reduce").otherwise("N/A")
    return s.join(o, ["portfolio_id", "ticker"], "full_outer").select("*", action.alias("action"))


# -- strategies -----------------------------------------------------------------------

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    """Register a weighting function ``f(selected, cov=..., scores=..., adv=...) -> weights``."""

    def add(fn: Callable[..., DataFrame]):
        STRATEGIES[name] = fn
        return fn

    return add


def list_strategies() -> list[str]:
    return sorted(STRATEGIES)


def optimize(name: str, selected: DataFrame, **inputs) -> DataFrame:
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {list_strategies()}")
    return STRATEGIES[name](selected, **inputs)


@strategy("equal_weight")
def _equal(selected: DataFrame, adv: DataFrame | None = None, **_) -> DataFrame:
    return equal_weight(selected, adv)
