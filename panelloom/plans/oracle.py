"""Independent SQL for the checks: shared table expressions and output formatting."""

from __future__ import annotations

import re


def w(n: int, part: str = "ticker", order: str = "date") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r(fn: str, x: str, n: int, m: int | None = None, part: str = "ticker") -> str:
    """Guarded rolling aggregate: null until ``m`` (default ``n``) non-null inputs."""
    o = w(n, part)
    return f"(CASE WHEN count({x}) {o} >= {m or n} THEN {fn}({x}) {o} END)"


def lag(x: str, k: int = 1, part: str = "ticker") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY date)"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY ticker ORDER BY date)"


def pctrank(x: str, part: str = "date", desc: bool = False) -> str:
    """Average-tie rank over the non-null count."""
    d = " DESC" if desc else ""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x}{d} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {part}) END)"
    )


def avgrank(x: str, part: str | None = None) -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0::DOUBLE)"


def corr(y: str, x: str) -> str:
    return f"(covar_samp({y}, {x}) / nullif(stddev_samp({y}) * stddev_samp({x}), 0))"


LAST = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
PARTS: dict[str, str] = {
    "trades": """
        SELECT l_shipdate::DATE AS date, l_suppkey::VARCHAR AS ticker,
          100.0::DOUBLE + l_quantity / 5 AS open,
          greatest(100.0::DOUBLE + l_quantity / 5, 100.0::DOUBLE + l_extendedprice / 10000) * (1 + l_tax / 10) AS high,
          least(100.0::DOUBLE + l_quantity / 5, 100.0::DOUBLE + l_extendedprice / 10000) * (1 - l_discount / 10) AS low,
          100.0::DOUBLE + l_extendedprice / 10000 AS close, 100 * l_quantity AS volume,
          l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag
        FROM lineitem""",
    "panel": """
        SELECT date, ticker, open, high, low, close, volume FROM (
          SELECT date, ticker, open, high, low, close,
            sum(volume) OVER (PARTITION BY date, ticker) AS volume,
            row_number() OVER (PARTITION BY date, ticker ORDER BY l_orderkey DESC, l_linenumber DESC,
              l_partkey DESC, l_extendedprice DESC) AS rn
          FROM trades) WHERE rn = 1""",
    "panel_dirty": """
        SELECT date, ticker, open, high, low, volume, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
          CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN NULL
               WHEN l_discount = 0 AND l_tax = 0 THEN 0.0
               WHEN l_linenumber = 1 AND l_quantity = 50 THEN close * 2 ELSE close END AS close
        FROM trades""",
    "rets": f"SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM panel",
    "market": "SELECT date, avg(ret) AS mkt_ret FROM rets WHERE ret IS NOT NULL GROUP BY date",
    "idx": "SELECT date, mkt_ret, 100 * exp(sum(ln(1 + mkt_ret)) OVER (ORDER BY date)) AS close FROM market",
    "vix": "SELECT o_orderdate::DATE AS date, 12 + 30 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS close FROM orders GROUP BY 1",
    "smap": """SELECT s_suppkey::VARCHAR AS ticker, r_name AS sector, n_name AS country FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sbench": "SELECT sector, count(*)::DOUBLE / (SELECT count(*) FROM smap) AS benchmark_weight FROM smap GROUP BY sector",
    "snapdates": "SELECT d::DATE AS snapshot_date FROM range(DATE '1995-01-01', DATE '2001-07-02', INTERVAL 6 MONTH) t(d)",
    "members": """SELECT snapshot_date, s_suppkey::VARCHAR AS ticker,
        snapshot_date >= make_date((1995 + s_suppkey % 5)::INT, 1, 1) AS is_in FROM supplier CROSS JOIN snapdates""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel)",
    "ctx": f"SELECT date, mkt_ret AS cr, {r('sum', 'mkt_ret', 21, part='1')} AS cr21 FROM market",
    "pairs": f"""SELECT date, ticker, count(*) OVER (PARTITION BY ticker) AS np,
          {r('covar_samp', 'ret, cr', 60).replace('count(ret, cr)', 'count(ret)')} / nullif({r('var_samp', 'cr', 60)}, 0) AS b60
        FROM rets JOIN ctx USING (date) WHERE ret IS NOT NULL AND cr IS NOT NULL""",
    "prep": """SELECT p.*, ctx.cr, ctx.cr21, b.b60, b.ticker IS NOT NULL AS pair,
          coalesce(max(b.np) OVER (PARTITION BY p.ticker), 0) AS np
        FROM rets p LEFT JOIN ctx USING (date) LEFT JOIN pairs b USING (date, ticker)""",
    "core0": f"""SELECT *, close / {lag('close', 21)} - 1 AS return_1m, close / {lag('close', 63)} - 1 AS return_3m,
          close / {lag('close', 126)} - 1 AS return_6m, close / {lag('close', 252)} - 1 AS return_12m,
          close / {lag('close', 5)} - 1 AS return_5d, close / {lag('close', 10)} - 1 AS return_10d,
          (close - {r('avg', 'close', 20)}) / nullif({r('stddev_samp', 'close', 20)}, 0) AS bollinger_distance,
          {r('avg', 'ret', 60)} / nullif({r('stddev_samp', 'ret', 60)}, 0) * sqrt(252.0) AS rolling_sharpe,
          volume / nullif({r('avg', 'volume', 20)}, 0) AS volume_shock,
          abs(ret) / nullif(volume * close, 0) AS amihud_illiquidity,
          {r('stddev_samp', 'ret', 20)} / nullif({r('stddev_samp', 'ret', 60)}, 0) AS volatility_regime,
          {r('stddev_samp', 'ret', 20)} AS sd20, {r('var_samp', 'ret', 60)} AS vy, {r('var_samp', 'cr', 60)} AS vx,
          last_value(CASE WHEN pair THEN coalesce(b60, 1.0) END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS beta1,
          last_value(cr21 IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS cr21f
        FROM prep""",
    "core1": """SELECT *, CASE WHEN np > 60 THEN return_1m - beta1 * cr21f ELSE return_1m END AS residual_momentum,
          CASE WHEN np > 60 THEN CASE WHEN vy IS NOT NULL AND vx IS NOT NULL AND beta1 IS NOT NULL
            THEN sqrt(greatest(0.0, vy - beta1 * beta1 * vx)) END ELSE sd20 END AS idiosyncratic_volatility FROM core0""",
    "core": "SELECT date, ticker, close, " + ", ".join(
        f"{lag(x)} AS {x}" for x in (
            "return_1m", "return_3m", "return_6m", "residual_momentum", "return_5d", "return_10d", "bollinger_distance",
            "volume_shock", "amihud_illiquidity", "idiosyncratic_volatility", "volatility_regime")
    ) + ", NULL::DOUBLE AS roe, NULL::DOUBLE AS roa, NULL::DOUBLE AS earnings_growth FROM core1",
    "scores": f"SELECT date, ticker, {pctrank('bollinger_distance')} AS score FROM core WHERE bollinger_distance IS NOT NULL",
    "rebals": "SELECT min(date) AS rebal_date FROM (SELECT DISTINCT date FROM scores) GROUP BY date_trunc('month', date)",
    "weights": """SELECT k AS portfolio_id, date AS rebal_date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY k, date) AS weight
        FROM (SELECT s.date, s.ticker, row_number() OVER (PARTITION BY s.date ORDER BY score DESC, s.ticker) AS rn
              FROM scores s JOIN rebals ON s.date = rebal_date) CROSS JOIN (VALUES (5), (10)) v(k) WHERE rn <= k""",
    "facret": "SELECT date, sector AS factor, avg(ret) AS ret FROM rets JOIN smap USING (ticker) WHERE ret IS NOT NULL GROUP BY ALL",
    "fwide": """SELECT date, avg(CASE WHEN sector = 'ASIA' THEN ret END) AS asia, avg(CASE WHEN sector = 'EUROPE' THEN ret END) AS europe
        FROM rets JOIN smap USING (ticker) WHERE ret IS NOT NULL GROUP BY date""",
    "adv": f"""SELECT date, ticker, last_value(m IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS adv FROM (
        SELECT date, ticker, {r('avg', '(close*volume)', 20, 5)} AS m FROM panel)""",
    "expo": """SELECT c.date, c.idx, coalesce(v.e, 1.0::DOUBLE) AS exposure FROM cal c ASOF LEFT JOIN (
        SELECT date, (CASE WHEN close < 22 THEN 1.0 WHEN close <= 30 THEN 0.8 ELSE 0.6 END)::DOUBLE AS e FROM vix) v ON c.date >= v.date""",
    "sp": """SELECT *, coalesce(lead(s) OVER (PARTITION BY portfolio_id ORDER BY s), 1000000000) - 1 AS e FROM (
        SELECT DISTINCT portfolio_id, rebal_date, idx AS s FROM weights JOIN cal ON date = rebal_date)""",
    "held": """SELECT w.portfolio_id, n.date, n.idx, w.ticker, w.weight * d.exposure AS weight FROM weights w JOIN sp USING (portfolio_id, rebal_date)
        JOIN expo d ON d.idx BETWEEN s AND e JOIN cal n ON n.idx = d.idx + 1""",
    "grid": "SELECT portfolio_id, date, idx FROM (SELECT DISTINCT portfolio_id FROM weights) CROSS JOIN cal",
    "gross0": """SELECT g.portfolio_id, g.date, g.idx, coalesce(x.gross, 0.0) AS gross FROM grid g LEFT JOIN (
        SELECT portfolio_id, h.date, sum(weight * ret) AS gross FROM held h JOIN rets r ON h.date = r.date AND h.ticker = r.ticker AND ret IS NOT NULL GROUP BY 1, 2) x
        ON g.portfolio_id = x.portfolio_id AND g.date = x.date""",
    "scal": f"""SELECT *, CASE WHEN v IS NULL THEN 1.0 WHEN v = 0 THEN 1.0 ELSE greatest(0.2, least(1.0, 0.18 / v)) END AS scalar FROM (
        SELECT *, {r('stddev_samp', 'gross', 60, 20, part='portfolio_id')} * sqrt(252.0) AS v FROM gross0)""",
    "held2": "SELECT h.portfolio_id, h.date, h.idx, h.ticker, weight * scalar AS weight FROM held h JOIN scal USING (portfolio_id, date)",
    "trd": """SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.ticker, b.ticker) AS ticker,
        abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS trade FROM held2 a FULL JOIN held2 b
        ON a.portfolio_id = b.portfolio_id AND a.ticker = b.ticker AND a.idx = b.idx + 1""",
    "cost": """SELECT portfolio_id, t.date, sum(trade) AS turnover, sum(trade) * 0.0015 AS fixed_cost,
        sum(0.1 * pow(trade * 1e5 / greatest(coalesce(adv, 1.0), 1.0), 2)) AS impact_cost
        FROM (SELECT trd.*, date FROM trd JOIN cal USING (idx) WHERE trade > 1e-12) t ASOF LEFT JOIN adv ON t.ticker = adv.ticker AND t.date >= adv.date GROUP BY 1, 2""",
    "net0": """SELECT s.portfolio_id, s.date, gross * scalar AS gross, scalar, coalesce(turnover, 0) AS turnover, coalesce(fixed_cost, 0) AS fixed_cost,
        coalesce(impact_cost, 0) AS impact_cost, gross * scalar - coalesce(fixed_cost, 0) - coalesce(impact_cost, 0) AS net
        FROM scal s LEFT JOIN cost c ON s.portfolio_id = c.portfolio_id AND s.date = c.date""",
    "bt": """SELECT *, equity / max(equity) OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS drawdown FROM (
        SELECT *, 1e5 * product(1 + net) OVER (PARTITION BY portfolio_id ORDER BY date) AS equity FROM net0)""",
    "calpx": "SELECT p.date, ticker, close, idx FROM panel p JOIN cal USING (date)",
    "ops": "SELECT event_id, ts, 'op_' || (user_id % 10)::VARCHAR AS operation, value * 10 AS latency_ms, event_type <> 'error' AS success FROM events",
    "alerts": """SELECT event_id, ts, CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 75 THEN 'WARNING' ELSE 'INFO' END AS severity,
        event_type AS category, 'm' || (user_id % 3)::VARCHAR AS metric, value FROM events""",
    "news": "SELECT doc_id, substr(text, 1, 80) AS headline, text AS content, source AS symbol FROM documents",
}


def ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the shared expressions it uses, directly or not."""
    defs = {**PARTS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str, self_name: str | None = None) -> None:
        for name in defs:
            if name != self_name and name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(defs[name], name)

    visit(body)
    used = [n for n in defs if n in needed]
    order: list[str] = []

    def place(n: str) -> None:
        if n in order:
            return
        for m in used:
            if m != n and re.search(rf"\b(FROM|JOIN)\s+{m}\b", defs[n]):
                place(m)
        order.append(n)

    for n in used:
        place(n)
    head = ",\n".join(f"{n} AS ({defs[n]})" for n in order)
    return f"WITH {head}\n{body}" if head else body


def fin(columns: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Report form: ``x`` rounds a double, ``x:k`` keeps, ``x:d`` is a date, ``x:i`` an integer,
    ``x:2`` rounds to two places."""
    out = []
    for spec in columns.split():
        name, _, kind = spec.partition(":")
        if kind.isdigit():
            p = f"1e{kind}"
            out.append(f"floor({name}::DOUBLE * {p} + 0.5) / {p} + 0.0 AS {name}")
            continue
        out.append({
            "": f"floor({name}::DOUBLE * 1e6 + 0.5) / 1e6 + 0.0 AS {name}", "k": name,
            "d": f"CAST({name}::DATE AS VARCHAR) AS {name}", "i": f"{name}::BIGINT AS {name}",
        }[kind])
    return ctes(f"SELECT {', '.join(out)} FROM ({body}) fin", extra)
