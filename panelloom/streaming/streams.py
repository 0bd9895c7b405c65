"""Structured Streaming forms of the live monitors.

Each takes a streaming DataFrame and returns one (or starts a query); sinks and
checkpoints belong in the cluster's shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelloom.operators.monitoring import KEY

c = F.col


def throttle_stream(alerts: DataFrame, cooldown: float = 300.0, hourly_cap: int = 100, late: str = "10 minutes") -> DataFrame:
    """Alerts that pass the cool-down per key and the hourly cap per ``service``.

    State per service: last firing of each recently fired key and the firings of the last
    hour, so it is bounded by the cap.  A micro-batch is handled in time order.
    """

    def step(key, batches: Iterator["pd.DataFrame"], state: GroupState) -> Iterator["pd.DataFrame"]:
        import pandas as pd

        last, hour = json.loads(state.get[0]) if state.exists else ({}, [])
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        keep = []
        for t, k in zip(pdf["t"], pdf["key"]):
            hour = [x for x in hour if t - x < 3600.0]
            hit = t - last.get(k, -float("inf")) >= cooldown and len(hour) < hourly_cap
            if hit:
                last[k] = t
                hour.append(t)
            keep.append(hit)
        newest = pdf["t"].max()
        last = {k: v for k, v in last.items() if newest - v < cooldown}
        state.update((json.dumps([last, hour]),))
        yield pdf.loc[keep, ["service", "event_id", "key", "t"]]

    rows = alerts.withWatermark("ts", late).select(
        "service", "event_id", F.concat_ws(".", *KEY).alias("key"), c("ts").cast("double").alias("t"))
    return rows.groupBy("service").applyInPandasWithState(
        step, "service string, event_id bigint, key string, t double", "state string", "append", GroupStateTimeout.NoTimeout)


def operations_stream(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Latency and errors per operation and event-time window; late rows beyond the watermark are dropped."""
    p = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 1000)
    g = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum((~c("success")).cast("bigint")).alias("errors"), F.avg("latency_ms").alias("mean_ms"),
        F.max("latency_ms").alias("max_ms"), p.alias("p"))
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), "operation", "calls", "errors",
                    (c("errors") / c("calls")).alias("error_rate"), "mean_ms", "max_ms",
                    c("p")[0].alias("p50_ms"), c("p")[1].alias("p95_ms"), c("p")[2].alias("p99_ms"))


def quality_stream(feed: DataFrame, numeric: list[str], keys: list[str], as_of: str, out: str, checkpoint: str, date: str = "date", **trigger) -> StreamingQuery:
    """Run the feed checks on every micro-batch and append the report to ``out``.

    The batch id is part of the path, so a repeated batch overwrites its own report.
    """
    from panelloom.operators.quality import feed_checks

    def check(batch: DataFrame, batch_id: int) -> None:
        report = feed_checks(batch, numeric, keys, as_of, date)
        report.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return feed.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is available into a Parquet table and return the table."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
