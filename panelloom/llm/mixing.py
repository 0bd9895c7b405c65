"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import WORD, running_sum, stage

GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source (by code point, null last): index ``s``, ``source_size``, ``target``.

    Weights repeat over the sources.  A target stops at ``cap`` times the source's size; the
    excess goes to the others by weight until none is above: all uncapped sources then share
    one level, target / weight, which is found from the sources in order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    of = F.array(*[F.lit(float(w)) for w in weights])
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("s", F.row_number().over(by_name) - 1)
        .withColumn("w", F.element_at(of, F.col("s") % len(weights) + 1))
        .withColumn("most", cap * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "s")
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))
    t = t.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(so_far), F.lit(0.0))))
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))
    # Beyond the right place the level only falls: the first that fits is the greatest.
    t = t.withColumn("water", F.max(fits).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("w"), F.col("most")))
    return t.select("s", "source", "source_size", target.alias("target"))


def slots(goals: list[int], block: int, spark) -> DataFrame:
    """The schedule: slot number ``slot``, source index ``s``, ``rank`` of the slot among its
    source's slots.

    Slot n takes the source whose interval of cumulative goal shares holds the n-th
    golden-ratio point.  The points are spread so evenly that any run of slots holds each
    source in proportion.  The sequence runs on until every source has all its blocks.
    """
    need = np.array([-(-g // block) for g in goals], dtype="int64")
    edges = np.cumsum(np.array(goals, dtype="float64")) / max(sum(goals), 1)

    def source_of(n: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(edges, np.modf((n + 0.5) * GOLDEN)[0], side="right"), len(goals) - 1)

    @F.pandas_udf("int")
    def pick(n: pd.Series) -> pd.Series:
        return pd.Series(source_of(n.to_numpy()).astype("int32"))

    least = min((g for g in goals if g), default=1)
    slack = int(need.sum() * 0.02 + 16 * sum(goals) / least + 64)
    run = spark.range(int(need.sum()) + slack).select(F.col("id").alias("slot"), pick("id").alias("s"))
    run = run.withColumn("stretch", (F.col("slot") / 65536).cast("long"))
    return running_sum(run, ["s"], "stretch", ["slot"], F.lit(1), "rank").drop("stretch")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, most_slots: int = 4_000_000,
        most_sources: int = 100_000, bucket_rows: int = 50_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Plan a mixture of all ``docs`` (``doc_id``, ``text``, ``source``) in words.

    Each source's documents stand in hash order and are read up to ``cap`` times, cut into
    blocks of equal words; the schedule's r-th slot of a source takes its r-th block, the
    last block being cut at the target.  Returns one row per input row: ``doc_id``,
    ``source``, ``size`` (words), ``source_size``, ``target``, ``takes`` (words taken in each
    reading), ``taken`` (their sum over the slots joined), ``first_slot`` (null if none),
    ``slots`` (the first slot of each reading that takes words).

    The order comes from hashes of ids, so reruns agree.  Null or empty texts have no words
    and take none; a null source is a source of its own, last in order; rows that repeat an
    id count each; an empty table gives no rows.  More than ``most_sources`` sources are
    refused, since the schedule holds one number per source.  The columns named in ``carry``
    are returned too and put rows in order that have one id and size.
    """
    spark = docs.sparkSession
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    sizes = docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row"), *carry)
    sizes = stage(sizes, "mix-sizes")
    targets = stage(source_targets(sizes, weights, share, cap), "mix-targets")
    if targets.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    goals = [int(r.target + 0.5) for r in targets.orderBy("s").collect()]
    block = max(1, min((g for g in goals if g), default=1) // 64, sum(goals) // most_slots)

    # Buckets split every source, so a hot one fills as many tasks as there are.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes.count() // bucket_rows)
    goal = F.floor(F.col("target") + 0.5)
    known = targets.select(F.col("source").alias("_source"), "s", "source_size", "target")
    placed = (
        sizes.join(known, sizes["source"].eqNullSafe(known["_source"])).drop("_source")
        .withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    )
    placed = running_sum(placed, ["s"], "bucket", ["h", "doc_id", "size", *carry], F.col("size"), "at")
    begins = [F.col("at") + i * F.col("source_size") for i in range(int(cap))]
    takes = F.array(*[F.greatest(F.least(goal - b, F.col("size")), F.lit(0)).cast("long") for b in begins])
    placed = stage(placed.withColumn("takes", takes).drop("bucket", "h"), "mix-placed")

    reading = placed.select("row", "s", "at", "source_size", F.posexplode("takes").alias("reading", "take")).where("take > 0")
    begin = F.col("at") + F.col("reading") * F.col("source_size")
    reading = reading.select("row", "reading", "s", begin.alias("a"), (begin + F.col("take")).alias("z"))
    spans = F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))
    parts = reading.select("row", "reading", "s", "a", "z", F.explode(spans).alias("rank"))
    words = F.least(F.col("z"), (F.col("rank") + 1) * block) - F.greatest(F.col("a"), F.col("rank") * block)
    parts = parts.select("row", "reading", "s", "rank", words.alias("words"))
    per_reading = parts.join(slots(goals, block, spark), ["s", "rank"]).groupBy("row", "reading").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    got = per_reading.groupBy("row").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.map_from_entries(F.collect_list(F.struct("reading", "slot"))).alias("slots")
    )
    return placed.join(got, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", "takes",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "slots", *carry,
    )
