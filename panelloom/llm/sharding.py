"""Sharding by histogram sort: exact byte counts below probes, refined until splitters fit,
then one exchange."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stage, unstage

#: Low bits of a key: they order the copies of one text; the high bits come from the text.
COPY_BITS = 24
LOWEST, HIGHEST = -(2**63), 2**63


def text_size(text):
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text, doc_id):
    """64-bit key: copies of a text are neighbours, and inside such a group the id decides."""
    low = F.lit(2**COPY_BITS - 1)
    of_text = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(-(2**COPY_BITS)))
    return of_text.bitwiseOR(F.xxhash64(doc_id, F.lit(7)).bitwiseAND(low))


def count_below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Exact bytes and rows with a key below each probe, and the totals.

    One aggregation; what comes back has one row per gap between probes.
    """

    @F.pandas_udf("int")
    def gap(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(probes, key.to_numpy(), side="right").astype("int32"))

    hist = keys.groupBy(gap("key").alias("gap")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    size, rows = np.zeros(len(probes) + 1, "int64"), np.zeros(len(probes) + 1, "int64")
    for r in hist:
        size[r.gap], rows[r.gap] = r.b, r.n
    return size.cumsum()[:-1], rows.cumsum()[:-1], int(size.sum()), int(rows.sum())


def _inner_probes(lo: int, hi: int, k: int) -> list[int]:
    """About k keys inside (lo, hi): borders between texts while there are any, else keys
    inside one text's copies."""
    unit = 1 << COPY_BITS if hi - lo > 1 << COPY_BITS else 1
    step = max((hi - lo) // (k + 1) // unit, 1) * unit
    first = (lo // unit + 1) * unit
    return [p for p in range(first, hi, step) if lo < p < hi][: 2 * k]


def find_splitters(keys: DataFrame, shards: int, ranges: int, tolerance: float, probes: int = 32):
    """Keys that cut the sorted rows into ``ranges`` parts of near-equal bytes.

    Every ``ranges / shards``-th splitter is a shard border and is placed within
    ``tolerance`` of a shard's size; the others only bound the work of a task and may be
    looser.  A border falls between different texts if one is near enough; only a group of
    copies too large for that is cut, by id.  Returns the splitters and the rows below them.
    """
    grid = max(64, 4 * ranges)
    ask = np.array([LOWEST + (2**64 // grid) * i for i in range(1, grid)], dtype="object")
    ask = (ask >> COPY_BITS) << COPY_BITS
    known: dict[int, tuple[int, int]] = {LOWEST: (0, 0)}
    total = 1
    found: dict[int, int] = {}
    while True:
        ask = np.array(sorted(set(ask.tolist()) - known.keys()), dtype="int64")
        if len(ask):
            b, n, total, rows = count_below(keys, ask)
            known.update({int(p): (int(x), int(y)) for p, x, y in zip(ask, b, n)})
            known[HIGHEST] = (total, rows)
        at = sorted(known)
        below = np.array([known[p][0] for p in at], dtype="int64")
        more: set[int] = set()
        for j in range(1, ranges):
            if j in found:
                continue
            goal = total * j / ranges
            i = int(np.searchsorted(below, goal, side="left"))
            i = min(max(i, 1), len(at) - 1)
            lo, hi = at[i - 1], at[i]
            best = lo if goal - below[i - 1] <= below[i] - goal and lo > LOWEST else hi
            slack = tolerance * total / shards if j * shards % ranges == 0 else 0.25 * total / ranges
            inner = _inner_probes(lo, hi, probes) if known[hi][1] - known[lo][1] > 1 else []
            if best < HIGHEST and abs(known[best][0] - goal) <= slack or not inner:
                found[j] = min(best, HIGHEST - 1)
                known.setdefault(found[j], known[best])
            else:
                more.update(inner)
        if not more:
            break
        ask = np.array(list(more), dtype="object")
    split = [found[j] for j in range(1, ranges)]
    split = np.maximum.accumulate(np.array(split, dtype="int64")) if split else np.array([], dtype="int64")
    return split, [known[int(p)][1] for p in split]


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, task_bytes: int = 512 << 20) -> DataFrame:
    """Deal all rows of ``docs`` (``doc_id``, ``text``, any others) into shards of near-equal
    bytes.

    Returns one row per input row: ``doc`` (struct of all input columns), ``size``, ``shard``,
    ``slot`` (gapless from 0 in each shard, in key order).  Each shard's borders lie within
    ``tolerance`` of a shard's mean size from the ideal place (or as near as single rows
    allow).  Equal texts share a shard unless their group is too large for that tolerance.
    Null texts count as empty ones; rows equal in id and text stay together; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text_size(docs["text"]).alias("size"),
        sort_key(docs["text"], docs["doc_id"]).alias("key"),
    )
    keys = stage(rows.select("key", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = shards * max(math.ceil(tasks / shards), math.ceil(total / task_bytes / shards), 1)
    splitters, rows_below = find_splitters(keys, shards, ranges, tolerance)
    unstage(keys)
    per_shard = ranges // shards
    starts = np.array([0, *rows_below], dtype="int64")
    first_slot = starts - starts[(np.arange(ranges) // per_shard) * per_shard]

    @F.pandas_udf("range int, first_slot long")
    def place(key: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(splitters, key.to_numpy(), side="right")
        return pd.DataFrame({"range": at.astype("int32"), "first_slot": first_slot[at]})

    placed = rows.withColumn("place", place("key")).select("doc", "size", "key", "place.range", "place.first_slot")
    order = Window.partitionBy("range").orderBy("key", "doc.doc_id", "size")
    return placed.repartition(ranges, "range").select(
        "doc", "size", (F.col("range") / per_shard).cast("int").alias("shard"),
        (F.col("first_slot") + F.row_number().over(order) - 1).alias("slot"),
    )
