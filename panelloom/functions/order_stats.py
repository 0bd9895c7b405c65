"""Exact ranks and quantiles of groups of any size.

A window ordered inside ``partitionBy(date)`` would sort a whole cross-section in one task.
So each group above ``SLICE_ROWS`` rows is cut at approximate quantiles: the values between
two cut points are a slice, and each cut point is a slice of its own, which holds copies of
one value and needs no order.  The cut points only balance the work; positions come from
exact counts (rows before the slice plus rows before the value inside the slice), so the
result does not depend on the sketch.  The cut points are staged when the plan is built, so
every branch sees the same ones.  Rows cross one shuffle.

``rank_columns`` and ``column_quantiles`` take many columns of one grouping: groups up to
``GROUP_ROWS`` rows travel once, with all columns, and larger ones go column by column
through the slices.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.staging import stage

#: Rows that one task places.
SLICE_ROWS = 250_000
#: Resolution of the sketch: a group of g rows has slices of at least g / STEPS.
STEPS = 1000
#: Rows of a group that one task takes with all its columns.
GROUP_ROWS = 500_000
_ALL = "__all"


def _sliced(df: DataFrame, keys: list[str], value: str, slice_rows: int) -> DataFrame:
    """Add ``__slice``, non-decreasing in ``value`` inside each group: 0 in groups of up to
    ``slice_rows`` values; else odd between two cut points and even on one.  Of the sketch's
    evenly spaced quantiles, a group uses every k-th, by its number of rows.  Only groups
    above one slice are sketched, so there are few cut points and they are broadcast."""
    cuts = [i / STEPS for i in range(1, STEPS)]
    given = df.where(F.col(value).isNotNull()).select(*keys, value)
    large = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > slice_rows)
    sketched = given.join(F.broadcast(large), keys).groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.percentile_approx(value, F.lit(cuts), F.lit(4 * STEPS)).alias("__q"))
    slices = f"least({STEPS}, ceil(__n / {slice_rows}))"
    edges = stage(sketched.select(*keys, F.expr(
        f"array_distinct(transform(sequence(1, cast({slices} as int) - 1), i -> __q[cast(i * {STEPS} / {slices} as int) - 1]))").alias("__edges")), "edges")
    if edges.isEmpty():
        return df.withColumn("__slice", F.lit(0))
    powers = ", ".join(str(2**k) for k in reversed(range(STEPS.bit_length())))
    # cut points below the value, by bisection
    below = f"aggregate(array({powers}), 0, (a, k) -> if(get(__edges, a + k - 1) < `{value}`, a + k, a))"
    out = df.join(F.broadcast(edges), keys, "left").withColumn("__below", F.expr(f"if(__edges is null or `{value}` is null, -1, {below})"))
    on = F.expr(f"coalesce(get(__edges, __below) = `{value}`, false)").cast("int")
    return out.withColumn("__slice", F.when(F.col("__below") >= 0, 1 + 2 * F.col("__below") + on).otherwise(0)).drop("__edges", "__below")


def sliced(df: DataFrame, value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``__slice``, the place of its value among slices of all rows: see the module's
    text; 0 where all fit one slice, even where a slice holds copies of one value."""
    return _sliced(df.withColumn(_ALL, F.lit(0)), [_ALL], value, slice_rows).drop(_ALL)


def _offsets(cut: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals before each slice, in it and of the whole group: one row per slice of the groups that are cut."""
    counts = cut.where("__slice > 0").groupBy(*keys, "__slice").agg(*[v.alias(f"__in_{n}") for n, v in sums.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys, "__slice",
        *[F.coalesce(F.sum(f"__in_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *[F.col(f"__in_{n}") for n in sums],
        *[F.sum(f"__in_{n}").over(group).alias(f"__tot_{n}") for n in sums],
    )


def _known(keys: list[str]) -> Column:
    """Rows without a key belong to no group."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def ordered_counts(df: DataFrame, keys: list[str], value: str, slice_rows: int = SLICE_ROWS, **extra: Column) -> DataFrame:
    """One row per distinct non-null ``value`` of a group, with its exact place.

    Equal values are counted before the shuffle, so copies cost one row.

    Columns: keys, value, ``cnt`` (copies), ``first_pos``/``last_pos`` (1-based places in
    ascending order) and ``total``.  Each ``extra`` sum-like aggregate ``a`` gives
    ``cum_a`` (running total up to and including the value) and ``total_a``.
    """
    tag = not keys
    if tag:
        keys, df = [_ALL], df.withColumn(_ALL, F.lit(0))
    sums = {"cnt": F.count(F.lit(1)), **extra}
    rows = _sliced(df.where(F.col(value).isNotNull() & _known(keys)), keys, value, slice_rows)
    cut = rows.groupBy(*keys, "__slice", value).agg(*[c.alias(n) for n, c in sums.items()])
    part = Window.partitionBy(*keys, "__slice")
    inside = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select(
        "*", *[F.sum(n).over(inside).alias(f"__run_{n}") for n in sums], *[F.sum(n).over(part).alias(f"__own_{n}") for n in sums],
    ).join(F.broadcast(_offsets(cut, keys, {n: F.sum(n) for n in sums})), keys + ["__slice"], "left")
    run = lambda n: F.coalesce(F.col(f"__off_{n}"), F.lit(0)) + F.col(f"__run_{n}")
    total = lambda n: F.coalesce(F.col(f"__tot_{n}"), F.col(f"__own_{n}"))
    out = placed.select(
        *keys, value, "cnt",
        (run("cnt") - F.col("cnt") + 1).alias("first_pos"), run("cnt").alias("last_pos"), total("cnt").alias("total"),
        *[run(n).alias(f"cum_{n}") for n in extra],
        *[total(n).alias(f"total_{n}") for n in extra],
    )
    return out.drop(_ALL) if tag else out


def _places(df: DataFrame, keys: list[str], value: str, slice_rows: int) -> DataFrame:
    """Every row with ``__first``, ``__last`` place of its value and ``__total``; null values get null.

    Rows without a value, and copies of a cut point, are spread: their places need no order."""
    columns, tag = df.columns, not keys
    if tag:
        keys, df = [_ALL], df.withColumn(_ALL, F.lit(0))
    cut = _sliced(df, keys, value, slice_rows)
    off = F.broadcast(stage(_offsets(cut, keys, {"n": F.count(F.lit(1))}), "offsets"))  # so a chain of ranks reads its rows once
    v, single = F.col(value), (F.col("__slice") > 0) & (F.col("__slice") % 2 == 0)
    spread = cut.withColumn("__part", F.when(v.isNull() | single, F.spark_partition_id()).otherwise(-1))
    part = Window.partitionBy(*keys, "__slice", "__part")
    order = part.orderBy(v.asc_nulls_last())
    placed = spread.withColumns({"__rank": F.rank().over(order), "__upto": F.count(v).over(order), "__own": F.count(v).over(part)})
    placed = placed.join(off, [*keys, "__slice"], "left")
    before = F.coalesce(F.col("__off_n"), F.lit(0).cast("bigint"))
    place = lambda x: F.when(v.isNotNull(), x.cast("bigint"))
    return placed.where(_known(keys) | v.isNull()).select(
        *columns,
        place(F.when(single, before + 1).otherwise(before + F.col("__rank"))).alias("__first"),
        place(F.when(single, before + F.col("__in_n")).otherwise(before + F.col("__upto"))).alias("__last"),
        place(F.coalesce(F.col("__tot_n"), F.col("__own"))).alias("__total"))


def average_rank(
    df: DataFrame, keys: list[str], value: str, out: str, slice_rows: int = SLICE_ROWS, centred: bool = False
) -> DataFrame:
    """Rank inside the group, ties sharing their average place; null stays null.

    ``centred`` subtracts the mean rank, which leaves exact multiples of one half.
    """
    rank = (F.col("__first") + F.col("__last")) / 2.0
    if centred:
        rank = rank - (F.col("__total") + 1) / 2.0
    return _places(df, keys, value, slice_rows).withColumn(out, rank).drop("__first", "__last", "__total")


def counted_rank(df: DataFrame, keys: list[str], value: str, count: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Centred average rank of ``value`` in the group where each row, the only one with its value,
    stands for ``count`` copies."""
    cut = _sliced(df, keys, value, slice_rows)
    part = Window.partitionBy(*keys, "__slice")
    placed = cut.withColumns({
        "__upto": F.sum(count).over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__own": F.sum(count).over(part)})
    placed = placed.join(F.broadcast(_offsets(cut, keys, {"n": F.sum(count)})), [*keys, "__slice"], "left")
    rank = F.coalesce("__off_n", F.lit(0)) + F.col("__upto") - (F.col(count) - 1) / 2.0 - (F.coalesce("__tot_n", "__own") + 1) / 2.0
    return placed.select(*df.columns, rank.alias(out))


def percent_rank(
    df: DataFrame, keys: list[str], value: str, out: str, descending: Column | bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Average rank over the number of non-null values, in (0, 1]."""
    up = (F.col("__first") + F.col("__last")) / 2.0
    if isinstance(descending, bool):
        descending = F.lit(descending)
    rank = F.when(descending, F.col("__total") + 1.0 - up).otherwise(up)
    return _places(df, keys, value, slice_rows).withColumn(out, rank / F.col("__total")).drop("__first", "__last", "__total")


def quantiles(
    df: DataFrame, keys: list[str], value: str, qs: dict[str, float | Column], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per group, a column per entry of ``qs``.

    A level may be a column over ``total`` (the group's non-null count).
    """
    pos = _places(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value, slice_rows).withColumnsRenamed(
        {"__first": "first_pos", "__last": "last_pos", "__total": "total"})
    picks = []
    for name, q in qs.items():
        level = q if isinstance(q, Column) else F.lit(float(q))
        h = (F.col("total") - 1) * level
        k = F.floor(h)
        hit = lambda p: F.max(F.when((F.col("first_pos") <= p) & (F.col("last_pos") >= p), F.col(value)))
        picks += [
            hit(k + 1).alias(f"__lo_{name}"),
            hit(F.least(k + 2, F.col("total"))).alias(f"__hi_{name}"),
            F.max(h - k).alias(f"__f_{name}"),
        ]
    got = pos.groupBy(*keys).agg(*picks) if keys else pos.agg(*picks)
    lerp = lambda n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")
    return got.select(*keys, *[lerp(n).alias(n) for n in qs])


def row_positions(
    df: DataFrame, keys: list[str], value: str, tie: str, out: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Unique 1-based place by (``value``, ``tie``) ascending plus the group's count.

    Rows with a null ``value`` are dropped.  Adds ``out`` and ``total``.
    """
    df = df.where(F.col(value).isNotNull() & _known(keys))
    cut = _sliced(df, keys, value, slice_rows)
    part = Window.partitionBy(*keys, "__slice")
    placed = cut.withColumns({"__rn": F.row_number().over(part.orderBy(value, tie)), "__own": F.count(F.lit(1)).over(part)})
    off = F.broadcast(stage(_offsets(cut, keys, {"n": F.count(F.lit(1))}), "offsets"))
    placed = placed.join(off, keys + ["__slice"], "left")
    return placed.select(
        *df.columns, (F.coalesce(F.col("__off_n"), F.lit(0)) + F.col("__rn")).alias(out), F.coalesce(F.col("__tot_n"), F.col("__own")).alias("total"))


# -- many columns of one grouping ------------------------------------------------------------

def _by_size(df: DataFrame, keys: list[str], group_rows: int, like: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups that one task takes, and of the larger ones, if there are any.
    ``like``: a table with the same rows per group, or more, that is cheaper to count."""
    counts = (df if like is None else like).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = stage(counts.where((F.col("__n") > group_rows) & _known(keys)).select(*keys), "large")
    if large.isEmpty():
        return df, None
    return df.join(F.broadcast(large), keys, "left_anti"), df.join(F.broadcast(large), keys, "left_semi")


def _kernels():
    """Functions for the tasks, nested so that they travel with them."""

    def numbers(column):
        """Which rows have a value, and those values (one zero only)."""
        column = column.combine_chunks()
        return column.is_valid().to_numpy(zero_copy_only=False), column.drop_null().to_numpy(zero_copy_only=False) + 0.0

    def average_ranks(values):
        """Places from 1 in ascending order, ties sharing their average, and unique ones, equal
        values in row order; NaN is the greatest and equals itself."""
        order = np.argsort(values, kind="stable")
        s = values[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(s)) if len(s) else start
        out, own = np.empty(len(s)), np.empty(len(s), "int64")
        out[order] = np.repeat((start + 1 + end) / 2.0, end - start)
        own[order] = np.arange(1, len(s) + 1)
        return out, own

    return numbers, average_ranks


def rank_columns(
    df: DataFrame, keys: list[str], values: list[str], descending: Iterable[str] = (), centred: bool = False,
    tie: str | None = None, like: DataFrame | None = None, group_rows: int | None = None, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Replace every column by its percentile rank (or centred average rank) inside the group; null stays null.

    With ``tie``, ``__place_<column>`` is the unique place by (value, ``tie``) ascending.  A row
    without a key stays, unranked, where one of its values is null, and is dropped otherwise,
    as with a single column.
    """
    down = set(descending)
    df = df.withColumns({v: F.col(v).cast("double") for v in values})
    small, large = _by_size(df, keys, group_rows or GROUP_ROWS, like)
    numbers, average_ranks = _kernels()
    order = [*df.columns, *[f"__place_{v}" for v in values if tie]]

    def rank(key, table):
        lost = any(k.as_py() is None for k in key[:-1])
        if tie:
            table = table.take(pc.sort_indices(table.column(tie), null_placement="at_start"))
        for v in values:
            has, x = numbers(table.column(v))
            out, place = np.zeros(len(has)), np.zeros(len(has), "int64")
            if not lost:
                n = len(x)
                up, own = average_ranks(x)
                place[has] = own
                out[has] = up - (n + 1) / 2.0 if centred else ((n + 1.0 - up if v in down else up) / n if n else up)
            missing = np.ones(len(has), bool) if lost else ~has
            table = table.set_column(table.column_names.index(v), v, pa.array(out, mask=missing))
            if tie:
                table = table.append_column(f"__place_{v}", pa.array(place, mask=missing))
        return table

    any_null = F.lit(False)
    for v in values:
        any_null = any_null | F.col(v).isNull()
    # rows without a key share no group: they stay spread
    small = small.where(_known(keys) | any_null).withColumn("__part", F.when(_known(keys), -1).otherwise(F.spark_partition_id()))
    fields = [T.StructField(f.name, f.dataType) for f in small.schema] + [T.StructField(f"__place_{v}", T.LongType()) for v in values if tie]
    ranked = small.groupBy(*keys, "__part").applyInArrow(rank, T.StructType(fields))
    if large is None:
        return ranked.select(*order)
    if like is not None:
        large = stage(large, "wide")  # each column reads them more than once
    for v in values:
        if tie:
            none = large.where(F.col(v).isNull()).withColumn(f"__place_{v}", F.lit(None).cast("bigint"))
            large = row_positions(large, keys, v, tie, f"__place_{v}", slice_rows).drop("total").unionByName(none)
        if centred:
            large = average_rank(large, keys, v, "__r", slice_rows, centred=True)
        else:
            large = percent_rank(large, keys, v, "__r", v in down, slice_rows)
        large = large.withColumn(v, F.col("__r")).drop("__r")
    return ranked.select(*order).unionByName(large.select(*order))


def column_quantiles(
    df: DataFrame, keys: list[str], values: list[str], qs: dict[str, float],
    like: DataFrame | None = None, group_rows: int | None = None, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles of many columns: one row per group, ``<name>_<value>`` each."""
    df = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    small, large = _by_size(df, keys, group_rows or GROUP_ROWS, like)
    names = [f"{q}_{v}" for v in values for q in qs]
    fields = [T.StructField(f.name, f.dataType) for f in df.select(*keys).schema]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    numbers, _ = _kernels()

    def cut(key, table):
        out = {k: table.column(k).slice(0, 1) for k in keys}
        for v in values:
            _, x = numbers(table.column(v))
            x.sort()
            for name, level in qs.items():
                got = None
                if len(x):
                    h = (len(x) - 1) * level
                    k = int(np.floor(h))
                    lo, hi = x[k], x[min(k + 1, len(x) - 1)]
                    got = lo + (hi - lo) * (h - k)
                out[f"{name}_{v}"] = pa.array([got], pa.float64())
        return pa.table(out)

    got = small.where(_known(keys)).groupBy(*keys).applyInArrow(cut, schema)
    if large is None:
        return got
    long = large.unpivot(keys, values, "__column", "__value")
    cuts = quantiles(long, [*keys, "__column"], "__value", qs, slice_rows).groupBy(*keys).agg(
        *[F.max(F.when(F.col("__column") == v, F.col(q))).alias(f"{q}_{v}") for v in values for q in qs])
    return got.unionByName(cuts)
