"""Column builders shared by all operators.

:class:`Frames` rolls over arrays inside the tasks; everything else stays inside the JVM.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADING_DAYS = 252.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_ticker() -> WindowSpec:
    """One instrument's rows in date order; at most one row per calendar day."""
    return Window.partitionBy("ticker").orderBy("date")


def nz(x) -> Column:
    """Zero becomes null, so a division by it yields null and not an ANSI error."""
    return F.nullif(col(x), F.lit(0.0))


def sqrt0(x) -> Column:
    """Square root of a quantity that rounding may have pushed just below zero."""
    return F.sqrt(F.greatest(F.lit(0.0), col(x)))


#: Widths from which sums and extremes are put together from blocks.
WIDE = 100
#: Cells of neighbouring frames that a task lays side by side.
CELLS = 1 << 16


class Frames:
    """Rolling columns, by default over each instrument's rows in date order.

    A frame holds its own rows and nothing else: each value comes from the ``n`` rows it
    names, so an odd value leaves with the row that brought it and no difference of large
    totals is taken.  NaN and infinities count as missing.  All columns of one level travel
    once, and equal aggregates are computed once however many columns use them.

    Spark deals the rows by instrument and sorts them by date; a task streams through them and
    lays the frames of the instruments at hand side by side as an array.  Sums and extremes of :data:`WIDE` rows and more cost the same for every width:
    the rows are cut into blocks of ``n``, and a frame is the end of one block and the
    beginning of the next.  An own window specification ``w`` is for short series and is
    computed by Spark's windows.  With ``lag``, a row has the values of the row before it.

    Build columns with :meth:`roll`, :meth:`beta` and :meth:`corr`; then ``add(df, cols)``
    adds them.  A rolling value exists only with ``min_rows`` (default: the width) non-null
    inputs in its frame.  :meth:`past`, :meth:`held`, :meth:`total` and :meth:`ever` read other rows
    of the instrument as they are, NaN and infinities included; what an ``add`` leaves lies
    ``dealt`` for the next one, so that columns which use one another cross one exchange.
    """

    def __init__(self, w: WindowSpec | None = None, lag: bool = False):
        self.w, self.lag = w, lag
        self.inputs: dict[str, Column] = {}
        self.totals: dict[str, Column] = {}
        self.parts: dict[str, tuple[str, int, tuple[str, ...], str | None, bool, int]] = {}

    def _input(self, x) -> str:
        """Name of a cleaned input column."""
        name = "__in_" + hashlib.md5(repr(x).encode()).hexdigest()[:12]
        v = col(x).cast("double")
        self.inputs[name] = F.when(F.abs(v) < float("inf"), v)
        return name

    def _value(self, fn, n: int, *names: str, need: int = 0, only: str | None = None, held: bool = False) -> Column:
        """The aggregate of frames with at least ``need`` values."""
        key = f"__{fn.__name__}_{n}_" + "_".join([*names, *([only] if only else []), *(["held"] if held else [])])
        if self.w is None:
            key += f"_{need}" if need else ""
            self.parts[key] = (fn.__name__, n, names, only, held, need)
            return F.col(key)
        self.totals[key] = fn(*[F.col(x) for x in names]).over(self.w.rowsBetween(-(n - 1), 0))
        return F.when(self._value(F.count, n, names[0]) >= need, F.col(key)) if need else F.col(key)

    def count(self, x, n: int) -> Column:
        return self._value(F.count, n, self._input(x))

    def roll(self, fn, x, n: int, min_rows: int | None = None) -> Column:
        return self._value(fn, n, self._input(x), need=min_rows or n)

    def _row(self, fn: str, x, n: int = 0) -> Column:
        """A value of the column as it is, from the instrument's other rows."""
        name = "__raw_" + hashlib.md5(repr(x).encode()).hexdigest()[:12]
        self.inputs[name] = col(x).cast("double")
        key = f"__{fn}_{n}_{name}"
        self.parts[key] = (fn, n, (name,), None, False, 0)
        return F.col(key)

    def past(self, x, k: int = 1) -> Column:
        """The value ``k`` rows before."""
        return self._row("past", x, k)

    def held(self, x) -> Column:
        """The last value up to the row."""
        return self._row("held", x)

    def total(self, x) -> Column:
        """Sum of all rows up to the row."""
        return self._row("total", x)

    def ever(self, x) -> Column:
        """1.0 where any of the instrument's rows has a value, else 0.0."""
        return self._row("ever", x)

    def _pair(self, y, x) -> tuple[str, str]:
        """The inputs where both are present."""
        a, b = self.inputs[self._input(y)], self.inputs[self._input(x)]
        return self._input(F.when(b.isNotNull(), a)), self._input(F.when(a.isNotNull(), b))

    def beta(self, y, x, n: int, only: str | None = None, held: bool = False, default: float | None = None) -> Column:
        """Slope of ``y`` on ``x`` over ``n`` complete pairs.  With ``only``, frames run over the
        rows where that column holds; the others have no value, or with ``held`` the last
        value before them.  ``default`` stands where a frame has no slope."""
        y, x = self._pair(y, x)
        rows = {"only": only, "held": held}
        slope = self._value(F.covar_samp, n, y, x, need=n, **rows) / nz(self._value(F.var_samp, n, x, need=n, **rows))
        return slope if default is None else F.when(self._value(F.count, n, y, **rows).isNotNull(), F.coalesce(slope, F.lit(default)))

    def corr(self, y, x, n: int) -> Column:
        y, x = self._pair(y, x)
        sd = lambda v: self._value(F.stddev_samp, n, v, need=n)
        return self._value(F.covar_samp, n, y, x, need=n) / nz(sd(y) * sd(x))

    def clear(self) -> None:
        """Forgets what was built so far."""
        for x in (self.inputs, self.totals, self.parts):
            x.clear()

    def add(self, df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None, dealt: bool = False) -> DataFrame:
        """``df`` and ``columns``; of its own columns only those to ``keep``, if given.  ``dealt``:
        partitions of ``df`` hold whole instruments in date order, as an ``add`` leaves them."""
        if self.w is None:
            return self._rolled(df, keep or df.columns, dealt).withColumns(columns)
        for extra in (self.inputs, self.totals):
            new = {k: v for k, v in extra.items() if k not in df.columns}
            df = df.withColumns(new) if new else df
        return df.withColumns(columns)

    def _rolled(self, df: DataFrame, keep: list[str], dealt: bool) -> DataFrame:
        """The frames' values that ``df`` has not yet, in one pass over the instruments."""
        todo = {k: part for k, part in self.parts.items() if k not in df.columns}
        if not todo:
            return df.select(*keep)
        inputs = sorted({x for _, _, names, *_ in todo.values() for x in names})
        types = {k: T.LongType() if fn == "count" else T.DoubleType() for k, (fn, *_) in todo.items()}
        kept = df.select(*keep)
        out = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in types.items()]])
        rolled, lag = _kernel(WIDE, CELLS), self.lag
        layouts: dict = {}
        plain = {k: part[:3] for k, part in todo.items() if part[0] in ("past", "held", "total", "ever")}
        for k, (fn, n, names, only, _, need) in todo.items():
            if k not in plain:
                layouts.setdefault((n, only), {})[k] = (fn, n, names, need)
        more = [*inputs, *sorted({only for _, only in layouts if only and only not in keep})]

        begins, run = _streamed()

        def filled(table):
            read = lambda x: table.column(x).combine_chunks()
            values = {x: (read(x).is_valid().to_numpy(zero_copy_only=False), read(x).fill_null(0.0).to_numpy(zero_copy_only=False)) for x in inputs}
            fresh, made = begins(table), {}
            at = np.arange(len(fresh))
            first = np.maximum.accumulate(np.where(fresh, at, 0))
            starts = np.flatnonzero(fresh)

            def put(k, full, known):
                if lag:
                    full, known = np.roll(full, 1), np.roll(known, 1) & ~fresh
                made[k] = pa.array(full, mask=~known)

            for k, (fn, n, (x,)) in plain.items():
                has, v = values[x]
                if fn == "past":
                    from_ = np.maximum(at - n, 0)
                    put(k, v[from_], has[from_] & (at - n >= first))
                elif fn == "ever":
                    put(k, np.repeat(np.logical_or.reduceat(has, starts), np.diff([*starts, len(at)])).astype(float), np.ones(len(at), bool))
                else:
                    last = np.maximum.accumulate(np.where(has, at, -1))
                    with np.errstate(all="ignore"):
                        full = v[last] if fn == "held" else np.concatenate([np.cumsum(x) for x in np.split(v, starts[1:])])
                    put(k, full, last >= first)
            for (n, only), parts in layouts.items():
                live = np.ones(len(fresh), bool) if only is None else read(only).fill_null(False).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(live)
                # n - 1 empty cells before every instrument, so that no frame reaches into another
                place = np.arange(len(rows)) + (n - 1) * np.cumsum(np.append(False, first[rows][1:] != first[rows][:-1])[:len(rows)])
                group, size = {}, place[-1] + 1 if len(rows) else 0
                for x in {x for _, _, names, _ in parts.values() for x in names}:
                    has, v = np.zeros(size, bool), np.zeros(size)
                    has[place], v[place] = values[x][0][rows], values[x][1][rows]
                    group[x] = has, v
                last = np.maximum.accumulate(np.where(live, at, -1))
                for k, (has, v) in (rolled(group, parts) if size else {}).items():
                    full, known = np.zeros(len(fresh), v.dtype), np.zeros(len(fresh), bool)
                    full[rows], known[rows] = v[place], has[place]
                    if todo[k][4]:
                        full, known = full[last], known[last] & (last >= first)
                    put(k, full, known)
            nothing = lambda k: pa.nulls(len(fresh), pa.int64() if todo[k][0] == "count" else pa.float64())
            return pa.Table.from_arrays([*[table.column(x) for x in keep], *[made.get(k, nothing(k)) for k in todo]], names=out.names).to_batches()

        rows = df.withColumns({x: self.inputs[x] for x in inputs}).select(*keep, *more)
        return _dealt(rows, dealt).mapInArrow(lambda batches: run(batches, filled), out)


def _dealt(df: DataFrame, dealt: bool) -> DataFrame:
    return df if dealt else df.repartition("ticker").sortWithinPartitions("ticker", "date")


def _streamed():
    """Functions for the tasks, nested so that they travel with them."""

    def begins(table):
        """Where an instrument's rows begin."""
        ids = table.column("ticker").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.append(True, ids[1:] != ids[:-1])

    def run(batches, fn):
        """``fn`` (table to batches) over tables of whole instruments."""
        rest: list = []  # the instrument whose rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            cut = int(np.flatnonzero(begins(table))[-1])
            if cut:
                yield from fn(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
        if rest:
            yield from fn(pa.Table.from_batches(rest))

    return begins, run


def per_instrument(df: DataFrame, fn, schema, dealt: bool = False) -> DataFrame:
    """``fn`` (Arrow table to Arrow table) on each instrument's rows in date order; rows stay
    whole instruments in order.  ``dealt``: they lie so already."""
    begins, run = _streamed()

    def each(table):
        starts = np.flatnonzero(begins(table))
        parts = [fn(table.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True)]
        return pa.concat_tables(parts).combine_chunks().to_batches()

    return _dealt(df, dealt).mapInArrow(lambda batches: run(batches, each), schema)


def _kernel(wide: int, cells: int):
    """The function for the tasks, nested so that it travels with them."""

    def frames(values, n, a, b):
        """The frames of rows ``a`` to ``b``, one a line; cells before the first row are 0."""
        part = values[max(0, a - n + 1):b]
        lead = np.zeros(max(0, n - 1 - a), values.dtype)
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([lead, part]), n)

    def spans(m, n):
        step = max(1, cells // n)
        return [(a, min(m, a + step)) for a in range(0, m, step)]

    def running(values, n, fn, empty):
        """Sum or extreme of each row's frame."""
        m = len(values)
        if n < wide:
            shown = np.concatenate([np.full(n - 1, empty), values])
            view = np.lib.stride_tricks.sliding_window_view(shown, n)
            return np.concatenate([fn.reduce(view[a:b], axis=1) for a, b in spans(m, n)])
        blocks = np.full(-(-m // n) * n, empty)
        blocks[:m] = values
        blocks = blocks.reshape(-1, n)
        begin = fn.accumulate(blocks, axis=1).ravel()[:m]
        end = fn.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        rows = np.arange(n, m)
        rows = rows[(rows + 1) % n != 0]  # the others are the beginning of one block
        out = begin.copy()
        out[rows] = fn(end[rows - n + 1], begin[rows])
        return out

    def constant(has, x, k):
        """Frames of equal values: no deviation, whatever the rounding of means."""
        v, at = x[has], np.cumsum(has) - 1
        if not len(v):
            return np.ones(len(x), bool)
        place = np.arange(len(v))
        fresh = np.ones(len(v), bool)
        fresh[1:] = v[1:] != v[:-1]
        equal = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1
        return (at < 0) | (k <= equal[np.maximum(at, 0)])

    def rolled(inputs, parts):
        """``{name: (has, value)}`` of each part over one instrument's rows in order."""
        known: dict = {}

        def once(name, fn, *args):
            if (name, *args) not in known:
                known[name, *args] = fn(*args)
            return known[name, *args]

        def count(n, x):
            seen = np.cumsum(inputs[x][0], dtype="int64")
            out = seen.copy()
            out[n:] -= seen[:-n]
            return out

        counted = lambda n, x: once("count", count, n, x)
        summed = lambda n, x: once("sum", lambda n, x: running(inputs[x][1], n, np.add, 0.0), n, x)

        def products(n, y, x):
            """Sums of products of deviations from the frames' means."""
            (has, a), (_, b), k = inputs[y], inputs[x], counted(n, x)
            ma, mb = summed(n, y) / np.maximum(k, 1), summed(n, x) / np.maximum(k, 1)
            out = np.zeros(len(a))
            for i, j in spans(len(a), n):
                d = frames(a, n, i, j) - ma[i:j, None]
                if (k[i:j] < n).any():
                    d *= frames(has, n, i, j)
                out[i:j] = np.einsum("ij,ij->i", d, d if x == y else frames(b, n, i, j) - mb[i:j, None])
            alike = [constant(has, v, k) for v in ((a,) if x == y else (a, b))]
            return np.where(np.logical_or.reduce(alike), 0.0, out) / np.maximum(k - 1, 1)

        out = {}
        with np.errstate(all="ignore"):
            for name, (fn, n, xs, need) in parts.items():
                k = counted(n, xs[0])
                enough = k >= max(need, 1)
                if fn == "count":
                    out[name] = np.ones(len(k), bool), k
                elif fn in ("sum", "avg"):
                    out[name] = enough, summed(n, xs[0]) / (np.maximum(k, 1) if fn == "avg" else 1)
                elif fn in ("max", "min"):
                    empty = -np.inf if fn == "max" else np.inf
                    x = np.where(*inputs[xs[0]], empty)
                    out[name] = enough, running(x, n, np.maximum if fn == "max" else np.minimum, empty)
                else:
                    var = once("products", products, n, xs[0], xs[-1])
                    out[name] = enough & (k > 1), np.sqrt(var) if fn == "stddev_samp" else var
        return out

    return rolled


def pct_change(x, w: WindowSpec, k: int = 1) -> Column:
    c = col(x)
    return c / nz(F.lag(c, k).over(w)) - 1.0


def ffill(x, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def safe_corr(y, x, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation that is null, not an error, for a constant input."""
    y, x = col(y), col(x)
    both = y.isNotNull() & x.isNotNull()
    parts = [F.covar_samp(y, x), F.stddev_samp(F.when(both, y)), F.stddev_samp(F.when(both, x))]
    if frame is not None:
        parts = [p.over(frame) for p in parts]
    return parts[0] / nz(parts[1] * parts[2])


def skew_adjusted(x) -> Column:
    """Sample-adjusted skewness; Spark's own is the population form."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def tidy(x, digits: int = 6) -> Column:
    """Fixed-point rounding by plain IEEE steps, without negative zero."""
    p = float(10**digits)
    return F.floor(col(x) * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p) + F.lit(0.0)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form of a result: rounded doubles, ISO dates, 64-bit integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = tidy(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
