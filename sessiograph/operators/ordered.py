"""Ordered computations over series of any length.

``Window.partitionBy(series)`` puts a whole series into one task, which fails when one series
holds a third of the data. Everything here cuts a series into chunks by a value every row carries
(a frame number, a time), so a chunk is bounded and the cut is the same on every attempt:

* ``running``  prefix sums, minima, maxima, last values: a window inside the chunk plus the carry of
  the chunks before it (one small row per chunk);
* ``over_neighbours``  windows of a few rows before and after: each chunk also receives the edge rows
  of its neighbours, so no carry is needed;
* ``runs``  gaps and islands from the two above.

Keys must not be null; the order columns must be a total order within the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK_ROWS = 65_536
_C = "_chunk"


def chunk_of(index: str, size: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense row number."""
    return F.floor(F.col(index) / F.lit(size)).cast("long")


def ten_minutes(ts: str) -> Column:
    """Chunk number of a wall-clock time, without going through the session time zone."""
    day = F.unix_date(F.to_date(F.col(ts)))
    return (day * 144 + F.hour(ts) * 6 + F.floor(F.minute(ts) / 10)).cast("long")


def _window(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, _C).orderBy(*order)


_LOCAL = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
          "last": lambda c: F.last(c, ignorenulls=True)}
_LOCAL["last_before"] = _LOCAL["last"]
_MERGE = {
    "sum": lambda carry, here: F.when(carry.isNull() & here.isNull(), F.lit(None)).otherwise(
        F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "count": lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
    "min": lambda carry, here: F.least(carry, here),
    "max": lambda carry, here: F.greatest(carry, here),
    "last": lambda carry, here: F.coalesce(here, carry),
    "last_before": lambda carry, here: F.coalesce(here, carry),
}


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None,
            outs: dict[str, tuple[str, Column]], *, keep_chunk: bool = False) -> DataFrame:
    """Add inclusive prefix aggregates: ``outs[name] = (sum|min|max|count|last|last_before, column)``.

    ``last`` is the last non-null value up to the row, ``last_before`` the same without the row itself.
   

    ``chunk`` must not decrease along ``order``; None means ``_chunk`` is already there.
    """
    if chunk is not None:
        df = df.withColumn(_C, chunk)
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[_LOCAL[f](c).over(earlier if f == "last_before" else w).alias(f"_here_{n}") for n, (f, c) in outs.items()])

    def total(f: str, c: Column) -> Column:
        if f in ("last", "last_before"):
            position = F.struct(*[F.col(o) for o in order])
            return F.max_by(c, F.when(c.isNotNull(), position))
        return _LOCAL[f](c)

    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, _C).agg(*[total(f, c).alias(f"_all_{n}") for n, (f, c) in outs.items()])

    def carry(f: str, n: str) -> Column:
        merged = F.sum if f == "count" else _LOCAL[f]
        return merged(F.col(f"_all_{n}")).over(before).alias(f"_carry_{n}")

    carried = totals.select(*keys, _C, *[carry(f, n) for n, (f, _) in outs.items()])
    out = local.join(carried, [*keys, _C]).select(
        *[F.col(c) for c in df.columns if c != _C], F.col(_C),
        *[_MERGE[f](F.col(f"_carry_{n}"), F.col(f"_here_{n}")).alias(n) for n, (f, _) in outs.items()])
    return out if keep_chunk else out.drop(_C)


def running_low(df: DataFrame, keys: list[str], order: list[str], chunk: Column, step: Column, total: str, low: str) -> DataFrame:
    """Running sum of ``step`` and the lowest running sum so far, in one scan: chunks carry their sum and their lowest prefix."""
    w = Window.partitionBy(*keys, _C).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(_C, chunk).withColumn("_s", F.sum(step).over(w)).withColumn("_m", F.min("_s").over(w))
    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy(*keys, _C).agg(F.max_by("_s", F.struct(*order)).alias("_all"), F.min("_s").alias("_low"))
    shifted = ends.withColumn("_by", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    carried = shifted.select(*keys, _C, "_by", F.min(F.col("_by") + F.col("_low")).over(before).alias("_floor"))
    return local.join(carried, [*keys, _C]).select(
        *[c for c in df.columns], (F.col("_s") + F.col("_by")).alias(total), F.least("_floor", F.col("_m") + F.col("_by")).alias(low))


def dense_index(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str, start: int = 0) -> DataFrame:
    """Number the rows of each key from ``start`` in the given order."""
    out = running(df, keys, order, chunk, {name: ("count", F.lit(1))})
    return out.withColumn(name, (F.col(name) - 1 + start).cast("long"))


def over_neighbours(df: DataFrame, keys: list[str], index: str, exprs: Callable[[WindowSpec], dict[str, Column]],
                    before: int = 1, after: int = 1, size: int = CHUNK_ROWS, *, keep_chunk: bool = False) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``index`` numbers the rows of a key without gaps; rows near a chunk edge are also sent to the
    neighbouring chunk and dropped again after the window.
    """
    if max(before, after) >= size:
        raise ValueError("the neighbourhood must be smaller than a chunk")
    own, at = chunk_of(index, size), F.col(index) % F.lit(size)
    nothing = F.lit(None).cast("long")
    copies = F.array_compact(F.array(own, F.when(at < after, own - 1).otherwise(nothing),
                                     F.when(at >= size - before, own + 1).otherwise(nothing)))
    spread = df.withColumn(_C, F.explode(copies))
    added = exprs(_window(keys, [index]))
    out = spread.select("*", *[c.alias(n) for n, c in added.items()]).where(F.col(_C) == own)
    return out if keep_chunk else out.drop(_C)


def runs(df: DataFrame, keys: list[str], index: str, value: str, name: str = "run", size: int = CHUNK_ROWS,
         *, keep_chunk: bool = False) -> DataFrame:
    """Number the stretches of equal ``value`` of each key from 1."""
    marked = over_neighbours(
        df, keys, index,
        lambda w: {"_new": (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col(index) == F.lit(0)))},
        before=1, after=0, size=size, keep_chunk=True)
    return running(marked, keys, [index], None, {name: ("sum", F.col("_new").cast("long"))}, keep_chunk=keep_chunk).drop("_new")


def run_table(df: DataFrame, keys: list[str], index: str, value: str, aggs: list[Column] | None = None,
              size: int = CHUNK_ROWS) -> DataFrame:
    """One row per stretch: run number, value, first and last index, length and any extra aggregates."""
    numbered = runs(df, keys, index, value, "run", size)
    return numbered.groupBy(*keys, "run").agg(
        F.first(value).alias(value), F.min(index).alias("first_idx"), F.max(index).alias("last_idx"),
        F.count(F.lit(1)).alias("length"), *(aggs or []))


def previous(df: DataFrame, keys: list[str], order: list[str], chunk: Column, outs: dict[str, Column]) -> DataFrame:
    """Values of the row before, in an order without dense numbers; null on the first row of a key."""
    df = df.withColumn(_C, chunk)
    here = F.struct(*[c.alias(n) for n, c in outs.items()])
    local = df.withColumn("_prev", F.lag(here).over(_window(keys, order)))
    ends = df.groupBy(*keys, _C).agg(F.max_by(here, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, _C, F.lag("_end").over(Window.partitionBy(*keys).orderBy(_C)).alias("_carry"))
    joined = local.join(carried, [*keys, _C])
    return joined.select(*[c for c in df.columns if c != _C],
                         *[F.coalesce(F.col("_prev"), F.col("_carry"))[n].alias(n) for n in outs])


def attach(df: DataFrame, stats: DataFrame, keys: list[str], index: str, top: str = "_top", size: int = CHUNK_ROWS) -> DataFrame:
    """Join per-series values to the rows of the series, chunk by chunk.

    A plain join on the series sends a long series to one task. Here the row of a series is copied once
    per chunk the series has (once for ordinary ones), ``top`` being its highest index, and the join key
    is (series, chunk): the partitioning the scans of this module already produce.
    """
    copies = stats.withColumn(_C, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(top) / F.lit(size)).cast("long")))).drop(top)
    rows = df if _C in df.columns else df.withColumn(_C, chunk_of(index, size))
    return rows.join(copies, [*keys, _C]).drop(_C)


def moments(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column], spread: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``n``), the mean of each value and the population deviation of those in ``spread`` (``<name>_std``) per key.

    Values are added in the given order, so the last bit does not hang on how rows were dealt; a verdict at exactly a limit
    needs that. A list holds the rows of one chunk; the sums of the chunks of a key are added in their order. Nulls are skipped.
    """
    zero = F.struct(*[F.lit(0.0).alias(f) for f in ("n", "s", "m", "q")])

    def add(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1, x - a["m"]
        m = a["m"] + d / n
        return F.when(x.isNull(), a).otherwise(F.struct(n.alias("n"), (a["s"] + x).alias("s"), m.alias("m"), (a["q"] + (x - m) * d).alias("q")))

    def merge(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["m"] - a["m"]
        both = F.struct(n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["m"] + d * b["n"] / n).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * b["n"] / n).alias("q"))
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    def fold(rows: str, step: Callable[[Column, Column], Column], field: str) -> Column:
        return F.aggregate(rows, zero, lambda a, r: step(a, r[field]))

    rows = df.select(*keys, chunk.alias(_C), F.struct(*order, *[c.cast("double").alias(f"_v_{v}") for v, c in values.items()]).alias("_r"))
    local = rows.groupBy(*keys, _C).agg(F.array_sort(F.collect_list("_r")).alias("_l"))
    local = local.select(*keys, F.struct(F.col(_C), F.size("_l").cast("long").alias("_n"), *[
        fold("_l", add, f"_v_{v}").alias(v) for v in values]).alias("_c"))
    parts = local.groupBy(*keys).agg(F.sum("_c._n").alias("n"), F.array_sort(F.collect_list("_c")).alias("_p"))
    total = parts.select(*keys, "n", *[fold("_p", merge, v).alias(v) for v in values])
    return total.select(*keys, "n", *[F.try_divide(F.col(v)["s"], F.col(v)["n"]).alias(v) for v in values],
                        *[F.sqrt(F.try_divide(F.col(v)["q"], F.col(v)["n"])).alias(f"{v}_std") for v in spread])


def with_scalars(df: DataFrame, row: DataFrame, prefix: str = "") -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery instead of a join."""
    packed = row.select(F.struct(*row.columns)).scalar()
    out = df.withColumn("_scalars", packed)
    return out.withColumns({f"{prefix}{c}": F.col("_scalars")[c] for c in row.columns}).drop("_scalars")
