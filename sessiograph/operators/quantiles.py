"""Exact interpolated quantiles per group, whatever the size of a group: one plan, no job while it is built.

The values of a group of up to ``SMALL`` rows are one sorted list each, made by the aggregate that also gives the group's other
statistics. Larger groups, known by their keys, are treated apart: equal values are counted first. The wanted ranks are then found by two histograms over the counts: cells of equal ratio
(so outliers and infinities have cells of their own), then cells of equal width inside the cell a rank falls into; the few
values left are numbered. Every step is a grouping with partial sums or a join on (group, cell), so a hot group spreads over
its cells, and a window sees at most the cells of one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group whose values are sorted as one list. An aggregate holds at most 128 such groups before it sorts its input.
SMALL = 16_384
#: Cells per doubling of the value, and cells of equal width inside one of these.
PER_OCTAVE, WITHIN = 512, 1 << 20
#: Cell numbers start here on both sides of 0: more than the octaves of a double below 1.
OFFSET = PER_OCTAVE * 1100


def ratio_cell(v: Column) -> Column:
    """A whole number that does not decrease with ``v``: sign and logarithm; infinities come last."""
    size = F.greatest(F.lit(1), F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + OFFSET)
    top = F.lit(PER_OCTAVE * 1030 + OFFSET)
    return (F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * F.when(F.abs(v) == float("inf"), top).otherwise(size))).cast("long")


def group_quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], probs: dict[str, float], aggs: list[Column] | None = None, small: int = SMALL) -> DataFrame:
    """``keys``, the extra ``aggs`` and one column ``<value>_<prob name>`` per value and quantile; null where a group has no value.

    Null and NaN values are left out. Keys must not be null. At most one group in ``small`` rows is large, so their keys are broadcast.
    """
    clean = {n: F.nanvl(c.cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for n, c in values.items()}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > small)
    large = F.broadcast(sizes.select(*[F.col(k).alias(f"_large_{k}") for k in keys]))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_large_{k}") for k in keys])
    listed = _by_lists(df.join(large, same, "left_anti"), keys, clean, probs, aggs or [])
    return listed.unionByName(_by_histograms(df.join(large, same, "left_semi"), keys, clean, probs, aggs or []))


def _by_lists(df: DataFrame, keys: list[str], clean: dict[str, Column], probs: dict[str, float], aggs: list[Column]) -> DataFrame:
    grouped = df.groupBy(*keys).agg(*aggs, *[F.sort_array(F.collect_list(c)).alias(f"_sorted_{n}") for n, c in clean.items()])

    def quantile(n: str, p: float) -> Column:
        found = F.col(f"_sorted_{n}")
        place = (F.size(found) - 1) * F.lit(float(p))
        low, high = (F.get(found, f(place).cast("int")) for f in (F.floor, F.ceil))
        return _between(low, high, place - F.floor(place))

    return grouped.select(*[c for c in grouped.columns if not c.startswith("_sorted_")], *[quantile(n, p).alias(f"{n}_{s}") for n in clean for s, p in probs.items()])


def _by_histograms(df: DataFrame, keys: list[str], clean: dict[str, Column], probs: dict[str, float], aggs: list[Column]) -> DataFrame:
    k = [*keys, "_name"]
    listed = F.array(*[F.struct(F.lit(n).alias("_name"), c.alias("_v")) for n, c in clean.items()])
    counts = df.select(*keys, F.inline(listed)).where(F.col("_v").isNotNull()).groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # the distinct values are dealt once by (group, cell): the cells, both joins and the windows inside a cell use this order
    counts = counts.withColumn("_cell", ratio_cell(F.col("_v"))).repartition(*k, "_cell")

    cells = counts.groupBy(*k, "_cell").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    total = F.sum("_c").over(Window.partitionBy(*k))
    wanted = F.array_distinct(F.array(*[f((F.col("_n") - 1) * F.lit(float(p))).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]))
    below = F.sum("_c").over(Window.partitionBy(*k).orderBy("_cell")) - F.col("_c")
    inside = F.filter(wanted, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_c")))
    first = cells.withColumns({"_n": total, "_base": below}).select(*k, "_cell", "_n", "_a", "_b", "_base", F.explode(inside).alias("_rank"))

    share = F.floor((F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2) * WITHIN)
    part = F.when(F.col("_b") > F.col("_a"), F.least(F.lit(WITHIN - 1), share)).otherwise(0)
    finer = counts.join(first, [*k, "_cell"]).withColumn("_part", part).groupBy(*k, "_cell", "_rank", "_n", "_base", "_part").agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    second = _reached(finer, [*k, "_cell", "_rank"], "_part").select(*k, "_cell", "_rank", "_n", "_lo", "_hi", F.col("_below").alias("_base"))

    near = counts.join(second, [*k, "_cell"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    found = _reached(near.select(*k, "_cell", "_rank", "_n", "_base", "_v", "_c"), [*k, "_cell", "_rank"], "_v")

    def at(n: str, rank: Column) -> Column:
        return F.max(F.when((F.col("_name") == n) & (F.col("_rank") == rank), F.col("_v")))

    picked = {}
    for n in clean:
        for s, p in probs.items():
            place = (F.col("_n") - 1) * F.lit(float(p))
            picked[f"{n}_{s}"] = (at(n, F.floor(place)), at(n, F.ceil(place)), F.max(F.when(F.col("_name") == n, place - F.floor(place))))
    out = found.groupBy(*keys).agg(*[c.alias(f"_{x}{i}") for x, three in picked.items() for i, c in enumerate(three)])
    out = out.select(*keys, *[_between(F.col(f"_{x}0"), F.col(f"_{x}1"), F.col(f"_{x}2")).alias(x) for x in picked])
    base = df.groupBy(*keys).agg(*(aggs or [F.lit(0).alias("_none")]))
    return base.drop("_none").join(out, keys, "left")


def _reached(hist: DataFrame, group: list[str], by: str) -> DataFrame:
    """Rows of a histogram of one rank each in which the rank lies."""
    below = F.sum("_c").over(Window.partitionBy(*group).orderBy(by)) - F.col("_c") + F.col("_base")
    return hist.withColumn("_below", below).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_c")))


def _between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; equal ends (also infinite ones) and a share of 0 give the lower one."""
    return F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share)
