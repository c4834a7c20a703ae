"""Evaluation of scores against labels, per model or fold.

Rows are first counted per distinct score, then scanned in score order chunk by chunk, so no window ever
holds all predictions of a model. ``keys`` may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

CELLS = 4096


def counts_by_score(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    one = (F.col(y) == 1).cast("long")
    return df.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))


def _curve(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """True and false positives when everything from a score upwards counts as positive."""
    c = counts_by_score(df, keys, y, p).withColumn("_d", -F.col("score"))
    cell = -F.floor(F.col("score") * CELLS).cast("long")
    run = ordered.running(c, keys, ["_d"], cell, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}).drop("_d")
    totals = c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return run.join(totals, keys) if keys else ordered.with_scalars(run, totals)


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; null with one class."""
    c = _curve(df, keys, y, p)
    right = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    return c.groupBy(*keys).agg(F.try_divide(right, F.max(F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"))


def pr_curve(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    c = _curve(df, keys, y, p)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("n_pos"))
    return c.select(*keys, F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), "pos", "n_pos")


def average_precision(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return pr_curve(df, keys, y, p).groupBy(*keys).agg(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("n_pos")) * F.col("precision")).alias("average_precision"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def best_f1_threshold(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Threshold of the largest F1 on the curve, the lowest one on ties."""
    c = pr_curve(df, keys, y, p).withColumn("f1", F.round(f1(F.col("precision"), F.col("recall")), 12))
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def grid_counts(df: DataFrame, keys: list[str], grid: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """tp, fp, tn, fn for each threshold of a fixed grid.

    Each row is counted under the number of thresholds it reaches, so the predictions are read once and
    at most len(grid) + 1 rows per key remain; the sums per threshold run over those.
    """
    reached = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: F.col(p) >= g))
    one = (F.col(y) == 1).cast("long")
    c = df.groupBy(*keys, reached.alias("_k")).agg(F.sum(one).alias("_p"), F.sum(1 - one).alias("_n"))
    cells = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("_p", "_n")))).alias("_m"))  # one entry per threshold

    def total(field: str, keep) -> Column:
        vals = F.transform(F.filter(F.map_entries("_m"), keep), lambda e: e["value"][field])
        return F.aggregate(vals, F.lit(0).cast("long"), lambda a, v: a + v)
    t = cells.select("*", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("_j", "threshold"))
    above, below = (lambda e: e["key"] > F.col("_j")), (lambda e: e["key"] <= F.col("_j"))
    return t.select(*keys, "threshold", total("_p", above).alias("tp"), total("_n", above).alias("fp"), total("_n", below).alias("tn"), total("_p", below).alias("fn"))


def _best(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    rounded = df.withColumn("_r", F.round(name, 12))
    return rounded.groupBy(*keys).agg(F.max_by(F.struct("threshold", name), F.struct(F.col("_r"), -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def grid_f1(df: DataFrame, keys: list[str], grid: list[float], **cols) -> DataFrame:
    """First threshold of the grid with the largest F1."""
    c = grid_counts(df, keys, grid, **cols)
    return _best(c.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)), keys, "f1")


def grid_balanced_accuracy(df: DataFrame, keys: list[str], grid: list[float], **cols) -> DataFrame:
    c = grid_counts(df, keys, grid, **cols)
    def rate(hit: str, miss: str) -> Column:
        return F.when(F.col(hit) + F.col(miss) > 0, F.col(hit) / (F.col(hit) + F.col(miss)).cast("double")).otherwise(0.0)
    return _best(c.withColumn("balanced_accuracy", (rate("tp", "fn") + rate("tn", "fp")) / 2), keys, "balanced_accuracy")


def confusion_matrix(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_summary(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes, macro and weighted means, accuracy; 0 where undefined."""
    m = confusion_matrix(df, keys, y, pred)
    def n(a: int, b: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("n"))), F.lit(0)).cast("double")
    wide = m.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))

    def div(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    f_1, f_0, s1, s0 = f1(p1, r1), f1(p0, r0), tp + fn, tn + fp
    total = s1 + s0
    acc = div(tp + tn, total)
    rows = F.array(row("0", p0, r0, f_0, s0), row("1", p1, r1, f_1, s1), row("macro", (p0 + p1) / 2, (r0 + r1) / 2, (f_0 + f_1) / 2, total),
                   row("weighted", div(p0 * s0 + p1 * s1, total), div(r0 * s0 + r1 * s1, total), div(f_0 * s0 + f_1 * s1, total), total),
                   row("accuracy", acc, acc, acc, total))
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def log_loss(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", eps: float = 1e-15) -> DataFrame:
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return df.groupBy(*keys).agg(F.avg(-F.ln(F.when(F.col(y) == 1, clipped).otherwise(1 - clipped))).alias("log_loss"))


def fold_means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of per-fold metrics, long form."""
    long = df.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
