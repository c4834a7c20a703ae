"""Deterministic, group-safe splits. All of them depend on the md5 of the group only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def group_hash(key: str | Column) -> Column:
    """The first 32 bits of the md5 of the key."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def fold_count(n: Column, most: int = 10) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(most), F.floor(n / 8))).cast("int")


def group_kfold(df: DataFrame, group: str, k: int | None = None, name: str = "fold") -> DataFrame:
    """Fold of each row by its group; a projection, no shuffle. Without k the number of groups decides it."""
    if k is not None:
        return df.withColumn(name, F.pmod(group_hash(group), F.lit(k)).cast("int"))
    n = df.agg(F.count_distinct(group).alias("_g"))
    return ordered.with_scalars(df, n).withColumn(name, F.pmod(group_hash(group), fold_count(F.col("_g"))).cast("int")).drop("_g")


def majority_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(F.bround(F.avg(label)).cast("int").alias("group_label"))


def _ranked_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups numbered within their label in md5 order, by 4096 ranges of the hash."""
    g = majority_labels(df, group, label).withColumn("_h", F.md5(F.col(group).cast("string")))
    cell = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    return ordered.dense_index(g, ["group_label"], ["_h", group], cell, "_r").drop("_h")


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int, name: str = "fold") -> DataFrame:
    folds = _ranked_groups(df, group, label).select(group, F.pmod(F.col("_r"), F.lit(k)).cast("int").alias(name))
    return df.join(folds, group)


def group_train_test(df: DataFrame, group: str, label: str, one_in: int = 5) -> DataFrame:
    """Every fifth group of a label is held out with all its rows."""
    side = _ranked_groups(df, group, label).select(group, F.when(F.col("_r") % one_in == 0, "test").otherwise("train").alias("split"))
    return df.join(side, group)
