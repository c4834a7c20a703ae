"""Sorting, limits, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..constants import TERM_STOPWORDS
from .scoring import top_per_session


def order_segments(df: DataFrame, *order: str) -> DataFrame:
    """Global order; Spark range-partitions, so one session may span many tasks."""
    return df.orderBy(*order)


def limit_distinct(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """All rows of the first n ids, ids ordered by their smallest ``order`` value."""
    first = df.groupBy(key).agg(F.min(order).alias("_o")).orderBy("_o", key).limit(n)
    return df.join(F.broadcast(first.select(key)), key, "left_semi")  # n ids


def high_risk_count(df: DataFrame, session: str, level: Column) -> DataFrame:
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(level == "high").alias("n_high"))


def segment_timeline(df: DataFrame, session: str) -> DataFrame:
    """Start, end, score, level and text preview of each segment, in time order."""
    return df.select(session, "segment_idx", "start_time", "end_time", "score", sc.risk_level("score", "segment").alias("level"),
                     sc.text_preview("text", 100).alias("preview")).orderBy(session, "start_time", "segment_idx")


def top_contributions(names: list[str], importance: Column, scaled: Column, k: int = 10) -> Column:
    """The k features with the largest importance x |scaled value|, as an array of structs."""
    contribution = F.zip_with(importance, scaled, lambda i, x: i * F.abs(x))
    tagged = F.transform(contribution, lambda c, i: F.struct((-c).alias("o"), i.alias("i")))
    best = F.slice(F.array_sort(tagged), 1, k)
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(best, lambda s: F.struct(F.get(labels, s["i"]).alias("feature"), (-s["o"]).alias("contribution")))


def feature_influence(df: DataFrame, features: str, k: int = 10) -> DataFrame:
    """Mean contribution and value per feature over all segments, the k strongest."""
    e = df.select(F.explode(features).alias("f"))
    means = e.groupBy(F.col("f.feature").alias("feature")).agg(
        F.avg("f.contribution").alias("contribution"), F.avg("f.value").alias("value_mean"), F.count(F.lit(1)).alias("n"))
    return means.orderBy(F.desc("contribution"), "feature").limit(k)


def importance_rank(df: DataFrame, k: int) -> DataFrame:
    """Mean importance over folds, the k largest."""
    return df.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(k)


def risk_terms(df: DataFrame, text: str, score: str, k: int = 10) -> DataFrame:
    """Words of four letters or more ranked by twice their highest risk plus 0.08 per occurrence."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}']{4,}"), F.lit(0))
    e = df.select(F.explode(words).alias("term"), F.coalesce(sc.finite(score), F.lit(0.0)).alias("_r")).where(~F.col("term").isin(*TERM_STOPWORDS))
    t = e.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.max("_r").alias("max_risk"))
    rank = F.col("max_risk") * 2 + F.col("count") * 0.08
    weight = sc.clamp01(F.col("max_risk") * 0.7 + F.least(F.lit(1.0), F.col("count") / 6) * 0.3)
    return t.withColumns({"weight": weight, "_rank": rank}).orderBy(F.desc("_rank"), "term").limit(k).drop("_rank")


def frame_capture_times(points: DataFrame, session: str, x: str, y: str, order: list[str], duration: Column, k: int = 4) -> DataFrame:
    """Times of the k highest points, clamped to the recording, unique at two decimals."""
    top = top_per_session(points.withColumn("_d", duration), session, y, order, k)
    at = F.greatest(F.lit(0.0), F.least(F.col("_d"), F.col(x)))
    return top.groupBy(session, F.round(at, 2).alias("time")).agg(F.min("rank").alias("rank"))


def checked_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append rows only if names, order and types agree."""
    if a.dtypes != b.dtypes:
        raise ValueError(f"schemas differ: {sorted(set(a.dtypes) ^ set(b.dtypes))}")
    return a.union(b)


def union_append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def first_by_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key, the first in the order; an aggregate, so copies are reduced on the map side."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*named).agg(best.alias("_b")).select("_b.*")


def dedup_segments(df: DataFrame, order: list[str]) -> DataFrame:
    """First of the segments with the same id, start, end and text. Null counts as empty."""
    def key(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return first_by_key(df, [key("segment_id"), key("start_time"), key("end_time"), key("text")], order)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
