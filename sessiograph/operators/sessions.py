"""Segments to sessions: statistics, texts, counts, checks.

Every group here may be of any size: averages, deviations, extremes and counts combine on the map side,
medians go through ``group_quantiles``, texts are joined part by part before the parts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from .quantiles import group_quantiles

PART_SEGMENTS = 4096


def first_by(value: str, *order: str) -> Column:
    """Value of the first row in an explicit order."""
    return F.min_by(value, F.struct(*order))


def session_stats(df: DataFrame, keys: list[str], features: list[str], prefix: str, *, population: bool, zero_empty: bool,
                  aggs: list[Column] | None = None) -> DataFrame:
    """Mean, deviation, median, minimum and maximum of every feature; NaN values are skipped.

    ``population`` uses the population deviation with 0 for a single row, otherwise the sample one with
    null. ``zero_empty`` turns the statistics of a feature without values into 0.
    """
    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0)) if zero_empty else c

    parts: list[Column] = list(aggs or [])
    for f in features:
        x = sc.skip_nan(f)
        std = F.stddev_pop(x) if population else F.stddev_samp(x)
        parts += [empty(c).alias(f"{prefix}{f}_{n}") for n, c in
                  (("mean", F.avg(x)), ("std", std), ("min", F.min(x)), ("max", F.max(x)))]
    out = group_quantiles(df, keys, {f: F.col(f) for f in features}, {"median": 0.5}, parts)
    names = [c for c in out.columns if not c.endswith("_median")]
    return out.select(*names, *[empty(F.col(f"{f}_median")).alias(f"{prefix}{f}_median") for f in features])


def session_text(df: DataFrame, session: str, index: str, text: str = "text", part_segments: int = PART_SEGMENTS) -> DataFrame:
    """Non-blank segment texts joined in order, one row per session.

    Parts of ``part_segments`` segments are joined first, so no task sorts a whole long session's segments; the text of a
    session itself is one value, which Spark limits to 2 GB.
    """
    clean = df.select(session, index, tx.strip_blanks(text).alias("_t")).where(F.col("_t") != "")
    part = F.floor(F.col(index) / part_segments).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index), F.col("_t"))))
    parts = clean.groupBy(session, part.alias("_part")).agg(F.array_join(F.transform(ordered, lambda s: s["_t"]), " ").alias("_t"))
    whole = F.array_sort(F.collect_list(F.struct("_part", "_t")))
    return parts.groupBy(session).agg(F.array_join(F.transform(whole, lambda s: s["_t"]), " ").alias("full_text"))


def class_balance(df: DataFrame, session: str, label: str, minimum: int = 10) -> DataFrame:
    """Rows and sessions per label. Sessions are counted once each before the labels are grouped."""
    per = df.groupBy(session, label).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(label).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("sessions"))
    return out.withColumn("too_few", F.col("sessions") < minimum)


def merge_modalities(audio: DataFrame, text: DataFrame, session: str) -> DataFrame:
    """Inner join of the two session tables; a label that differs stops the query."""
    joined = audio.join(text.withColumnRenamed("label", "_text_label"), session)
    ok = F.assert_true(F.col("label") == F.col("_text_label"), F.concat(F.lit("label mismatch in session "), F.col(session).cast("string")))
    return joined.withColumn("label", F.coalesce(ok.cast("int"), F.col("label"))).drop("_text_label")


def overlap_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many sessions are on one side, on both, and the share of the larger side that is common."""
    both = (a.select(key).distinct().withColumn("_a", F.lit(1))
            .join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer"))
    n = both.agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))
    share = F.col("common") * 100.0 / F.greatest("a", "b")
    return n.select((F.col("a") - F.col("common")).alias("only_first"), (F.col("b") - F.col("common")).alias("only_second"), "common",
                    share.alias("overlap_pct"), (share < 50).alias("low_overlap"))


def null_counts(df: DataFrame, top: int = 5) -> DataFrame:
    """The columns with most nulls, one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], counts.columns, "column_name", "nulls")
    return long.where(F.col("nulls") > 0).orderBy(F.desc("nulls"), "column_name").limit(top)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def validate_dataset(df: DataFrame, min_sessions: int = 30, min_class: int = 10) -> DataFrame:
    """One row of checks over a session table."""
    per = df.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"),
        F.count_if(F.coalesce("full_text", F.lit("")) == "").alias("_e"),
        F.count_if(F.col("label") == 0).alias("_zero"), F.count_if(F.col("label") == 1).alias("_one"))
    row = per.agg(F.sum("_n").alias("sessions"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_e").alias("empty_texts"),
                  F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_zero").alias("controls"), F.sum("_one").alias("risks"))
    labels = (F.col("_lo") == 0) & (F.col("_hi") == 1) & (F.col("controls") + F.col("risks") == F.col("sessions"))
    return row.select("sessions", "duplicates", "empty_texts", "controls", "risks", labels.alias("labels_valid"),
                      (F.col("sessions") >= min_sessions).alias("enough_sessions"),
                      (F.least("controls", "risks") >= min_class).alias("enough_per_class"),
                      ((F.col("duplicates") == 0) & labels).alias("passed"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both exist; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def feature_quality(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Per feature: correlation with the label, spread, zeros, NaN/inf, and the shift between labels. One pass."""
    aggs: list[Column] = []
    for f in features:
        x = sc.finite(f)
        aggs += [F.struct(
            F.lit(f).alias("feature"), correlation(x, F.col(label).cast("double")).alias("r"), F.stddev_samp(x).alias("std"),
            F.max(F.abs(x)).alias("max_abs"), F.count_if(~F.col(f).isNull() & x.isNull()).alias("not_finite"),
            *[fn(F.when(F.col(label) == v, x)).alias(f"{n}_{v}") for v in (0, 1) for n, fn in (("mean", F.avg), ("std", F.stddev_samp))],
        ).alias(f"_{i}") for i in [features.index(f)]]
    rows = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(features))])).alias("s")).select("s.*")
    return rows.select(
        "*", (F.abs("r") > 0.5).alias("strong"), (F.col("std") < 1e-10).alias("constant"), (F.col("max_abs") == 0).alias("all_zero"),
        (F.abs(F.col("mean_1") - F.col("mean_0")) > 2 * (F.col("std_0") + F.col("std_1")) / 2).alias("shifted"))
