"""Timelines, artifact reports, nested result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import ordered


def chunk_summary(chunks: DataFrame, session: str, chunk: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Mean probability of the chunks, added in their order, share of positive ones, verdict."""
    s = ordered.moments(chunks, [session], [chunk], ordered.chunk_of(chunk, 4096), {
        "probability": F.col(p), "positive_ratio": (F.col(p) >= 0.5).cast("double")}).withColumnRenamed("n", "chunks_used")
    s = s.withColumn("prediction", sc.predict("probability", threshold))
    return s.withColumns({"prediction_label": sc.prediction_label("prediction"), "risk_level": sc.risk_level("probability")})


def artifact_report(base: DataFrame, parts: dict[str, DataFrame], key: str, messages: dict[str, str]) -> DataFrame:
    """Which stages left something for each session, and a message for each that did not."""
    out = base
    for name, table in parts.items():
        out = out.join(table.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    missing = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(m)) for n, m in messages.items()]))
    return out.withColumn("messages", F.array_join(missing, "; "))


def metric_lookup(df: DataFrame, json: str, section: str, metric: str) -> DataFrame:
    """mean_<metric>, else <metric>, else the mean over the folds that hold a finite value."""
    folds = F.from_json(F.get_json_object(F.col(json), f"{section}.fold_results"), f"array<struct<{metric}:string>>")
    values = F.filter(F.transform(folds, lambda x: sc.to_number(x[metric])), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    direct = sc.first_finite_json(json, [f"{section}.mean_{metric}", f"{section}.{metric}"])
    return df.withColumn(metric, F.coalesce(direct, mean))


def insights(rules: list[tuple[Column, str]]) -> Column:
    """The messages whose rule holds, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))


def analyze_session(segments: DataFrame, session: str, score: str = "risk_score", threshold: float = 0.5, k: int = 5) -> DataFrame:
    """Session report from scored segments: mean of the k highest scores, level, counts, the k segments.

    The list holds k entries; timelines of any length stay rows (see ``segment_timeline``).
    """
    from .scoring import top_per_session
    ranked = segments.withColumn("_o", F.round(score, 12))
    top = top_per_session(ranked, session, "_o", ["segment_idx"], k).groupBy(session).agg(
        F.avg(score).alias("overall"),
        F.array_sort(F.collect_list(F.struct(
            "rank", "segment_id", "start_time", "end_time", F.concat(sc.format_time("start_time"), F.lit(" - "), sc.format_time("end_time")).alias("time_range"),
            F.col(score).alias("risk_score"), "risk_level", sc.text_preview("text", 200, True).alias("text")))).alias("top_segments"))
    counts = segments.groupBy(session).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("risk_level") == "high").alias("n_high"))
    out = counts.join(top, session)
    return out.withColumns({"risk_level": sc.risk_level("overall", "segment"), "prediction": sc.predict("overall", threshold)})


def pack_json(analysis: DataFrame, session: str) -> DataFrame:
    """One JSON document per session."""
    label = sc.prediction_label("prediction", "RISK", "CONTROL")
    doc = F.struct(
        F.col(session).alias("session_id"), F.struct(F.col("overall").alias("risk_score"), "risk_level", "prediction", label.alias("prediction_label")).alias("overall"),
        "n_segments", F.col("n_high").alias("n_high_risk_segments"), F.col("top_segments").alias("top_risk_segments"))
    return analysis.select(session, F.to_json(doc).alias("report"))


TOP_SCHEMA = "array<struct<rank:int,segment_id:string,start_time:double,end_time:double,time_range:string,risk_score:double,risk_level:string,text:string>>"


def unpack_json(reports: DataFrame, session: str) -> DataFrame:
    """The segments of report documents, one row each."""
    parsed = F.from_json(F.get_json_object("report", "$.top_risk_segments"), TOP_SCHEMA)
    return reports.select(session, F.inline(parsed)).withColumn("rank", F.col("rank").cast("long"))
