"""Rule scores, session scores and fusion of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..constants import AUDIO_ANOMALY as A
from ..constants import DECEPTION as D
from ..constants import EMOTION, NEGATIVE_EMOTIONS, SESSION_THRESHOLD, VIDEO_ANOMALY, VIDEO_RULES
from ..constants import TEXT_ANOMALY as T
from ..functions import scalars as sc
from ..functions import text as tx
from . import ordered
from .quantiles import group_quantiles


def verdict(df: DataFrame, score: str, threshold: float, positive: str = "experimental", negative: str = "control") -> DataFrame:
    """Add prediction, its label and the risk level of a score column."""
    out = df.withColumn("prediction", sc.predict(score, threshold))
    return out.withColumns({"prediction_label": sc.prediction_label("prediction", positive, negative), "risk_level": sc.risk_level(score)})


def deception_score(used: DataFrame, session: str, order: str) -> DataFrame:
    """From scored segments, already restricted to the wanted durations; added in segment order."""
    s = ordered.moments(used, [session], [order], ordered.chunk_of(order, 4096), {
        "mean": F.col("score"), "high_ratio": (F.col("score") >= D["high_from"]).cast("double")}, ("mean",))
    s = s.withColumnsRenamed({"n": "segments_used", "mean_std": "std"})
    s = s.withColumn("deception_score", sc.clamp01(sum(F.col(c) * D[c] for c in ("mean", "std", "high_ratio"))))
    return verdict(s, "deception_score", D["threshold"])


def text_anomaly_score(df: DataFrame, session: str, text: str = "text") -> DataFrame:
    """Repetition, shortness and punctuation of all text of a session.

    Words are counted per (session, word) first, so a session of any length is spread over tasks and the
    joined text is never built: its length is the sum of the parts and the blanks between them.
    """
    clean = df.select(session, tx.strip_blanks(text).alias("_t")).where(F.col("_t") != "")
    words = clean.select(session, F.explode(tx.word_tokens("_t")).alias("_w")).groupBy(session, "_w").agg(F.count(F.lit(1)).alias("_c"))
    counted = words.groupBy(session).agg(F.sum("_c").alias("word_count"), F.count(F.lit(1)).alias("unique_words"))
    marks = clean.groupBy(session).agg(
        F.sum(tx.marks("_t", "[!?.,;:]")).alias("_p"), (F.sum(F.length("_t")) + F.count(F.lit(1)) - 1).alias("_len"))
    s = df.select(session).distinct().join(marks, session, "left").join(counted, session, "left")
    s = s.fillna(0, ["word_count", "unique_words", "_p", "_len"])
    s = s.withColumns({
        "lexical_diversity": sc.safe_div(F.col("unique_words").cast("double"), F.col("word_count").cast("double")),
        "punctuation_ratio": F.col("_p") / F.greatest(F.lit(1), F.col("_len"))})
    s = s.withColumn("repetition_ratio", F.lit(1.0) - F.col("lexical_diversity"))
    score = sc.clamp01(T["repetition"] * F.col("repetition_ratio") + F.when(F.col("word_count") < T["short_below"], T["short"]).otherwise(0.0)
                       + T["punctuation"] * F.least(F.lit(1.0), F.col("punctuation_ratio") * T["punctuation_scale"]))
    return verdict(s.withColumn("anomaly_score", score), "anomaly_score", T["threshold"], "anomaly", "normal").drop("_p", "_len")


def audio_anomaly_score(df: DataFrame, session: str, index: str, chunk: Column, jump: float = A["jump_above"]) -> DataFrame:
    """Spread of scores and durations, jumps between neighbours and shortness of a session."""
    scored = df.where(F.col("score").isNotNull()).select(session, index, "score", "duration")
    stepped = ordered.previous(scored, [session], [index], chunk, {"_before": F.col("score")})
    s = stepped.groupBy(session).agg(
        F.count(F.lit(1)).alias("segments_used"), F.stddev_pop("score").alias("score_std"),
        (F.stddev_pop("duration") / F.greatest(F.lit(1e-6), F.avg("duration"))).alias("duration_cv"),
        F.coalesce(F.avg((F.abs(F.col("score") - F.col("_before")) > jump).cast("double")), F.lit(0.0)).alias("jump_ratio"))
    score = sc.clamp01(A["std"] * F.col("score_std") + A["duration_cv"] * F.least(F.lit(1.0), F.col("duration_cv")) + A["jumps"] * F.col("jump_ratio")
                       + F.when(F.col("segments_used") < A["few_below"], A["few"]).otherwise(0.0))
    return verdict(s.withColumn("anomaly_score", score), "anomaly_score", A["threshold"], "anomaly", "normal")


def video_anomaly_indicators(frames: DataFrame, session: str) -> DataFrame:
    """Five 0/1 indicators and their mean; an absent column gives 0."""
    have = set(frames.columns)

    def rule(column: str, kind: str, limit: float) -> Column:
        if column not in have:
            return F.lit(0.0)
        x = F.coalesce(sc.skip_nan(column), F.lit(0.0))
        hit = F.max(x) > limit if kind == "max" else F.avg(x) < limit
        return hit.cast("double")

    if not have & {c for c, _, _ in VIDEO_RULES.values()}:
        out = frames.select(session).distinct().withColumns({n: F.lit(0.0) for n in VIDEO_RULES})
    else:
        out = frames.groupBy(session).agg(*[rule(*r).alias(n) for n, r in VIDEO_RULES.items()])
    total = sum((F.col(n) for n in VIDEO_RULES), F.lit(0.0))
    return out.withColumn("rule_score", total / len(VIDEO_RULES))


def video_anomaly_score(sessions: DataFrame, indicators: DataFrame, session: str, model_prob: str = "model_prob") -> DataFrame:
    """0.7 of the rules and 0.3 of the model; a session without frames scores 1."""
    s = sessions.join(indicators, session, "left")
    mixed = sc.clamp01(VIDEO_ANOMALY["rules"] * F.col("rule_score") + VIDEO_ANOMALY["model"] * F.coalesce(F.col(model_prob), F.lit(0.0)))
    s = s.withColumn("anomaly_score", F.when(F.col("rule_score").isNull(), 1.0).otherwise(mixed))
    return verdict(s, "anomaly_score", VIDEO_ANOMALY["threshold"], "anomaly", "normal")


def emotion_distribution(frames: DataFrame, session: str, emotion: str) -> DataFrame:
    """Share of each known emotion as a map, the most frequent one and the share of negative ones.

    Counting happens per (session, emotion); the list per session is as long as the set of emotions.
    """
    e = F.lower(F.trim(F.coalesce(emotion, F.lit("unknown"))))
    counts = frames.select(session, e.alias("_e")).where(F.col("_e") != "unknown").groupBy(session, "_e").agg(F.count(F.lit(1)).alias("_c"))
    s = counts.groupBy(session).agg(
        F.sum("_c").alias("n"), F.min_by("_e", F.struct(-F.col("_c"), F.col("_e"))).alias("dominant"),
        F.sum(F.when(F.col("_e").isin(*NEGATIVE_EMOTIONS), F.col("_c")).otherwise(0)).alias("_neg"),
        F.array_sort(F.collect_list(F.struct("_e", "_c"))).alias("_l"))
    share = F.map_from_entries(F.transform("_l", lambda x: F.struct(x["_e"], x["_c"] / F.col("n"))))
    return s.select(session, "n", "dominant", (F.col("_neg") / F.col("n")).alias("negative_ratio"), share.alias("distribution"))


def emotion_score(negative_ratio: Column, model_prob: Column) -> Column:
    return sc.clamp01(EMOTION["negative"] * F.coalesce(negative_ratio, F.lit(0.0)) + EMOTION["model"] * F.coalesce(model_prob, F.lit(0.0)))


def session_scores(df: DataFrame, session: str, order: list[str]) -> DataFrame:
    """All ways to turn segment scores into one session score.

    The top five come from a ranked window Spark limits before the shuffle, the rest from one aggregate.
    """
    weight = F.coalesce(F.col("duration"), F.lit(1.0))
    base = group_quantiles(df, [session], {"score": F.col("score")}, {"p90": 0.9}, [
        F.count(F.lit(1)).alias("n_segments"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
        F.min("score").alias("score_min"), F.stddev_pop("score").alias("score_std"),
        (F.sum(F.col("score") * weight) / F.sum(weight)).alias("score_weighted")])
    top = top_per_session(df, session, "score", order, 5).groupBy(session).agg(F.avg("score").alias("score_mean_top5"))
    return base.join(top, session)


def top_per_session(df: DataFrame, session: str, score: str, order: list[str], k: int, name: str = "rank") -> DataFrame:
    """The k highest rows of each session; the row_number filter lets Spark cut each partition first."""
    w = Window.partitionBy(session).orderBy(F.desc(score), *order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def ensemble(results: DataFrame, session: str) -> DataFrame:
    """Fuse the models that answered: mean score, or the only score with its own verdict and bands.

    The scores are added by model name, and a mean is judged to twelve places, so no verdict hangs on the order in which a shuffle delivers the models.
    """
    ok = results.where(F.col("success") & sc.finite("score").isNotNull())
    s = ok.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_models"), F.count_distinct("prediction").alias("_kinds"),
        F.max("prediction").alias("_only"), F.min("model").alias("_name"),
        F.array_sort(F.collect_list(F.struct("model", F.col("score").cast("double").alias("score")))).alias("_l"))
    s = s.withColumn("ensemble_score", F.aggregate("_l", F.lit(0.0), lambda a, x: a + x["score"]) / F.col("n_models"))
    one, judged = F.col("n_models") == 1, F.round("ensemble_score", 12)
    return s.select(
        session, "n_models", "ensemble_score", F.when(one, F.col("_only")).otherwise(sc.predict(judged, 0.5)).alias("prediction"),
        (F.col("_kinds") == 1).alias("agreement"),
        F.when(one, sc.risk_level("ensemble_score", "session")).otherwise(sc.risk_level(judged)).alias("risk_level"),
        F.when(one, F.col("_name")).otherwise("ensemble").alias("source"), F.map_from_entries("_l").alias("individual_scores"))


def ensemble_with_fallback(sessions: DataFrame, results: DataFrame, session: str) -> DataFrame:
    """Every session gets a row; without any answer the score is null and the source is none."""
    out = sessions.join(ensemble(results, session), session, "left")
    return out.withColumns({"n_models": F.coalesce("n_models", F.lit(0)), "source": F.coalesce("source", F.lit("none")),
                            "success": F.col("ensemble_score").isNotNull()})


def contribution_share(results: DataFrame, session: str) -> DataFrame:
    """Share of each model in the sum of scores, in percent; equal shares if the sum is not positive."""
    ok = results.where(sc.finite("score").isNotNull() & (F.col("model") != "ensemble")).withColumn("score", sc.clamp01("score"))
    totals = ok.groupBy(session).agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_s") > 0, F.col("score") / F.col("_s") * 100).otherwise(F.lit(100.0) / F.col("_n"))
    return ok.join(totals, session).withColumn("percent", share).drop("_s", "_n")


def control_reference(results: DataFrame, subject: DataFrame, session: str) -> DataFrame:
    """Mean of the model scores, or a mirror of the subject score where there are none."""
    means = results.where(F.col("model") != "ensemble").groupBy(session).agg(F.avg(sc.finite("score")).alias("_m"))
    mirror = F.greatest(F.lit(0.25), 1 - sc.clamp01("subject_score") * 0.8)
    return subject.join(means, session, "left").withColumn("control_score", sc.clamp01(F.coalesce(F.col("_m"), mirror))).drop("_m")


def best_record(results: DataFrame, session: str, preferred: list[str]) -> DataFrame:
    """The first model in a preferred order that has a score."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("model"))
    ok = results.where(sc.finite("score").isNotNull()).withColumn("_r", rank).where(F.col("_r") > 0)
    return ok.groupBy(session).agg(F.min_by("model", "_r").alias("model"), sc.clamp01(F.min_by("score", "_r")).alias("score"))


def batch_summary(sessions: DataFrame, score: str, prediction: str) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(prediction) == 1).alias("at_risk"), F.count_if(F.col(prediction) == 0).alias("safe"),
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def mean_feature_row(frames: DataFrame, session: str, features: list[str]) -> DataFrame:
    """One mean row per video; missing values count as 0, absent columns give 0."""
    have = set(frames.columns)
    return frames.groupBy(session).agg(*[
        (F.avg(F.coalesce(sc.skip_nan(f), F.lit(0.0))) if f in have else F.max(F.lit(0.0))).alias(f) for f in features])


def late_fusion_verdict(df: DataFrame, score: str, threshold: float = SESSION_THRESHOLD) -> DataFrame:
    out = df.withColumn("prediction", sc.predict(score, threshold))
    return out.withColumns({"prediction_label": sc.prediction_label("prediction"), "risk_level": sc.risk_level(score, "session")})
