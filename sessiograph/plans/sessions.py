"""Session statistics, rule scores and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import ordered, projections, scoring, sessions
from ..sources import media
from ._sql import band, clamp, count_of, r
from .projections import TEXT_TABLE_SQL, text_table
from .registry import Registry, r6

registry = Registry()
q = registry.query
FEATURES = ["loudness", "F0", "jitter", "shimmer"]


def _stats_sql(features, prefix, std, extra=""):
    cols = []
    for f in features:
        sd = f'stddev_pop("{f}")' if std == "pop" else f'stddev_samp("{f}")'
        cols += [r(e, f'"{prefix}{f}_{n}"') for n, e in (("mean", f'avg("{f}")'), ("std", sd), ("median", f'median("{f}")'),
                                                        ("min", f'min("{f}")'), ("max", f'max("{f}")'))]
    return ", ".join(cols) + extra


def _rounded(df, ids, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in ids], *ids)


@q("session_audio_stats", "features", "SELECT session_id, min(label) AS label, count(*) AS n_audio_segments, "
   + r("sum(loudness)", "total_audio_duration") + ", " + _stats_sql(FEATURES, "audio_", "pop") + " FROM features GROUP BY session_id")
def _(t):
    out = sessions.session_stats(
        t.features, ["session_id"], FEATURES, "audio_", population=True, zero_empty=True,
        aggs=[sessions.first_by("label", "segment_idx").alias("label"), F.count(F.lit(1)).alias("n_audio_segments"), F.sum("loudness").alias("total_audio_duration")])
    return _rounded(out, ["session_id"])


_TEXT_NUM = ["duration", "num_tokens", "num_chars", "sent_count", "words_per_sec", "type_token_ratio", "avg_word_len", "stopword_ratio"]


@q("session_text_stats", "tokens", f"WITH tt AS ({TEXT_TABLE_SQL}) SELECT session_id, min(label) AS label, count(*) AS n_text_segments, "
   + _stats_sql(_TEXT_NUM, "text_", "samp") + " FROM tt GROUP BY session_id")
def _(t):
    out = sessions.session_stats(text_table(t), ["session_id"], _TEXT_NUM, "text_", population=False, zero_empty=False,
                                 aggs=[sessions.first_by("label", "start_time").alias("label"), F.count(F.lit(1)).alias("n_text_segments")])
    return _rounded(out, ["session_id"])


@q("video_stats", "frames", "SELECT series_id, min(CASE WHEN frame_idx = 0 THEN event_type END) AS label, "
   + _stats_sql(["level", "t"], "", "samp") + " FROM frames GROUP BY series_id")
def _(t):
    out = sessions.session_stats(t.frames, ["series_id"], ["level", "t"], "", population=False, zero_empty=False,
                                 aggs=[sessions.first_by("event_type", "frame_idx").alias("label")])
    return _rounded(out, ["series_id"])


@q("concat_session_text", "segments", r"""WITH c AS (SELECT session_id, segment_idx, regexp_replace(regexp_replace(text,
    '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ''), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '') AS x FROM segments)
    SELECT session_id, string_agg(x, ' ' ORDER BY segment_idx) AS full_text FROM c WHERE x <> '' GROUP BY 1""")
def _(t):
    return sessions.session_text(t.segments, "session_id", "segment_idx")


@q("session_segment_count", "segments", "SELECT session_id, count(*) AS n_segments FROM segments GROUP BY 1")
def _(t):
    return t.segments.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_segments"))


@q("distinct_sessions", "features", "SELECT count(DISTINCT session_id) AS n FROM features")
def _(t):
    return t.features.agg(F.count_distinct("session_id").alias("n"))


@q("class_balance", "features", """SELECT label, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS sessions, count(*) < 10 AS too_few
    FROM (SELECT session_id, label, count(*) AS n FROM features GROUP BY 1, 2) GROUP BY label""")
def _(t):
    return sessions.class_balance(t.features, "session_id", "label")


def _scores(t):
    return scoring.session_scores(t.segments, "session_id", ["segment_idx"])


def _score(key, column, expr, extra=""):
    @q(key, "segments", f"SELECT session_id, {r(expr, column)} FROM {extra or 'segments'} GROUP BY session_id")
    def run(t):
        return _scores(t).select("session_id", r6(column))
    return run


_TOP5 = "(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, segment_idx) AS rn FROM segments) WHERE rn <= 5"


@q("score_mean", "segments", "SELECT session_id, " + r("avg(score)", "score_mean") + " FROM segments GROUP BY session_id")
def _(t):
    return t.segments.groupBy("session_id").agg(r6(F.avg("score"), "score_mean"))


@q("score_max", "segments", "SELECT session_id, " + r("max(score)", "score_max") + " FROM segments GROUP BY session_id")
def _(t):
    return t.segments.groupBy("session_id").agg(r6(F.max("score"), "score_max"))


@q("score_mean_top5", "segments", f"SELECT session_id, {r('avg(score)', 'score_mean_top5')} FROM {_TOP5} GROUP BY session_id")
def _(t):
    top = scoring.top_per_session(t.segments, "session_id", "score", ["segment_idx"], 5)
    return top.groupBy("session_id").agg(r6(F.avg("score"), "score_mean_top5"))


_score("score_percentile_90", "score_p90", "quantile_cont(score, 0.9)")
_score("score_duration_weighted", "score_weighted", "sum(score * duration) / sum(duration)")


@q("session_score_summary", "segments", f"""WITH top AS (SELECT session_id, avg(score) AS t5, string_agg(segment_id, ',' ORDER BY rn) AS ids FROM {_TOP5} GROUP BY 1)
    SELECT s.session_id, count(*) AS n_segments, {r('max(score)', 'score_max')}, {r('min(score)', 'score_min')}, {r('stddev_pop(score)', 'score_std')},
    {r('max(t5)', 'score_mean_top5')}, max(ids) AS top_ids FROM segments s JOIN top ON top.session_id = s.session_id GROUP BY s.session_id""")
def _(t):
    top = scoring.top_per_session(t.segments, "session_id", "score", ["segment_idx"], 5)
    ids = top.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "segment_id"))).alias("_l"))
    ids = ids.select("session_id", F.array_join(F.transform("_l", lambda x: x["segment_id"]), ",").alias("top_ids"))
    s = _scores(t).select("session_id", "n_segments", *[r6(c) for c in ("score_max", "score_min", "score_std", "score_mean_top5")])
    return s.join(ids, "session_id")


@q("subject_majority_label", "", "SELECT l_suppkey AS subject, CAST(round_even(avg(CAST(l_discount > 0.05 AS INTEGER)), 0) AS INTEGER) AS label FROM lineitem GROUP BY 1")
def _(t):
    return t.table("lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(
        F.bround(F.avg((F.col("l_discount") > 0.05).cast("int"))).cast("int").alias("label"))


@q("vector_mean", "vectors", """WITH l AS (SELECT subject, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors)
    SELECT subject, pos, round(avg(x), 6) + CAST(0 AS DOUBLE) AS x FROM l GROUP BY 1, 2""")
def _(t):
    from ..operators.series import vector_mean
    v = vector_mean(t.vectors, ["subject"], "vec")
    long = v.select("subject", F.posexplode("vec").alias("pos", "x"))
    return long.select("subject", F.col("pos").cast("long").alias("pos"), r6("x"))


@q("chunk_probability_summary", "frames", f"""WITH c AS (SELECT series_id, frame_idx // 15 AS chunk, avg(least(1, value / 100)) AS p FROM frames GROUP BY 1, 2)
    SELECT series_id, count(*) AS chunks_used, {r('avg(p)', 'probability', 9)}, {r('avg(CAST(p >= 0.5 AS INTEGER))', 'positive_ratio')},
    CASE WHEN avg(p) >= 0.5 THEN 1 ELSE 0 END AS prediction, {band('avg(p)', 0.4, 0.5)} AS risk_level FROM c GROUP BY 1""")
def _(t):
    from ..operators.reports import chunk_summary
    f = t.frames.select("series_id", "frame_idx", ordered.chunk_of("frame_idx", 15).alias("chunk"), F.least(F.lit(1.0), F.col("value") / 100).alias("p"))
    chunks = ordered.moments(f, ["series_id", "chunk"], ["frame_idx"], F.lit(0), {"p": F.col("p")})
    return chunk_summary(chunks, "series_id", "chunk", "p").select("series_id", "chunks_used", r6("probability", digits=9), r6("positive_ratio"), "prediction", "risk_level")


@q("mean_feature_row", "frames", f"""SELECT series_id, {r('avg(CASE WHEN value > 90 THEN 0 ELSE level END)', 'level')}, {r('avg(t)', 't')}, CAST(0 AS DOUBLE) AS motion FROM frames GROUP BY 1""")
def _(t):
    f = t.frames.withColumn("level", F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("level")))
    return _rounded(scoring.mean_feature_row(f, "series_id", ["level", "t", "motion"]), ["series_id"])


EMOTION_SQL = "CASE event_type WHEN 'error' THEN ' Sad ' WHEN 'click' THEN 'Happy' WHEN 'view' THEN 'neutral' WHEN 'signup' THEN 'FEAR' ELSE 'unknown' END"


def emotions(t):
    e = F.col("event_type")
    return t.frames.withColumn("emotion", F.when(e == "error", " Sad ").when(e == "click", "Happy").when(e == "view", "neutral").when(e == "signup", "FEAR"))


_EMO = f"""WITH e AS (SELECT series_id, lower(trim({EMOTION_SQL})) AS e FROM frames), c AS (SELECT series_id, e, count(*) AS c FROM e WHERE e <> 'unknown' GROUP BY 1, 2),
    s AS (SELECT series_id, sum(c) AS n, arg_min(e, (-c, e)) AS dominant, sum(CASE WHEN e IN ('sad', 'angry', 'fear', 'disgust', 'contempt') THEN c ELSE 0 END) / sum(c) AS neg FROM c GROUP BY 1)"""


@q("emotion_distribution", "frames", _EMO + f" SELECT c.series_id, e AS emotion, {r('c / n', 'share')}, dominant, {r('neg', 'negative_ratio')} FROM c JOIN s ON s.series_id = c.series_id")
def _(t):
    d = scoring.emotion_distribution(emotions(t), "series_id", "emotion")
    return d.select("series_id", "dominant", r6("negative_ratio"), F.explode("distribution").alias("emotion", "share")).withColumn("share", F.round("share", 6))


@q("emotion_score", "frames", _EMO + f""", p AS (SELECT series_id, avg(level) / 20 AS p FROM frames WHERE event_type = 'purchase' GROUP BY 1),
    f AS (SELECT s.series_id, {clamp('0.7 * neg + 0.3 * coalesce(p, 0)')} AS x FROM s LEFT JOIN p ON p.series_id = s.series_id)
    SELECT series_id, {r('x', 'emotion_score', 9)}, CAST(x >= 0.5 AS INTEGER) AS prediction, CASE WHEN x >= 0.5 THEN 'experimental' ELSE 'control' END AS prediction_label, {band('x', 0.4, 0.5)} AS risk_level FROM f""")
def _(t):
    d = scoring.emotion_distribution(emotions(t), "series_id", "emotion")
    p = t.frames.where(F.col("event_type") == "purchase").groupBy("series_id").agg((F.avg("level") / 20).alias("p"))
    s = d.join(p, "series_id", "left").withColumn("emotion_score", scoring.emotion_score(F.col("negative_ratio"), F.col("p")))
    return scoring.verdict(s, "emotion_score", 0.5).select("series_id", r6("emotion_score", digits=9), "prediction", "prediction_label", "risk_level")


@q("deception_score", "segments", f"""WITH f AS (SELECT *, max(CASE WHEN duration BETWEEN 3 AND 13 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has FROM segments),
    a AS (SELECT session_id, count(*) AS segments_used, avg(score) AS m, stddev_pop(score) AS d, avg(CAST(score >= 0.6 AS INTEGER)) AS h FROM f WHERE has = 0 OR duration BETWEEN 3 AND 13 GROUP BY 1),
    x AS (SELECT *, {clamp('0.5 * m + 0.35 * d + 0.15 * h')} AS x FROM a)
    SELECT session_id, segments_used, {r('x', 'deception_score')}, CAST(x >= 0.55 AS INTEGER) AS prediction, {band('x', 0.4, 0.5)} AS risk_level FROM x""")
def _(t):
    s = scoring.deception_score(projections.duration_window(t.segments, "session_id", "segment_idx"), "session_id", "segment_idx")
    return s.select("session_id", "segments_used", r6("deception_score"), "prediction", "risk_level")


_WT = r"regexp_extract_all(lower(full_text), '[\p{L}\p{N}_]+')"
_ANOM = rf"""WITH c AS (SELECT session_id, segment_idx, regexp_replace(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ''), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '') AS x FROM segments),
    f AS (SELECT session_id, string_agg(x, ' ' ORDER BY segment_idx) AS full_text FROM c WHERE x <> '' GROUP BY 1),
    m AS (SELECT session_id, CAST(len({_WT}) AS BIGINT) AS word_count, CAST(len(list_distinct({_WT})) AS BIGINT) AS unique_words,
        {count_of('[!?.,;:]', 'full_text')} / CAST(greatest(1, length(full_text)) AS DOUBLE) AS punct FROM f),
    d AS (SELECT *, CASE WHEN word_count > 0 THEN 1 - unique_words / CAST(word_count AS DOUBLE) ELSE 1 END AS rep FROM m),
    s AS (SELECT *, {clamp('0.55 * rep + CASE WHEN word_count < 25 THEN 0.25 ELSE 0 END + 0.2 * least(1, punct * 4)')} AS x FROM d)"""


@q("text_anomaly_score", "segments", _ANOM + f""" SELECT session_id, word_count, unique_words, {r('rep', 'repetition_ratio')}, {r('punct', 'punctuation_ratio')},
    {r('x', 'anomaly_score')}, CAST(x >= 0.6 AS INTEGER) AS prediction, CASE WHEN x >= 0.6 THEN 'anomaly' ELSE 'normal' END AS prediction_label, {band('x', 0.4, 0.5)} AS risk_level FROM s""")
def _(t):
    s = scoring.text_anomaly_score(t.segments, "session_id")
    return s.select("session_id", "word_count", "unique_words", r6("repetition_ratio"), r6("punctuation_ratio"), r6("anomaly_score"),
                    "prediction", "prediction_label", "risk_level")


_TS = ["duration", "num_tokens", "type_token_ratio", "words_per_sec"]


@q("text_session_verdict", "tokens", f"WITH tt AS ({TEXT_TABLE_SQL}), ts AS (SELECT session_id, count(*) AS n_text_segments, " + _stats_sql(_TS, "text_", "samp")
   + " FROM tt GROUP BY 1), " + _ANOM[5:] + f" SELECT ts.*, {r('x', 'anomaly_score')}, {band('x', 0.4, 0.5)} AS risk_level FROM ts JOIN s ON s.session_id = ts.session_id")
def _(t):
    stats = sessions.session_stats(text_table(t), ["session_id"], _TS, "text_", population=False, zero_empty=False, aggs=[F.count(F.lit(1)).alias("n_text_segments")])
    s = scoring.text_anomaly_score(t.segments, "session_id")
    return _rounded(stats, ["session_id"]).join(s.select("session_id", r6("anomaly_score"), "risk_level"), "session_id")


@q("audio_anomaly_score", "segments", f"""WITH j AS (SELECT *, abs(score - lag(score) OVER (PARTITION BY session_id ORDER BY segment_idx)) AS j FROM segments),
    a AS (SELECT session_id, count(*) AS segments_used, stddev_pop(score) AS sd, stddev_pop(duration) / greatest(1e-6, avg(duration)) AS cv, coalesce(avg(CASE WHEN j > 0.35 THEN 1 WHEN j IS NOT NULL THEN 0 END), 0) AS jr FROM j GROUP BY 1),
    x AS (SELECT *, {clamp('0.4 * sd + 0.3 * least(1, cv) + 0.2 * jr + CASE WHEN segments_used < 3 THEN 0.1 ELSE 0 END')} AS x FROM a)
    SELECT session_id, segments_used, {r('cv', 'duration_cv')}, {r('jr', 'jump_ratio')}, {r('x', 'anomaly_score')}, CAST(x >= 0.6 AS INTEGER) AS prediction, {band('x', 0.4, 0.5)} AS risk_level FROM x""")
def _(t):
    s = scoring.audio_anomaly_score(t.segments, "session_id", "segment_idx", ordered.chunk_of("segment_idx", 4096))
    return s.select("session_id", "segments_used", r6("duration_cv"), r6("jump_ratio"), r6("anomaly_score"), "prediction", "risk_level")


_VID = """WITH v AS (SELECT series_id, max(CASE WHEN event_type = 'error' THEN value / 40 ELSE 0 END) AS g, max(value / 150) AS h,
        avg(least(1, value / 90)) AS s, max(CASE WHEN event_type = 'click' THEN value / 60 ELSE 0 END) AS f FROM frames GROUP BY 1),
    i AS (SELECT series_id, CAST(g > 5 AS DOUBLE) AS gaze_avoidance, CAST(h > 3 AS DOUBLE) AS head_down_long, CAST(s < 0.5 AS DOUBLE) AS instability,
        CAST(f > 3 AS DOUBLE) AS face_touching, CAST(0 AS DOUBLE) AS blinking_spikes FROM v),
    x AS (SELECT *, (gaze_avoidance + head_down_long + instability + face_touching + blinking_spikes) / 5 AS rule_score FROM i)"""


def video_metrics(t):
    v, e = F.col("value"), F.col("event_type")
    return t.frames.select("series_id", "frame_idx", "t", F.when(e == "error", v / 40).alias("gaze_away_time"), (v / 150).alias("head_down_duration"),
                           F.least(F.lit(1.0), v / 90).alias("head_stability"), F.when(e == "click", v / 60).otherwise(float("nan")).alias("face_touch_count"))


@q("video_anomaly_indicators", "frames", _VID + " SELECT * REPLACE (round(rule_score, 6) AS rule_score) FROM x")
def _(t):
    return scoring.video_anomaly_indicators(video_metrics(t), "series_id").withColumn("rule_score", F.round("rule_score", 6))


@q("video_anomaly_score", "frames", _VID + f""", s AS (SELECT c_custkey AS series_id, CASE WHEN c_acctbal > 0 THEN least(1, sqrt(c_acctbal) / 100) END AS model_prob FROM customer),
    y AS (SELECT s.series_id, CASE WHEN rule_score IS NULL THEN 1 ELSE {clamp('0.7 * rule_score + 0.3 * coalesce(model_prob, 0)')} END AS y FROM s LEFT JOIN x ON x.series_id = s.series_id)
    SELECT series_id, {r('y', 'anomaly_score')}, CAST(y >= 0.6 AS INTEGER) AS prediction, {band('y', 0.4, 0.5)} AS risk_level FROM y""")
def _(t):
    c = t.table("customer").select(F.col("c_custkey").alias("series_id"), F.when(F.col("c_acctbal") > 0, F.least(F.lit(1.0), F.sqrt("c_acctbal") / 100)).alias("model_prob"))
    s = scoring.video_anomaly_score(c, scoring.video_anomaly_indicators(video_metrics(t), "series_id"), "series_id")
    return s.select("series_id", r6("anomaly_score"), "prediction", "risk_level")


MODELS_SQL = """models AS (SELECT user_id AS session_id, event_type AS model, least(1, max(value) / 250) AS score, CAST(least(1, max(value) / 250) >= 0.5 AS INTEGER) AS prediction
    FROM events GROUP BY 1, 2)"""


def model_results(t):
    """Answers of up to five models per session; a model without events did not answer."""
    m = t.table("events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("model")).agg(
        F.least(F.lit(1.0), F.max("value") / 250).alias("score"))
    return m.withColumns({"prediction": sc.predict("score", 0.5), "success": F.lit(True)})


_ENS = f"""WITH {MODELS_SQL}, a AS (SELECT session_id, count(*) AS n_models, avg(score) AS s, count(DISTINCT prediction) = 1 AS agreement, max(prediction) AS only_p, min(model) AS m FROM models GROUP BY 1),
    e AS (SELECT session_id, n_models, s, CASE WHEN n_models = 1 THEN only_p ELSE CAST(s >= 0.5 AS INTEGER) END AS prediction, agreement,
    CASE WHEN n_models = 1 THEN {band('s', 0.59, 0.69)} ELSE {band('s', 0.4, 0.5)} END AS risk_level, CASE WHEN n_models = 1 THEN m ELSE 'ensemble' END AS source FROM a)"""


@q("ensemble_average", "", _ENS + f" SELECT session_id, n_models, {r('s', 'ensemble_score', 9)}, prediction, agreement, risk_level, source FROM e")
def _(t):
    return scoring.ensemble(model_results(t), "session_id").select("session_id", "n_models", r6("ensemble_score", digits=9), "prediction", "agreement", "risk_level", "source")


@q("ensemble_fallback", "", _ENS + f""" SELECT c_custkey AS session_id, coalesce(n_models, 0) AS n_models, {r('s', 'ensemble_score', 9)}, coalesce(source, 'none') AS source, risk_level, s IS NOT NULL AS success
    FROM customer LEFT JOIN e ON session_id = c_custkey""")
def _(t):
    every = t.table("customer").select(F.col("c_custkey").alias("session_id"))
    return scoring.ensemble_with_fallback(every, model_results(t), "session_id").select(
        "session_id", "n_models", r6("ensemble_score", digits=9), "source", "risk_level", "success")


@q("batch_prediction_summary", "", _ENS + f""" SELECT count(*) AS total, count(*) FILTER (prediction = 1) AS at_risk, count(*) FILTER (prediction = 0) AS safe,
    {r('avg(s)', 'mean_score', 9)}, {r('stddev_pop(s)', 'std_score', 9)}, {r('min(s)', 'min_score', 9)}, {r('max(s)', 'max_score', 9)} FROM e""")
def _(t):
    return _rounded(scoring.batch_summary(scoring.ensemble(model_results(t), "session_id"), "ensemble_score", "prediction"), [], 9)


@q("contribution_share", "", f"""WITH {MODELS_SQL} SELECT session_id, model, {r('score / sum(score) OVER (PARTITION BY session_id) * 100', 'percent')} FROM models""")
def _(t):
    return scoring.contribution_share(model_results(t), "session_id").select("session_id", "model", r6("percent"))


@q("control_reference_score", "", f"""WITH {MODELS_SQL}, m AS (SELECT session_id, avg(score) AS m FROM models GROUP BY 1)
    SELECT c_custkey AS session_id, {r(clamp('coalesce(m, greatest(0.25, 1 - ' + clamp('c_acctbal / 10000') + ' * 0.8))'), 'control_score', 9)} FROM customer LEFT JOIN m ON session_id = c_custkey""")
def _(t):
    subject = t.table("customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_acctbal") / 10000).alias("subject_score"))
    return scoring.control_reference(model_results(t), subject, "session_id").select("session_id", r6("control_score", digits=9))


@q("cascade_best_modality", "", f"""WITH {MODELS_SQL}, k AS (SELECT *, CASE model WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS k FROM models)
    SELECT session_id, arg_min(model, k) AS model, {r('arg_min(score, k)', 'score')} FROM k WHERE k IS NOT NULL GROUP BY 1""")
def _(t):
    return scoring.best_record(model_results(t), "session_id", ["purchase", "click", "error"]).select("session_id", "model", r6("score"))


@q("null_count_report", "frames", """WITH n AS (SELECT count(*) FILTER (value > 100) AS loud, count(*) FILTER (event_type = 'error') AS kind, count(*) FILTER (frame_idx > 50) AS late FROM frames)
    SELECT column_name, nulls FROM (UNPIVOT n ON loud, kind, late INTO NAME column_name VALUE nulls) WHERE nulls > 0""")
def _(t):
    f = t.frames.select("series_id", F.when(F.col("value") <= 100, F.col("value")).alias("loud"),
                        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.when(F.col("frame_idx") <= 50, F.col("t")).alias("late"))
    return sessions.null_counts(f)


@q("duplicate_key_check", "features", "SELECT session_id, segment_idx, count(*) AS copies FROM features GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return sessions.duplicate_keys(t.features, ["session_id", "segment_idx"])


@q("dataset_validation", "", """WITH s AS (SELECT o_custkey AS session_id, CAST(o_orderkey % 2 AS INTEGER) AS label, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS full_text FROM orders)
    SELECT count(*) AS sessions, count(*) - count(DISTINCT session_id) AS duplicates, count(*) FILTER (full_text = '') AS empty_texts, count(*) FILTER (label = 0) AS controls,
    count(*) FILTER (label = 1) AS risks, true AS labels_valid, count(*) >= 30 AS enough_sessions, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) >= 10 AS enough_per_class,
    count(*) = count(DISTINCT session_id) AS passed FROM s""")
def _(t):
    s = t.table("orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 2).cast("int").alias("label"),
                                 F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("full_text"))
    return sessions.validate_dataset(s)


@q("pipeline_artifact_report", "listing media scripts", """WITH w AS (SELECT file_id, max(CAST(ext = 'wav' AS INTEGER)) AS wav FROM media GROUP BY 1)
    SELECT w.file_id, wav = 1 AS has_wav, t.file_id IS NOT NULL AS has_transcript, s.id IS NOT NULL AS has_segments,
        concat_ws('; ', CASE WHEN wav = 0 THEN 'no wav file' END, CASE WHEN t.file_id IS NULL THEN 'no transcript' END, CASE WHEN s.id IS NULL THEN 'no segments' END) AS messages
    FROM w LEFT JOIN (SELECT DISTINCT file_id FROM scripts) t ON t.file_id = w.file_id
    LEFT JOIN (SELECT DISTINCT 'rec_' || CAST(conv_id AS VARCHAR) AS id FROM conversations) s ON s.id = w.file_id""")
def _(t):
    from ..operators.reports import artifact_report
    have = media.labelled_media(t.media_listing).groupBy("file_id").agg(F.max((F.col("ext") == "wav")).alias("has_wav"))
    segments = t.table("conversations").select(F.concat(F.lit("rec_"), F.col("conv_id").cast("string")).alias("file_id"))
    return artifact_report(have, {"has_transcript": t.transcript_listing, "has_segments": segments}, "file_id",
                           {"has_wav": "no wav file", "has_transcript": "no transcript", "has_segments": "no segments"})


def _quality(t):
    f = t.features.withColumn("label", (F.col("loudness") > 25).cast("int")).withColumns({
        "flat": F.lit(3.5), "zero": F.lit(0.0), "gaps": F.when(F.col("jitter") > 0, F.col("F0") / F.col("jitter")).otherwise(float("inf"))})
    return sessions.feature_quality(f, "label", ["loudness", "F0", "jitter", "flat", "zero", "gaps"])


_QF = """f AS (SELECT CAST(loudness > 25 AS INTEGER) AS label, loudness, "F0", jitter, CAST(3.5 AS DOUBLE) AS flat, CAST(0 AS DOUBLE) AS zero, CASE WHEN jitter > 0 THEN "F0" / jitter END AS gaps FROM features),
    u AS (UNPIVOT f ON loudness, "F0", jitter, flat, zero, gaps INTO NAME feature VALUE x)"""


@q("label_correlation", "features", f"""WITH {_QF}, c AS (SELECT feature, CASE WHEN stddev_pop(x) > 0 THEN corr(x, label) END AS rr FROM u GROUP BY 1)
    SELECT feature, {r('rr', 'r')}, abs(rr) > 0.5 AS strong FROM c""")
def _(t):
    return _quality(t).select("feature", r6(F.nanvl(F.col("r"), F.lit(None).cast("double")), "r"),
                              (F.abs(F.nanvl(F.col("r"), F.lit(None).cast("double"))) > 0.5).alias("strong"))


@q("constant_features", "features", f"""WITH {_QF}, n AS (SELECT count(*) - count(gaps) AS n FROM f)
    SELECT feature, stddev_samp(x) < 1e-10 AS constant, max(abs(x)) = 0 AS all_zero, CASE WHEN feature = 'gaps' THEN max(n) ELSE 0 END AS not_finite FROM u, n GROUP BY feature""")
def _(t):
    return _quality(t).select("feature", "constant", "all_zero", "not_finite")


@q("label_shift_check", "features", f"""WITH {_QF}, s AS (SELECT feature, avg(x) FILTER (label = 0) AS m0, avg(x) FILTER (label = 1) AS m1, stddev_samp(x) FILTER (label = 0) AS d0, stddev_samp(x) FILTER (label = 1) AS d1 FROM u GROUP BY 1)
    SELECT feature, {r('m0', 'mean_0')}, {r('m1', 'mean_1')}, {r('d0', 'std_0')}, {r('d1', 'std_1')}, abs(m1 - m0) > 2 * (d0 + d1) / 2 AS shifted FROM s""")
def _(t):
    return _quality(t).select("feature", r6("mean_0"), r6("mean_1"), r6("std_0"), r6("std_1"), "shifted")


@q("metadata_metric_lookup", "", r"""WITH v AS (SELECT o_orderkey, o_orderstatus, '0.' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS a, '0.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS b FROM orders)
    SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN CAST(a AS DOUBLE) WHEN 'O' THEN CAST(b AS DOUBLE) ELSE (CAST(a AS DOUBLE) + CAST(b AS DOUBLE)) / 2 END, 6) AS recall FROM v""")
def _(t):
    from ..operators.reports import metric_lookup
    a = F.concat(F.lit("0."), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    b = F.concat(F.lit("0."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    meta = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"meta_metrics":{"mean_recall":'), a, F.lit(',"recall":0.999}}')))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit('{"meta_metrics":{"mean_recall":"n/a","recall":'), b, F.lit("}}")))
            .otherwise(F.concat(F.lit('{"meta_metrics":{"fold_results":[{"recall":'), a, F.lit('},{"recall":'), b, F.lit("},{}]}}"))))
    m = t.table("orders").select("o_orderkey", meta.alias("meta"))
    return metric_lookup(m, "meta", "$.meta_metrics", "recall").select("o_orderkey", r6("recall"))
