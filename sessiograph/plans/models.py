"""Folds, text features, models, fusion, scoring, session reports."""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.ml import feature as ft
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import folds, models, packages, perceptron, projections, reports, scoring, series, sessions
from ..session import durable, packed, shared_dir, spread
from ._sql import AWL, TTR, band, r
from .registry import Registry, r6

registry = Registry()
q = registry.query
_H = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT)"


@q("group_kfold_assign", "", f"""WITH n AS (SELECT CAST(greatest(3, least(10, count(DISTINCT o_custkey) // 8)) AS INTEGER) AS k FROM orders)
    SELECT o_orderkey, CAST({_H.format('o_custkey')} % 5 AS INTEGER) AS fold5, CAST({_H.format('o_custkey')} % k AS INTEGER) AS fold FROM orders, n""")
def _(t):
    o = t.table("orders").select("o_orderkey", "o_custkey")
    return folds.group_kfold(folds.group_kfold(o, "o_custkey", 5, "fold5"), "o_custkey").select("o_orderkey", "fold5", "fold")


_RANK = """g AS (SELECT o_custkey, CAST(round_even(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 0) AS INTEGER) AS l FROM orders GROUP BY 1),
    k AS (SELECT o_custkey, row_number() OVER (PARTITION BY l ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS rn FROM g)"""


def _labelled_orders(t):
    return t.table("orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@q("stratified_group_kfold_assign", "", f"WITH {_RANK} SELECT o_orderkey, CAST(rn % 5 AS INTEGER) AS fold FROM orders JOIN k ON k.o_custkey = orders.o_custkey")
def _(t):
    return folds.stratified_group_kfold(_labelled_orders(t), "o_custkey", "label", 5).select("o_orderkey", "fold")


@q("group_train_test_split", "", f"WITH {_RANK} SELECT o_orderkey, CASE WHEN rn % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders JOIN k ON k.o_custkey = orders.o_custkey")
def _(t):
    return folds.group_train_test(_labelled_orders(t), "o_custkey", "label").select("o_orderkey", "split")


@q("tfidf_features", "", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{models.ACCENTED}', '{models.PLAIN}'), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents),
    e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    c AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, ln((n + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS idf FROM c, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= n * 0.95),
    x AS (SELECT doc_id, c.term, (1 + ln(tf)) * idf AS w FROM c JOIN v ON v.term = c.term), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1)
    SELECT x.doc_id, term, round(w / l, 6) AS weight FROM x JOIN l ON l.doc_id = x.doc_id""")
def _(t):
    return models.tfidf(spread(t.table("documents").select("doc_id", "text")), "doc_id", "text", max_terms=None).withColumn("weight", F.round("weight", 6))


AUDIO = ["audio_loudness_mean", "audio_f0_mean", "audio_jitter_max", "audio_n"]


def audio_of_documents(t):
    """Audio statistics of the order with a document's number."""
    return t.table("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.avg("l_quantity").alias("audio_loudness_mean"), F.avg("l_extendedprice").alias("audio_f0_mean"), F.max("l_tax").alias("audio_jitter_max"), F.count(F.lit(1)).cast("double").alias("audio_n"))


def terms_of_text() -> dict:
    return {"terms": models.ngram_terms("text")}


def term_numbers() -> dict:
    """How many terms a text has, and how many different ones."""
    return {"n_terms": F.size(models.ngram_terms("text")).cast("double"), "distinct_terms": F.size(F.array_distinct(models.ngram_terms("text"))).cast("double")}


def sessions_to_score(t, of_text=terms_of_text):
    """All documents as sessions: what the learner takes of the text, audio statistics where there are any."""
    return t.table("documents").select("doc_id", *[c.alias(n) for n, c in of_text().items()]).join(audio_of_documents(t), "doc_id", "left")


def training_sessions(t, of_text=terms_of_text):
    """Labelled documents as sessions: what the learners take of the text (``dict`` leaves it unread), audio statistics, label, group.

    Stored once, because every learner reads it many times. Texts become terms or numbers before they are joined.
    """
    labels = t.table("labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    s = t.table("documents").join(labels, "doc_id").select("doc_id", "label", *[c.alias(n) for n, c in of_text().items()])
    s = s.join(audio_of_documents(t), "doc_id", "left")
    s = projections.fill_missing_features(s, AUDIO).withColumn("group_id", F.col("doc_id").cast("string"))
    return durable(folds.group_kfold(s, "group_id", packages.Settings.folds), "training")


def package_path(t, name: str, *settings) -> str:
    """Folder of a package trained from one data directory under these settings."""
    return shared_dir(t.spark, "models").rsplit("/", 1)[0] + f"/models/{name}-" + hashlib.md5(f"{t.dir}|{settings}".encode()).hexdigest()


def session_package(t):
    """The trained package of one data directory: trained by the first query that needs it, loaded by all others."""
    path = package_path(t, "sessions", packages.Settings(), AUDIO)
    if not packages.stored_at(t.spark, path):
        packages.SessionPackage.train(training_sessions(t), "doc_id", AUDIO).save(path)
    return packages.SessionPackage.load(t.spark, path)


@q("text_svc_calibrated")
def _(t):
    return packages.with_score(session_package(t).text, sessions_to_score(t).select("doc_id", "terms"), "p_text").select("doc_id", r6("p_text"))


@q("audio_gbt")
def _(t):
    s = projections.fill_missing_features(sessions_to_score(t).drop("terms"), AUDIO)
    return packages.with_score(session_package(t).audio, s, "p_audio").select("doc_id", r6("p_audio"))


def labelled_segments(t):
    """Segments with lexical features; the label is whether the assistant speaks."""
    feats = {"duration": F.col("duration"), "word_count": tx.word_count("text").cast("double"), "type_token_ratio": tx.type_token_ratio("text"),
             "avg_word_length": tx.avg_word_length("text"), "complex": tx.ratio_of_tokens(tx.complex_word_count("text"), "text")}
    s = t.segments.select("session_id", "segment_idx", "segment_id", "start_time", "end_time", "text", (F.col("role") == "assistant").cast("int").alias("label"), *[c.alias(n) for n, c in feats.items()])
    return folds.group_kfold(s, "session_id", packages.SEGMENT.folds)


SEG = ["duration", "word_count", "type_token_ratio", "avg_word_length", "complex"]


def segment_package(t) -> str:
    """Folder of the trained segment trees; trained by the first query that needs them."""
    path = package_path(t, "segments", packages.SEGMENT, SEG)
    if not packages.stored_at(t.spark, path):
        packages.train_segments(labelled_segments(t).drop("text"), SEG, path)
    return path


@q("segment_gbt")
def _(t):
    return t.spark.read.parquet(f"{segment_package(t)}/oof").select("session_id", "segment_idx", "fold", "label", r6("segment_score"))


@q("segment_feature_importance")
def _(t):
    info = packages.read_info(t.spark, segment_package(t))
    return packages.mean_importances(t.spark, info["importances"], 15).select("rank", "feature", r6("importance"))


@q("early_fusion_linear")
def _(t):
    s = training_sessions(t)
    vectors = models.TextVectors.fit(s, packages.Settings.max_terms, packages.Settings.min_df, packages.Settings.max_df)
    scaler = ft.StandardScaler(inputCol="_num", outputCol="_numz", withMean=True).fit(models.assemble(AUDIO, "_num").transform(s))
    stages = PipelineModel([*vectors.stages, models.assemble(AUDIO, "_num"), scaler, models.assemble(["text_vec", "_numz"])])
    both = durable(stages.transform(s).select("doc_id", "group_id", "label", "features"), "vectors")
    model = PipelineModel([*stages.stages, *packages.calibrated_svc(both, packages.Settings())])
    return packages.with_score(model, projections.fill_missing_features(sessions_to_score(t), AUDIO), "p_final").select("doc_id", r6("p_final", "p"))


@q("early_fusion_trees")
def _(t):
    model = packages.tree_model(training_sessions(t, term_numbers), [*AUDIO, *term_numbers()], packages.Settings(), balanced=True)
    return packages.with_score(model, projections.fill_missing_features(sessions_to_score(t, term_numbers), AUDIO), "p_final").select("doc_id", r6("p_final", "p"))


@q("oof_predictions")
def _(t):
    return session_package(t).oof.select("doc_id", "fold", "label", r6("p_text"))


@q("late_fusion_meta")
def _(t):
    p = session_package(t)
    return p.oof.select("doc_id", "fold", "label", r6("p_text"), r6("p_audio"), r6("p_final"), *[F.lit(p.info[k]).alias(k) for k in ("w_text", "w_audio", "intercept")])


@q("average_fusion")
def _(t):
    s, k = training_sessions(t, dict), packages.Settings.folds
    (audio, _), (video, _) = packages.side_by_side([
        lambda: packages.held_out(s, k, lambda d: packages.tree_model(d, AUDIO[:2], packages.Settings()), "p_audio"),
        lambda: packages.held_out(s, k, lambda d: packages.tree_model(d, AUDIO[2:], packages.Settings()), "p_video")])
    both = audio.select("doc_id", "label", "p_audio").join(video.select("doc_id", "p_video"), "doc_id")
    p = (F.col("p_audio") + F.col("p_video")) / 2
    return both.select("doc_id", "label", r6(p, "p_fused"), (p >= 0.5).cast("int").alias("prediction"))


#: The boosted baseline as ``models.learners`` has it.
BOOSTED = packages.Settings(rounds=50, depth=3, rate=0.1, min_rows=1, column_share=1.0)


@q("baseline_models")
def _(t):
    s, makers = training_sessions(t, dict), models.learners(width=len(AUDIO))

    def fit(name, d):
        if name == "gradient_boosting":
            return packages.tree_model(d, AUDIO, BOOSTED)
        if name == "perceptron":
            return perceptron.fit_perceptron(d, AUDIO, makers[name]())
        return models.numeric_pipeline(AUDIO, makers[name]()).fit(packed(d, d.count()))
    parts = packages.side_by_side([lambda name=name: packages.held_out(s, packages.Settings.folds, lambda d: fit(name, d), "p_held")[0] for name in makers])
    out = None
    for name, part in zip(makers, parts, strict=True):
        part = part.select(F.lit(name).alias("model"), "doc_id", "label", r6("p_held", "p"))
        out = part if out is None else out.unionByName(part)
    return out


@q("pca_projection")
def _(t):
    return models.project_pca(t.vectors.select("subject", "frame_idx", "vec"), "vec", 2).select("subject", "frame_idx", r6("pc1"), r6("pc2"))


# a stored linear package: weights over scaled lexical features
WEIGHTS = {"word_count": 0.9, "type_token_ratio": -0.7, "avg_word_length": 0.4, "absent_feature": 0.3}
_LEX = f"""lex AS (SELECT session_id, segment_idx, segment_id, start_time, end_time, text, CAST(len(w) AS DOUBLE) AS word_count, {TTR} AS type_token_ratio, {AWL} AS avg_word_length FROM toks),
    ls AS (SELECT avg(word_count) AS m1, stddev_pop(word_count) AS d1, avg(type_token_ratio) AS m2, stddev_pop(type_token_ratio) AS d2, avg(avg_word_length) AS m3, stddev_pop(avg_word_length) AS d3 FROM lex),
    scored AS (SELECT lex.*, 1 / (1 + exp(-(0.9 * (word_count - m1) / d1 - 0.7 * (type_token_ratio - m2) / d2 + 0.4 * (avg_word_length - m3) / d3 - 0.2))) AS risk_score FROM lex, ls)"""


def scored_segments(t):
    s = t.segments.select("session_id", "segment_idx", "segment_id", "start_time", "end_time", "text", tx.word_count("text").cast("double").alias("word_count"),
                          tx.type_token_ratio("text").alias("type_token_ratio"), tx.avg_word_length("text").alias("avg_word_length"))
    present = [f for f in WEIGHTS if f in s.columns]
    stats = series.saved_stats(s, present).unionByName(t.spark.range(1).select(F.lit("absent_feature").alias("feature"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std")))
    out = models.linear_score(WEIGHTS, -0.2, stats, s)
    return out.withColumn("risk_level", sc.risk_level("risk_score", "segment"))


@q("score_segments", "tokens", f"WITH {_LEX} SELECT session_id, segment_idx, {r('risk_score', 'risk_score')}, {band('risk_score', 0.3, 0.6)} AS risk_level FROM scored")
def _(t):
    return scored_segments(t).select("session_id", "segment_idx", r6("risk_score"), "risk_level")


@q("score_sessions")
def _(t):
    scored = models.text_fallback(session_package(t).score(sessions_to_score(t)), "doc_id")
    return scoring.late_fusion_verdict(scored, "score").select("doc_id", r6("p_text"), r6("p_audio"), r6("p_final"), r6("score"), "source", "reason", "trained", "prediction", "prediction_label", "risk_level")


_FB = """f AS (SELECT s.session_id, t.p_text, a.p_final FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS session_id FROM customer) s
    LEFT JOIN (SELECT session_id, avg(score) AS p_text FROM segments GROUP BY 1) t ON t.session_id = s.session_id
    LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, avg(l_discount) * 10 AS p_final FROM lineitem GROUP BY 1) a ON a.session_id = s.session_id)"""


@q("score_text_only_fallback", "segments", f"""WITH {_FB} SELECT session_id, {r('coalesce(p_final, p_text)', 'score')}, CASE WHEN p_final IS NOT NULL THEN 'nlp' WHEN p_text IS NOT NULL THEN 'nlp_text_fallback' ELSE 'none' END AS source,
    CASE WHEN p_final IS NULL THEN 'no segment features' END AS reason FROM f""")
def _(t):
    text = t.segments.groupBy("session_id").agg(F.avg("score").alias("p_text"))
    li = t.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("session_id")).agg((F.avg("l_discount") * 10).alias("p_final"))
    every = t.table("customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    joined = every.join(text, "session_id", "left").join(li, "session_id", "left")
    return models.text_fallback(joined, "session_id").select("session_id", r6("score"), "source", "reason")


class LogisticRule:
    """A foreign model: only numpy and predict_proba."""

    def __init__(self, weights, intercept):
        self.weights, self.intercept = weights, intercept

    def predict_proba(self, x):
        import numpy as np
        p = 1 / (1 + np.exp(-(np.nan_to_num(x) @ np.asarray(self.weights) + self.intercept)))
        return np.stack([1 - p, p], axis=1)


@q("foreign_model_udf", "features", f"SELECT session_id, segment_idx, {r('1 / (1 + exp(-(0.05 * loudness + 8 * jitter - 12 * shimmer - 1.2)))', 'p')} FROM features")
def _(t):
    out = models.foreign_scores(t.features, LogisticRule([0.05, 8.0, -12.0], -1.2), ["loudness", "jitter", "shimmer"])
    return out.select("session_id", "segment_idx", r6("p"))


_TOP5 = "(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(risk_score, 12) DESC, segment_idx) AS rn FROM scored)"
_AN = f"""a AS (SELECT session_id, count(*) AS n_segments, count(*) FILTER (risk_score >= 0.6) AS n_high, avg(risk_score) FILTER (rn <= 5) AS overall, string_agg(segment_id, ',' ORDER BY rn) FILTER (rn <= 5) AS top_ids FROM {_TOP5} GROUP BY 1)"""


def analysed(t):
    return reports.analyze_session(scored_segments(t), "session_id", threshold=0.55)


@q("analyze_session", "tokens", f"WITH {_LEX}, {_AN} SELECT session_id, n_segments, n_high, {r('overall', 'overall')}, {band('overall', 0.3, 0.6)} AS risk_level, CAST(overall >= 0.55 AS INTEGER) AS prediction, top_ids FROM a")
def _(t):
    a = analysed(t)
    return a.select("session_id", "n_segments", "n_high", r6("overall"), "risk_level", "prediction", F.array_join(F.transform("top_segments", lambda s: s["segment_id"]), ",").alias("top_ids"))


@q("pack_result_json", "tokens", f"""WITH {_LEX}, {_AN} SELECT session_id, session_id AS json_session, {r('overall', 'json_score')}, n_segments AS json_segments, split_part(top_ids, ',', 1) AS json_top FROM a""")
def _(t):
    packed = reports.pack_json(analysed(t), "session_id")
    j = F.col("report")
    return packed.select("session_id", F.get_json_object(j, "$.session_id").alias("json_session"), r6(F.get_json_object(j, "$.overall.risk_score").cast("double"), "json_score"),
                         F.get_json_object(j, "$.n_segments").cast("long").alias("json_segments"), F.get_json_object(j, "$.top_risk_segments[0].segment_id").alias("json_top"))


@q("unpack_result_json", "tokens", f"""WITH {_LEX} SELECT session_id, segment_id, rn AS rank, {r('risk_score', 'risk_score')}, round(start_time, 6) AS start_time FROM {_TOP5} WHERE rn <= 5""")
def _(t):
    packed = reports.pack_json(analysed(t), "session_id")
    return reports.unpack_json(packed, "session_id").select("session_id", "segment_id", "rank", r6("risk_score"), r6("start_time"))


# for a 0/1 label the ANOVA F is r^2 (n - 2) / (1 - r^2), so it ranks as the correlation does
@q("feature_selection", "tokens", f"""WITH lex AS (SELECT CAST(role = 'assistant' AS INTEGER) AS y, duration, CAST(len(w) AS DOUBLE) AS word_count, {TTR} AS type_token_ratio, {AWL} AS avg_word_length,
        len(list_filter(w, lambda x: length(x) > 6)) / (len(w) + 1e-10) AS complex FROM toks),
    f AS (SELECT unnest({SEG}) AS feature, unnest([{', '.join(f'corr({c}, y)' for c in SEG)}]) AS x FROM lex)
    SELECT feature, row_number() OVER (ORDER BY abs(x) DESC) <= 3 AS selected, {r('x', 'r')} FROM f""")
def _(t):
    s = durable(labelled_segments(t), "segments")
    chosen = models.select_by_label(s, SEG, 3)
    return sessions.feature_quality(s, "label", SEG).select("feature", F.col("feature").isin(*chosen).alias("selected"), r6("r"))



