"""Edge cases of the scalar rules, statistics, scores and reports."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sessiograph.functions import scalars as sc
from sessiograph.functions import text as tx
from sessiograph.functions import vectors as vec
from sessiograph.operators import folds, frames, joins, metrics, phrases, projections, scoring, series, sessions, windows
from sessiograph.sources import media, tables, transcripts

NAN, INF = float("nan"), float("inf")


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).collect()[0].y


@pytest.mark.parametrize("value,want", [(None, 0.0), (NAN, 0.0), (INF, 0.0), (-INF, 0.0), (-1.0, 0.0), (0.3, 0.3), (7.0, 1.0)])
def test_clamp(spark, value, want):
    assert one(spark, sc.clamp01("x"), value, "double") == want


@pytest.mark.parametrize("value,want", [("1.5", 1.5), ("nan", None), ("inf", None), ("abc", None), (None, None), ("", None)])
def test_to_number(spark, value, want):
    assert one(spark, sc.to_number("x"), value, "string") == want


def test_bands_on_their_edges(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.3,), (0.6,), (0.59,), (0.69,), (None,)], "s double")
    got = [(r.o, r.g, r.n) for r in df.select(sc.risk_level("s").alias("o"), sc.risk_level("s", "segment").alias("g"), sc.risk_level("s", "session").alias("n")).collect()]
    assert got == [("medium", "medium", "low"), ("high", "medium", "low"), ("low", "medium", "low"), ("high", "high", "medium"),
                   ("high", "medium", "medium"), ("high", "high", "high"), (None, None, None)]


def test_text_functions(spark):
    text = " Я не знаю,  я устал! Да? "
    df = spark.createDataFrame([(text,), ("",), (None,)], "x string")
    r = df.select(tx.word_count("x").alias("n"), tx.type_token_ratio("x").alias("t"), tx.pronoun_count("x").alias("p"), tx.negation_count("x").alias("neg"),
                  tx.sentence_count("x").alias("s"), tx.avg_word_length("x").alias("a"), tx.clean_text("x").alias("c"), tx.speech_rate("x", F.lit(0.0)).alias("r")).collect()
    assert (r[0].n, r[0].p, r[0].neg, r[0].s, r[0].r) == (6, 2, 1, 3, 0.0)
    assert math.isclose(r[0].t, 5 / 6) and r[0].c == "я не знаю  я устал да"
    assert (r[1].n, r[1].t, r[1].a, r[2].n, r[2].s) == (0, 0.0, 0.0, 0, 1)


def test_pause_ratio(spark):
    words = "array<struct<start:double,end:double>>"
    df = spark.createDataFrame([([(0.0, 1.0), (2.0, 1.5), (None, 3.0)], 0.0, 4.0), ([], 0.0, 4.0), (None, 0.0, 4.0), ([(0.0, 9.0)], 0.0, 4.0), ([(0.0, 1.0)], 4.0, 4.0)],
                               f"w {words}, a double, b double")
    assert [r.p for r in df.select(tx.pause_ratio("w", "a", "b").alias("p")).collect()] == [0.75, 0.0, 0.0, 0.0, 0.0]


def test_names_and_times(spark):
    df = spark.createDataFrame([("0_a (2)", "A-b.(1)", 3661.0), ("b_transcript", "x__y", 59.9)], "f string, p string, t double")
    r = df.select(sc.base_session_id("f").alias("f"), sc.normalize_subject("p").alias("p"), sc.format_time("t").alias("t"), sc.subject_candidates("p").alias("c")).collect()
    assert (r[0].f, r[0].p, r[0].t) == ("a", "a_b_1", "01:01:01") and (r[1].f, r[1].p, r[1].t) == ("b", "x_y", "00:59")
    assert r[0].c[0] == "A-b.(1)" and "A_b" in r[0].c


def test_probability_forms(spark):
    df = spark.createDataFrame([([0.3, 0.7],), ([0.0, math.log(3)],), ([0.2],), ([2.0],), ([1.0, 2.0, 3.0],)], "s array<double>")
    got = [r.p for r in df.select(vec.positive_probability("s").alias("p")).collect()]
    assert got[0] == 0.7 and math.isclose(got[1], 0.75) and got[2] == 0.2 and math.isclose(got[3], 1 / (1 + math.exp(-2))) and got[4] is None


def test_session_stats_skip_nan_and_fill(spark):
    df = spark.createDataFrame([("a", 1.0, NAN, 1), ("a", 3.0, None, 0), ("b", 5.0, NAN, 1)], "s string, x double, y double, i int")
    got = {r.s: r for r in sessions.session_stats(df, ["s"], ["x", "y"], "audio_", population=True, zero_empty=True, aggs=[sessions.first_by("x", "i").alias("first")]).collect()}
    a, b = got["a"], got["b"]
    assert (a.audio_x_mean, a.audio_x_std, a.audio_x_median, a.audio_y_mean, a.audio_y_median, a.first) == (2.0, 1.0, 2.0, 0.0, 0.0, 3.0)
    assert (b.audio_x_std, b.audio_y_std) == (0.0, 0.0)
    text = {r.s: r for r in sessions.session_stats(df, ["s"], ["x"], "text_", population=False, zero_empty=False).collect()}
    assert math.isclose(text["a"].text_x_std, math.sqrt(2)) and text["b"].text_x_std is None


def test_session_text_is_whole(spark):
    df = spark.createDataFrame([("s", i, f" w{i} " if i % 3 else "  ") for i in range(10)], "s string, i long, text string")
    assert [r.full_text for r in sessions.session_text(df, "s", "i", part_segments=4).collect()] == ["w1 w2 w4 w5 w7 w8"]
    long = spark.range(5000).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.concat(F.lit("w"), "id").alias("text"))
    assert sessions.session_text(long, "s", "i").first().full_text == " ".join(f"w{i}" for i in range(5000))


def test_tolerance_join_keeps_equal_rows(spark):
    left = spark.createDataFrame([("s", 1.0, 2.0, "a"), ("s", 1.0, 2.0, "a"), ("s", 5.0, 6.0, "b")], "session_id string, start_time double, end_time double, x string")
    right = spark.createDataFrame([("s", 1.001, 2.001, 0.5)], "session_id string, start_time double, end_time double, pause_ratio double")
    got = sorted((r.x, r.pause_ratio or 0.0) for r in joins.tolerance_join(left, right, "session_id").collect())
    assert got == [("a", 0.5), ("a", 0.5), ("b", 0.0)]


def test_label_mismatch_stops(spark):
    a, b = spark.createDataFrame([("s", 0)], "id string, label int"), spark.createDataFrame([("s", 1)], "id string, label int")
    with pytest.raises(Exception, match="label mismatch"):
        sessions.merge_modalities(a, b, "id").collect()
    assert sessions.merge_modalities(a, a, "id").collect()[0].label == 0


def test_minmax_rules(spark):
    df = spark.createDataFrame([("a", 0, 1.0, None), ("a", 1, 3.0, None), ("a", 2, None, None), ("b", 0, 2.0, 5.0), ("b", 1, 2.0, NAN)], "s string, i long, x double, y double")
    got = {(r.s, r.i): (r.x_norm, r.y_norm) for r in windows.minmax_normalize(df, "s", "i", {"x": False, "y": True}).collect()}
    assert got == {("a", 0): (0.0, 1.0), ("a", 1): (1.0, 1.0), ("a", 2): (0.0, 1.0), ("b", 0): (0.5, 0.5), ("b", 1): (0.5, 0.5)}


def test_deception_window_fallback(spark):
    df = spark.createDataFrame([("a", 0, 5.0, 0.9), ("a", 1, 20.0, 0.1), ("b", 0, 1.0, 0.7), ("b", 1, 2.0, None)], "s string, i long, duration double, score double")
    got = sorted((r.s, r.i) for r in projections.duration_window(df, "s", "i").collect())
    assert got == [("a", 0), ("b", 0)]


def test_text_anomaly_of_empty_session(spark):
    df = spark.createDataFrame([("a", "  "), ("b", "spam spam spam!")], "s string, text string")
    got = {r.s: r for r in scoring.text_anomaly_score(df, "s").collect()}
    assert math.isclose(got["a"].anomaly_score, 0.8) and got["a"].prediction_label == "anomaly" and got["b"].word_count == 3
    assert math.isclose(got["b"].repetition_ratio, 2 / 3)


def test_audio_anomaly_short_session(spark):
    df = spark.createDataFrame([("a", 0, 0.1, 1.0), ("a", 5, 0.9, 1.0), ("b", 0, 0.4, 2.0)], "s string, i long, score double, duration double")
    got = {r.s: r for r in scoring.audio_anomaly_score(df, "s", "i", F.floor(F.col("i") / 2)).collect()}
    assert got["a"].jump_ratio == 1.0 and math.isclose(got["a"].anomaly_score, 0.4 * 0.4 + 0.2 + 0.1)
    assert got["b"].jump_ratio == 0.0 and math.isclose(got["b"].anomaly_score, 0.1)


def test_ensemble_cases(spark):
    rows = [("none", "nlp", False, 0.9, 1), ("one", "nlp", True, 0.65, 0), ("all", "nlp", True, 0.2, 0), ("all", "cv", True, 0.9, 1), ("nan", "cv", True, NAN, 1)]
    df = spark.createDataFrame(rows, "s string, model string, success boolean, score double, prediction int")
    got = {r.s: r for r in scoring.ensemble_with_fallback(df.select("s").distinct(), df, "s").collect()}
    assert (got["none"].ensemble_score, got["none"].source, got["nan"].success) == (None, "none", False)
    assert (got["one"].prediction, got["one"].risk_level, got["one"].source, got["one"].agreement) == (0, "medium", "nlp", True)
    assert math.isclose(got["all"].ensemble_score, 0.55) and got["all"].risk_level == "high" and not got["all"].agreement


def test_video_failure_scores_one(spark):
    frames_ = spark.createDataFrame([("a", 6.0, 0.9)], "s string, gaze_away_time double, head_stability double")
    all_ = spark.createDataFrame([("a", 0.5), ("b", None)], "s string, model_prob double")
    got = {r.s: r.anomaly_score for r in scoring.video_anomaly_score(all_, scoring.video_anomaly_indicators(frames_, "s"), "s").collect()}
    assert math.isclose(got["a"], 0.7 * 0.2 + 0.15) and got["b"] == 1.0


def test_metrics_small(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert math.isclose(metrics.roc_auc(df, []).collect()[0].roc_auc, 0.625)
    assert math.isclose(metrics.average_precision(df, []).collect()[0].average_precision, 0.5 * 0.5 + 0.5 * 2 / 3)
    same = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    assert metrics.roc_auc(same, []).collect()[0].roc_auc is None
    best = metrics.grid_f1(df, [], [0.3, 0.5, 0.95]).collect()[0]
    assert best.threshold == 0.3 and math.isclose(best.f1, 0.8)


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(f"s{i % 40}", i % 2 if i % 40 < 20 else 1) for i in range(400)], "g string, label int")
    for out in (folds.group_kfold(df, "g"), folds.stratified_group_kfold(df, "g", "label", 5)):
        per = out.groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
        assert all(r.n == 1 for r in per)
    split = folds.group_train_test(df, "g", "label").groupBy("g").agg(F.min("split").alias("a"), F.max("split").alias("b")).collect()
    assert all(r.a == r.b for r in split) and sum(r.a == "test" for r in split) in (8, 9)


def test_fuzzy_gap_limits(spark):
    def words(text):
        return spark.createDataFrame([("s", i, w) for i, w in enumerate(text.split())], "s string, i long, w string")
    phrase = {"p": [["how"], ["are", "is"]]}
    assert phrases.match(words("how a b c are"), "s", "i", "w", phrase, 3).collect()[0].last_pos == 4
    assert phrases.match(words("how a b c d are"), "s", "i", "w", phrase, 3).collect() == []
    r = phrases.match(words("how x x x x how is"), "s", "i", "w", phrase, 3).collect()[0]
    assert (r.first_pos, r.last_pos) == (5, 6)
    assert phrases.match(words("a how"), "s", "i", "w", phrase, 3).collect() == []


def test_episode_open_at_end(spark):
    df = spark.createDataFrame([("s", i, i / 10, f, i) for i, f in enumerate([True, True, False, None, True])], "s string, i long, t double, f boolean, p long")
    got = sorted((r.start_time, r.end_time, r.details) for r in frames.episodes(df, ["s"], "i", "t", F.col("f"), "e", F.col("p")).collect())
    assert got == [(0.0, 0.2, 1), (0.4, 0.4, 4)]


def test_functionals_on_edge_series(spark):
    rows = [("zero", i, 0.0) for i in range(4)] + [("one", 0, 2.0)] + [("up", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    m = {r.s: r for r in df.groupBy("s").agg(*[c.alias(n) for n, c in series.means(F.col("v")).items()]).collect()}
    assert (m["zero"].nnz, m["zero"].nzgmean, m["zero"].flatness) == (0, None, None) and math.isclose(m["one"].nzgmean, 2.0)
    lin = {r.s: r for r in series.linear_regression(df, ["s"], "i", "v").collect()}
    assert (lin["up"].slope, lin["one"].slope, lin["zero"].error_abs) == (1.0, 0.0, 0.0)
    quad = {r.s: r for r in series.quadratic_regression(df, ["s"], "i", "v").collect()}
    assert abs(quad["up"].a) < 1e-12 and math.isclose(quad["up"].b, 1.0) and quad["one"].c == 2.0
    seg = {r.s: r for r in series.segments_by_value(df, ["s"], "i", F.col("v") > 1, 10.0).collect()}
    assert (seg["zero"].num_segments, seg["up"].num_segments, seg["up"].mean_len) == (0, 1, 0.3)


def test_media_listing_and_conflicts(spark, tmp_path):
    for p in ("0/a.mp4", "1/a.WAV", "0/b.wav", "0/b.mp4", "x/c.wav", "1/d.txt", "1/e.f.mov"):
        f = tmp_path / "audio" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    listing = media.list_files(spark, str(tmp_path / "audio"))
    found = media.samples(media.labelled_media(listing))
    assert sorted((r.label, r.file_id) for r in found.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "e.f")]
    scripts = spark.createDataFrame([("a", 0)], "file_id string, label int")
    got = {r.file_id: (r.label, r.conflict) for r in media.resolve_label_conflicts(found, scripts).collect()}
    assert got["a"] == (0, True) and got["b"] == (0, False)
    assert {r.file_id for r in media.needs_conversion(found).collect()} >= {"e.f"}


def test_transcript_files(spark, tmp_path):
    doc = {"segments": [{"start": 1, "end": "2.5", "text": " hi ", "words": [{"word": "hi", "start": 1.0, "end": 2.0}]}, {"id": "x", "start": "bad", "text": None}, {"end": -1}]}
    (tmp_path / "s1.json").write_text(json.dumps(doc, indent=1))
    read = transcripts.scan_transcripts(spark, str(tmp_path)).withColumn("id", sc.file_stem("file_path"))
    got = [(r.segment_id, r.start_time, r.end_time, r.duration, r.text) for r in transcripts.explode_segments(read, "id").orderBy("pos").collect()]
    assert got == [("transcript_segment_0000", 1.0, 2.5, 1.5, "hi"), ("x", 0.0, 0.0, 0.0, ""), ("transcript_segment_0002", 0.0, -1.0, 0.0, "")]


def test_arff_round_trip_and_unknowns(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% note\n@relation r\n@attribute name string\n@attribute F0 numeric\n@attribute hnr numeric\n@data\n'x',1.5,?\n'y',nan,2\n")
    got = [tuple(r) for r in tables.arff_ingest(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("x", 1.5, None), ("y", None, 2.0)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "s string, v long")
    new = spark.createDataFrame([("b", 9, "n")], "s string, v long, note string")
    first = tables.upsert_by_session(old, new, "s")
    again = tables.upsert_by_session(first, new, "s")
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str) == [("a", 1, None), ("b", 9, "n")]
