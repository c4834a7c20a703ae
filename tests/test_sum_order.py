"""Verdicts at exactly a limit do not hang on the order in which rows arrive."""

from pyspark.sql import functions as F

from sessiograph.operators import ordered, reports, scoring, series, windows


def backwards(spark, values, schema):
    """One series whose rows lie in falling order."""
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)][::-1], schema).coalesce(1)


def left_to_right(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def test_acoustic_profile_adds_in_segment_order(spark):
    scores = [0.95, 0.6, 0.21, 0.96, 0.03]
    df = backwards(spark, scores, "session_id int, segment_idx long, pause_ratio_norm double").withColumns(
        {**{f"{c}_norm": F.lit(0.0) for c in ("speech_rate", "articulation_rate", "asr_conf_mean", "rms_mean")}, "y": F.lit(0.5)})
    row = windows.acoustic_profile(df, "session_id", "segment_idx").first()
    assert row.pause_ratio == left_to_right(scores) < 0.55 <= left_to_right(scores[::-1]) and row.insights == []


def test_moments_over_chunks(spark):
    values = [None if i % 5 == 3 else i % 7 / 10 for i in range(23)]
    known = [v for v in values if v is not None]
    df = backwards(spark, values, "k int, i long, v double").unionByName(spark.createDataFrame([(2, 0, None)], "k int, i long, v double"))
    got = {r.k: r for r in ordered.moments(df, ["k"], ["i"], ordered.chunk_of("i", 4), {"v": F.col("v")}, ("v",)).collect()}
    mean = sum(known) / len(known)
    assert got[1].n == 23 and abs(got[1].v - mean) < 1e-12 and abs(got[1].v_std - (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5) < 1e-12
    assert got[2].n == 1 and got[2].v is None and got[2].v_std is None


def test_trend_is_judged_to_nine_places(spark):
    values = [0.73, 2.77, 0.45, 0.52, 1.21, 2.97, 2.67, 1.61, 0.89, 2.68, 2.04, 2.36, 1.08, 2.21, 1.69, 2.55, 2.68, 2.95, 2.21, 1.57]
    assert left_to_right(values[-5:]) - left_to_right(values) > 0.5
    last = series.trend(backwards(spark, values, "s int, i long, v double"), ["s"], "i", "v", flat=0.5).orderBy(F.desc("i")).first()
    assert last.score == 0.5 and last.direction == 0


def test_chunk_means_add_in_frame_order(spark):
    values = [0.42, 1.0, 0.36, 0.34, 0.29, 0.49, 0.0, 0.95, 0.52, 0.37, 0.34, 0.96, 0.11, 0.64, 0.71]
    chunks = ordered.moments(backwards(spark, values, "s int, i long, p double").withColumn("chunk", F.lit(0)), ["s", "chunk"], ["i"], F.lit(0), {"p": F.col("p")})
    row = reports.chunk_summary(chunks, "s", "chunk", "p").first()
    assert row.probability == left_to_right(values) < 0.5 <= left_to_right(values[::-1])
    assert (row.chunks_used, row.positive_ratio, row.prediction, row.risk_level) == (1, 0.0, 0, "medium")


def test_deception_score_adds_in_segment_order(spark):
    scores = [(i * 37 % 101) / 100 for i in range(60)]
    n = mean = squares = 0.0
    for x in scores:
        n, d = n + 1, x - mean
        mean += d / n
        squares += (x - mean) * d
    want = 0.5 * left_to_right(scores) + 0.35 * (squares / n) ** 0.5 + 0.15 * (sum(x >= 0.6 for x in scores) / n)
    df = backwards(spark, scores, "session_id int, segment_idx long, score double").repartition(4, "segment_idx")
    row = scoring.deception_score(df, "session_id", "segment_idx").first()
    assert row.deception_score == want and row.segments_used == 60


def test_a_mean_at_the_limit_is_positive(spark):
    scores = {"a": 0.58, "b": 0.74, "c": 0.18}
    assert left_to_right(scores.values()) < 0.5
    rows = [(1, m, s, int(s >= 0.5), True) for m, s in scores.items()]
    row = scoring.ensemble(spark.createDataFrame(rows, "s int, model string, score double, prediction int, success boolean"), "s").first()
    assert (row.prediction, row.risk_level, row.n_models) == (1, "high", 3) and row.individual_scores == scores
