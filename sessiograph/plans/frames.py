"""Windows over segments and frames: counters, streaks, smoothing, episodes, turns, phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import face
from ..functions import text as tx
from ..operators import frames as fr
from ..operators import ordered, phrases, projections, ranking, series, windows
from ._sql import clamp, r
from .joins import PARTS_SQL, split_parts
from .registry import Registry, r6

registry = Registry()
q = registry.query
ID = ["session_id", "segment_idx"]
K, IDX = ["series_id"], "frame_idx"
KI = ["series_id", "frame_idx"]
W = "OVER (PARTITION BY series_id ORDER BY frame_idx"


def turn_chunk():
    return ordered.chunk_of("segment_idx", 4096)


@q("start_gap", "segments", f"""SELECT session_id, segment_idx, {r('start_time - lag(start_time) OVER w', 'start_gap')}, {r('start_time - lag(end_time) OVER w', 'pause')}
    FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY segment_idx)""")
def _(t):
    return windows.start_gap(t.segments, "session_id", ["segment_idx"], turn_chunk()).select(*ID, r6("start_gap"), r6("pause"))


@q("score_jump", "segments", f"SELECT session_id, segment_idx, {r('abs(score - lag(score) OVER (PARTITION BY session_id ORDER BY segment_idx))', 'jump')} FROM segments")
def _(t):
    return windows.score_jump(t.segments, "session_id", ["segment_idx"], turn_chunk()).select(*ID, r6("jump"))


def norm_sql(x, key, invert=False):
    o = f"OVER (PARTITION BY {key})"
    y = f"CASE WHEN min({x}) {o} IS NULL THEN 0 WHEN max({x}) {o} - min({x}) {o} <= 1e-8 + 1e-5 * abs(max({x}) {o}) THEN 0.5 ELSE coalesce(({x} - min({x}) {o}) / (max({x}) {o} - min({x}) {o}), 0) END"
    return f"(1 - {y})" if invert else y


@q("minmax_normalize", "frames", f"""WITH f AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS gappy, CASE WHEN series_id % 2 = 0 THEN 7.5 ELSE value END AS flat FROM frames)
    SELECT series_id, frame_idx, {r(norm_sql('gappy', 'series_id'), 'gappy_norm')}, {r(norm_sql('flat', 'series_id', True), 'flat_norm')} FROM f""")
def _(t):
    f = t.frames.withColumns({"gappy": F.when(F.col("event_type") != "error", F.col("value")), "flat": F.when(F.col("series_id") % 2 == 0, 7.5).otherwise(F.col("value"))})
    return windows.minmax_normalize(f, "series_id", IDX, {"gappy": False, "flat": True}).select(*KI, r6("gappy_norm"), r6("flat_norm"))


_VM = """vm AS (SELECT series_id, frame_idx, t, CASE WHEN event_type = 'error' THEN value / 40 END AS gaze_away_time, value / 150 AS head_down_duration,
    least(1, value / 90) AS head_stability, CASE WHEN event_type = 'click' THEN value / 60 END AS face_touch_count FROM frames)"""
_VS = [("gaze_away_time", 0.28, False), ("head_down_duration", 0.22, False), ("face_touch_count", 0.18, False), ("head_stability", 0.10, True)]
_VN = f"""WITH {_VM}, n AS (SELECT *, {', '.join(f"{norm_sql(c, 'series_id', inv)} AS n_{c}" for c, _, inv in _VS)} FROM vm),
    s AS (SELECT *, {' + '.join(f'n_{c} * {w}' for c, w, _ in _VS)} AS y FROM n)"""


def _video(t):
    from .sessions import video_metrics
    return video_metrics(t)


@q("video_risk_timeline", "frames", _VN + f" SELECT series_id, frame_idx, t AS x, {r(clamp('y'), 'y')} FROM s")
def _(t):
    return windows.video_risk(_video(t), "series_id", IDX).select(*KI, F.col("t").alias("x"), r6("y"))


@q("video_risk_markers", "frames", _VN + f""", k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(y, 12) DESC, frame_idx) AS rank FROM s),
    u AS (SELECT series_id, frame_idx, CAST(rank AS INTEGER) AS rank, y, unnest(['Gaze away', 'Head down', 'Face touch', 'Head stability']) AS feature,
        unnest([n_gaze_away_time, n_head_down_duration, n_face_touch_count, n_head_stability]) AS v, unnest([1, 2, 3, 4]) AS o FROM k WHERE rank <= 4),
    d AS (SELECT *, row_number() OVER (PARTITION BY series_id, rank ORDER BY v DESC, o) AS dr FROM u)
    SELECT series_id, frame_idx, rank, {r(clamp('y'), 'score')}, feature, {r('v', 'value')} FROM d WHERE dr <= 3 AND v > 0""")
def _(t):
    m = windows.video_risk_markers(_video(t), "series_id", IDX)
    e = m.select(*KI, "rank", r6("y", "score"), F.explode("top_signals").alias("s"))
    return e.select(*KI, "rank", "score", "s.feature", r6(F.col("s.value"), "value"))


_AC = [("pause_ratio", 0.35, False), ("speech_rate", 0.25, True), ("articulation_rate", 0.20, True), ("asr_conf_mean", 0.10, True)]
_ACSQL = f"""WITH a AS (SELECT session_id, segment_idx, start_time, end_time, score AS pause_ratio, len(w) / duration AS speech_rate, CASE WHEN score < 1 THEN len(w) / (duration * (1 - score)) ELSE 0 END AS articulation_rate,
        CASE WHEN segment_idx % 3 > 0 THEN CAST(len(list_distinct(lw)) AS DOUBLE) / len(w) END AS asr_conf_mean FROM toks),
    n AS (SELECT *, {', '.join(f"{norm_sql(c, 'session_id', inv)} AS n_{c}" for c, _, inv in _AC)} FROM a),
    s AS (SELECT *, {' + '.join(f'n_{c} * {w}' for c, w, _ in _AC)} AS y FROM n)"""


def _acoustic(t):
    s = t.segments.select(*ID, "start_time", "end_time", F.col("score").alias("pause_ratio"), tx.speech_rate("text", "duration").alias("speech_rate"),
                          tx.articulation_rate("text", "duration", "score").alias("articulation_rate"),
                          F.when(F.col("segment_idx") % 3 > 0, tx.type_token_ratio("text")).alias("asr_conf_mean"))
    return windows.acoustic_index(s, "session_id", "segment_idx")


@q("acoustic_index", "tokens", _ACSQL + f" SELECT session_id, segment_idx, {r('start_time + greatest(0, end_time - start_time) / 2', 'x')}, {r(clamp('y'), 'y')} FROM s")
def _(t):
    return _acoustic(t).select(*ID, r6("x"), r6("y"))


_PROF = _ACSQL + f""", p AS (SELECT session_id, avg(n_pause_ratio) AS pause_ratio, avg(n_speech_rate) AS speech_rate, avg(n_articulation_rate) AS articulation_rate,
    avg(n_asr_conf_mean) AS asr_conf_mean, avg({clamp('y')}) AS risk FROM s GROUP BY 1)"""


@q("acoustic_profile", "tokens", _PROF + f""" SELECT session_id, {', '.join(r(c, c, 9) for c, _, _ in _AC)}, CAST(0 AS DOUBLE) AS rms_mean, {r('risk', 'acoustic_risk', 9)} FROM p""")
def _(t):
    p = windows.acoustic_profile(_acoustic(t), "session_id", "segment_idx")
    return p.select("session_id", *[r6(c, digits=9) for c, _, _ in _AC], "rms_mean", r6("acoustic_risk", digits=9))


@q("acoustic_insights", "tokens", _PROF + """ SELECT session_id, concat_ws(' | ', CASE WHEN pause_ratio >= 0.55 THEN 'Long pauses are frequent in this interview.' END,
    CASE WHEN speech_rate >= 0.55 THEN 'Speech pace is slower than the rest of this session.' END, CASE WHEN articulation_rate >= 0.55 THEN 'Articulation becomes less fluent in several segments.' END,
    CASE WHEN asr_conf_mean >= 0.45 THEN 'Speech confidence drops in multiple transcript segments.' END, CASE WHEN risk < 0.35 THEN 'Acoustic pattern looks relatively stable across the session.' END) AS insights FROM p""")
def _(t):
    return windows.acoustic_profile(_acoustic(t), "session_id", "segment_idx").select("session_id", F.array_join("insights", " | ").alias("insights"))


@q("zscore_column", "", f"WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_id, {r('(value - m) / d', 'z')}, CAST(4 AS DOUBLE) AS flat FROM events, s")
def _(t):
    e = t.table("events").select("event_id", F.col("value").alias("z"), F.lit(4.0).alias("flat"))
    return projections.standard_score(e, ["z", "flat"]).withColumn("z", F.round("z", 6))


def gappy(t):
    """The contour with unvoiced frames as zeros."""
    return t.frames.withColumn("f0", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("level")))


GAPPY = "g AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE level END AS f0 FROM frames)"


@q("smooth_moving_average", "frames", f"""WITH {GAPPY} SELECT series_id, frame_idx, {r(f'avg(value) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'sma3')},
    {r(f'CASE WHEN f0 = 0 THEN 0 ELSE avg(CASE WHEN f0 <> 0 THEN f0 END) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END', 'sma3nz')} FROM g""")
def _(t):
    s = ordered.over_neighbours(gappy(t), K, IDX, lambda w: {"sma3": series.smooth_over(w, "value"), "sma3nz": series.smooth_over(w, "f0", no_zero=True)})
    return s.select(*KI, r6("sma3"), r6("sma3nz"))


def _delta_sql(x, half):
    near = f"{W} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    terms = [f"{n} * (coalesce(lead({x}, {n}) {W}), last({x}) {near}) - coalesce(lag({x}, {n}) {W}), first({x}) {near}))" for n in range(1, half + 1)]
    return f"({' + '.join(terms)}) / {2 * sum(n * n for n in range(1, half + 1))}"


_D = _delta_sql("value", 2)


@q("delta_regression", "frames", f"""WITH {GAPPY}, d AS (SELECT *, {_D} AS d, value - coalesce(lag(value) {W}), value) AS diff,
        least(abs(f0), abs(coalesce(lag(f0) {W}), f0))) = 0 AS touch, f0 - coalesce(lag(f0) {W}), f0) AS fdiff FROM g)
    SELECT series_id, frame_idx, {r('d', 'delta')}, {r('abs(d)', 'abs_delta')}, {r('greatest(d, 0)', 'half_delta')}, {r('CASE WHEN value <> 0 THEN d / value ELSE 0 END', 'rel_delta')},
    {r('diff', 'diff')}, {r('CASE WHEN touch THEN 0 ELSE fdiff END', 'voiced_diff')} FROM d""")
def _(t):
    modes = {"delta": "plain", "abs_delta": "abs", "half_delta": "halfwave", "rel_delta": "relative"}
    d = ordered.over_neighbours(gappy(t), K, IDX, lambda w: {
        **{name: series.delta_over(w, "value", mode=mode) for name, mode in modes.items()},
        "diff": series.delta_over(w, "value", 0), "voiced_diff": series.delta_over(w, "f0", 0, across_zero=False)}, 2, 2)
    return d.select(*KI, *[r6(c) for c in ("delta", "abs_delta", "half_delta", "rel_delta", "diff", "voiced_diff")])


@q("blink_count", "frames", f"""WITH e AS (SELECT *, CASE WHEN value / 100 < 0.21 AND coalesce(lag(value / 100) {W}), 1) >= 0.21 THEN 1 ELSE 0 END AS e FROM frames)
    SELECT series_id, frame_idx, CAST(sum(e) {W}) AS BIGINT) AS blink_count FROM e""")
def _(t):
    return fr.falling_edge_count(t.frames.withColumn("ear", F.col("value") / 100), K, IDX, "ear", 0.21).select(*KI, "blink_count")


@q("touch_count", "frames", f"""WITH e AS (SELECT *, CASE WHEN value > 60 AND NOT coalesce(lag(value > 60) {W}), false) THEN 1 ELSE 0 END AS e FROM frames)
    SELECT series_id, frame_idx, CAST(sum(e) {W}) AS BIGINT) AS face_touch_count FROM e""")
def _(t):
    return fr.rising_edge_count(t.frames, K, IDX, F.col("value") > 60).select(*KI, "face_touch_count")


@q("streak_duration", "frames", f"""SELECT series_id, frame_idx, {r(f'(frame_idx - coalesce(max(CASE WHEN value <= 40 THEN frame_idx END) {W}), -1)) / CAST(30 AS DOUBLE)', 'head_down_duration')} FROM frames""")
def _(t):
    s = fr.streak(t.frames, K, IDX, F.col("value") > 40, "n")
    return s.select(*KI, r6(F.col("n") / 30, "head_down_duration"))


@q("leaky_counter", "frames", f"""WITH s AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click', 'view') THEN 1 ELSE -1 END) {W}) AS s FROM frames)
    SELECT series_id, frame_idx, {r(f'(s - least(0, min(s) {W}))) / CAST(30 AS DOUBLE)', 'gaze_away_time')} FROM s""")
def _(t):
    return fr.leaky_counter(t.frames, K, IDX, F.col("event_type").isin("error", "click", "view")).select(*KI, r6("gaze_away_time"))


@q("exponential_smoothing", "frames", f"""WITH l AS (SELECT series_id, frame_idx, list(sqrt(value)) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM frames)
    SELECT series_id, frame_idx, {r('list_reduce(v, lambda y, x: 0.3 * x + 0.7 * y, CAST(0 AS DOUBLE))', 'smoothed')} FROM l""")
def _(t):
    return fr.exponential_smoothing(t.frames.withColumn("angle", F.sqrt("value")), K, IDX, "angle", "smoothed", 0.3).select(*KI, r6("smoothed"))


@q("rolling_stability", "frames", f"""WITH p AS (SELECT *, level / 200 AS x, sqrt(value + 1) / 300 AS y FROM frames),
    v AS (SELECT *, count(*) {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n, (var_pop(x) {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + var_pop(y) {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) / 2 AS v FROM p)
    SELECT series_id, frame_idx, {r('CASE WHEN n >= 5 THEN ' + clamp('1 - v * 100') + ' ELSE 1 END', 'head_stability')} FROM v""")
def _(t):
    p = t.frames.withColumns({"x": F.col("level") / 200, "y": F.sqrt(F.col("value") + 1) / 300})
    return fr.rolling_stability(p, K, IDX, "x", "y").select(*KI, r6("head_stability"))


@q("baseline_distance", "frames", f"""WITH b AS (SELECT series_id, CASE WHEN count(*) >= 11 THEN avg(value) END AS b FROM frames WHERE frame_idx < 11 GROUP BY 1)
    SELECT f.series_id, frame_idx, {r('b', 'baseline')}, {r('value / b', 'distance_ratio')} FROM frames f LEFT JOIN b ON b.series_id = f.series_id""")
def _(t):
    return fr.baseline_ratio(t.frames, K, IDX, "value").select(*KI, r6("baseline"), r6("distance_ratio"))


@q("label_run_duration", "frames", f"""WITH s AS (SELECT *, CASE WHEN frame_idx % 3 = 0 THEN event_type END AS e FROM frames),
    h AS (SELECT *, last(e IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM s),
    n AS (SELECT *, CASE WHEN cur IS DISTINCT FROM lag(cur) {W}) THEN t END AS t0 FROM h)
    SELECT series_id, frame_idx, cur AS emotion, {r(f't - last(t0 IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'emotion_duration')} FROM n""")
def _(t):
    s = fr.since_change(t.frames, K, IDX, F.col("event_type"), "t", 3)
    return s.select(*KI, F.col("current").alias("emotion"), r6("emotion_duration"))


@q("episodes_from_flags", "frames", f"""WITH f AS (SELECT *, value > 40 AS f, lead(t) {W}) AS nxt, coalesce(lag(value > 40) {W}), false) AS was FROM frames),
    n AS (SELECT *, sum(CASE WHEN f AND NOT was THEN 1 ELSE 0 END) {W}) AS run FROM f),
    e AS (SELECT series_id, run, min(t) AS s, arg_max(coalesce(nxt, t), frame_idx) AS e, arg_max(event_type, frame_idx) AS details FROM n WHERE f GROUP BY 1, 2)
    SELECT series_id, 'long_value' AS event, round_even(s, 2) AS start_time, round_even(e, 2) AS end_time, round_even(e - s, 2) AS duration, details FROM e""")
def _(t):
    return fr.episodes(t.frames, K, IDX, "t", F.col("value") > 40, "long_value", F.col("event_type"))


_STATE = f"""st0 AS (SELECT *, value > 40 AS head_down, event_type NOT IN ('error', 'click') AS looking, CASE WHEN event_type IN ('view', 'signup') THEN 'sad' ELSE 'happy' END AS emotion FROM frames),
    st AS (SELECT *, (frame_idx - coalesce(max(CASE WHEN NOT head_down THEN frame_idx END) {W}), -1)) / CAST(1 AS DOUBLE) AS hdd,
        (frame_idx - coalesce(max(CASE WHEN looking THEN frame_idx END) {W}), -1)) * CAST(2 AS DOUBLE) AS gat,
        (frame_idx - coalesce(max(CASE WHEN emotion <> 'sad' THEN frame_idx END) {W}), -1)) * CAST(3 AS DOUBLE) AS emd, least(1, value / 90) AS stab FROM st0)"""


def _risk_state(t):
    """Frames with the four states; seconds per frame are stretched so that short series reach the limits."""
    s = t.frames.withColumns({"head_down": F.col("value") > 40, "looking_at_camera": ~F.col("event_type").isin("error", "click"),
                              "emotion": F.when(F.col("event_type").isin("view", "signup"), "sad").otherwise("happy"),
                              "head_stability": F.least(F.lit(1.0), F.col("value") / 90)})
    s = fr.streaks(s, K, IDX, {"_h": F.col("head_down"), "_g": ~F.col("looking_at_camera"), "_e": F.col("emotion") == "sad"})
    return s.withColumns({"head_down_duration": F.col("_h") / 1.0, "gaze_away_time": F.col("_g") * 2.0, "emotion_duration": F.col("_e") * 3.0})


@q("risk_state_flags", "frames", f"""WITH {_STATE} SELECT series_id, frame_idx, head_down AND hdd >= 3 AS head_down_long, NOT looking AND gat >= 5 AS gaze_avoidance,
    emotion = 'sad' AND emd >= 5 AS long_sadness, stab < 0.5 AS low_head_stability, round_even(hdd, 2) AS shown FROM st""")
def _(t):
    return fr.risk_state_flags(_risk_state(t)).select(*KI, "head_down_long", "gaze_avoidance", "long_sadness", "low_head_stability",
                                                       F.col("payload").getItem("head_down_duration").alias("shown"))


@q("concurrent_risk_count", "frames", f"""WITH {_STATE} SELECT series_id, frame_idx, CAST(head_down AND hdd > 3 AS INTEGER) + CAST(NOT looking AND gat > 5 AS INTEGER)
    + CAST(emotion = 'sad' AND emd > 15 AS INTEGER) + CAST(stab < 0.5 AS INTEGER) AS risks FROM st""")
def _(t):
    s = _risk_state(t)
    return s.select(*KI, fr.concurrent_risks(s).alias("risks"))


@q("event_rate_per_minute", "frames", f"""WITH e AS (SELECT *, CASE WHEN value / 100 < 0.21 AND coalesce(lag(value / 100) {W}), 1) >= 0.21 THEN 1 ELSE 0 END AS e FROM frames)
    SELECT series_id, frame_idx, {r(f'CASE WHEN t > 0 THEN sum(e) {W}) / t * 60 ELSE 0 END', 'blink_rate')} FROM e""")
def _(t):
    s = fr.falling_edge_count(t.frames.withColumn("ear", F.col("value") / 100), K, IDX, "ear", 0.21)
    return s.select(*KI, r6(fr.event_rate(F.col("blink_count"), F.col("t")), "blink_rate"))


_TURNS = f"""WITH s AS (SELECT *, frame_idx - coalesce(max(CASE WHEN NOT value > 40 THEN frame_idx END) {W}), -1) = 3 AS turn_on, frame_idx - coalesce(max(CASE WHEN NOT value < 25 THEN frame_idx END) {W}), -1) = 2 AS turn_off FROM frames),
    e AS (SELECT *, CASE WHEN turn_on THEN 1 WHEN turn_off THEN 0 END AS ev FROM s),
    st AS (SELECT *, last(ev IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur, last(ev IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e),
    n AS (SELECT *, sum(CASE WHEN turn_on AND coalesce(was, 0) = 0 THEN 1 ELSE 0 END) {W}) AS turn, max(frame_idx) OVER (PARTITION BY series_id) AS mx FROM st),
    g AS (SELECT series_id, turn, min(frame_idx) - 2 AS first_frame, CASE WHEN max(frame_idx) < max(mx) THEN max(frame_idx) - 1 ELSE max(frame_idx) END AS last_frame FROM n WHERE cur = 1 GROUP BY 1, 2)"""


@q("turn_detection", "frames", _TURNS + """, p AS (SELECT series_id, turn, first_frame + piece * 8 AS first_frame, last_frame FROM (SELECT *, unnest(range(0, (last_frame - first_frame) // 8 + 1)) AS piece FROM g))
    SELECT series_id, CAST(turn AS BIGINT) AS turn, first_frame, least(first_frame + 7, last_frame) AS last_frame FROM p""")
def _(t):
    return fr.turns(t.frames, K, IDX, "value", 40.0, 25.0, 3, 2, max_frames=8).select("series_id", "turn", "first_frame", "last_frame")


@q("adaptive_threshold_gate", "frames", f"""WITH a AS (SELECT *, level AS gate, avg(level) {W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS th FROM frames)
    SELECT series_id, frame_idx, value, {r('th', 'threshold')} FROM a WHERE th IS NULL OR gate >= th""")
def _(t):
    return fr.adaptive_gate(t.frames.withColumn("gate", F.col("level")), K, IDX, "gate").select(*KI, "value", r6("threshold"))


@q("median_filter", "frames", f"SELECT series_id, frame_idx, {r(f'quantile_cont(value, 0.5) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'median')} FROM frames")
def _(t):
    return series.median_filter(t.frames, K, IDX, "value").select(*KI, r6("median"))


@q("short_long_trend", "frames", f"""WITH s AS (SELECT *, round(avg(value) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(value) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS s FROM frames)
    SELECT series_id, frame_idx, {r('s', 'score')}, CASE WHEN s > 0.5 THEN 1 WHEN s < -0.5 THEN -1 ELSE 0 END AS direction FROM s""")
def _(t):
    return series.trend(t.frames, K, IDX, "value", flat=0.5).select(*KI, r6("score"), "direction")


@q("answer_intervals", "segments", """WITH m AS (SELECT session_id, max(end_time) * 0.9 AS media_end FROM segments GROUP BY 1),
    l AS (SELECT s.session_id, segment_idx, end_time AS answer_start, lead(end_time) OVER (PARTITION BY s.session_id ORDER BY segment_idx) AS answer_end, media_end FROM segments s JOIN m ON m.session_id = s.session_id)
    SELECT session_id, segment_idx, round(answer_start, 6) AS answer_start, round(answer_end, 6) AS answer_end FROM l WHERE answer_start < answer_end AND answer_end <= media_end""")
def _(t):
    m = t.segments.groupBy("session_id").agg((F.max("end_time") * 0.9).alias("media_end"), F.max("segment_idx").alias("_top"))
    return windows.answer_intervals(ordered.attach(t.segments, m, ["session_id"], "segment_idx"), "session_id", "segment_idx", "media_end").select(*ID, r6("answer_start"), r6("answer_end"))


@q("first_per_session", "", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return ranking.first_rows(t.table("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@q("chunk_index", "frames", f"""WITH c AS (SELECT series_id, frame_idx, CAST(floor(t / CAST(0.16 AS DOUBLE)) AS BIGINT) AS chunk, max(t) OVER (PARTITION BY series_id) AS d FROM frames),
    b AS (SELECT *, chunk * CAST(0.16 AS DOUBLE) AS chunk_start, least((chunk + 1) * CAST(0.16 AS DOUBLE), d) AS chunk_end FROM c),
    k AS (SELECT * FROM b WHERE chunk_end > chunk_start)
    SELECT series_id, frame_idx, chunk, round(chunk_start, 6) AS chunk_start, round(chunk_end, 6) AS chunk_end FROM k""")
def _(t):
    return windows.chunk_index(t.frames, "series_id", "t", "frame_idx", 0.16).select(*KI, "chunk", r6("chunk_start"), r6("chunk_end"))


@q("split_long_segments", "segments", f"""WITH {PARTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY segment_idx, part) - 1 AS new_idx FROM bounds)
    SELECT session_id, segment_idx, session_id || '_segment_' || printf('%04d', new_idx) AS new_segment_id, round(part_start, 6) AS part_start, round(part_end, 6) AS part_end FROM n""")
def _(t):
    n = windows.renumber_parts(split_parts(t), "session_id", ["segment_idx", "part"], turn_chunk())
    return n.select(*ID, "new_segment_id", r6("part_start"), r6("part_end"))


# --- phrases -------------------------------------------------------------------------------------------

_PH = [["the"], ["of", "in", "and"], ["that", "is", "the", "with"]]
_PH2 = [["on", "in"], ["the", "ed", "er"]]


def word_rows(t):
    """Words of a session in one dense order."""
    w = t.words.withColumn("clean", tx.clean_text("word"))
    return ordered.dense_index(w, ["session_id"], ["segment_idx", "word_idx"], turn_chunk(), "pos")


_WR = r"""wr AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY segment_idx, word_idx) - 1 AS pos, word_start, word_end,
    regexp_replace(regexp_replace(regexp_replace(lower(word), '[.,!?;:“”"''—–\-«»]', '', 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS clean FROM words)"""


def _in(tokens):
    return "(" + ", ".join(f"'{x}'" for x in tokens) + ")"


def _chain_sql(name, phrase, gap):
    """Greedy chain: each next word is the first match within gap + 1 words."""
    sql = f"{name}_0 AS (SELECT session_id, pos AS first_pos, pos AS last_pos FROM wr WHERE clean IN {_in(phrase[0])})"
    for i, tokens in enumerate(phrase[1:], 1):
        sql += f""", {name}_{i} AS (SELECT p.session_id, p.first_pos, min(w.pos) AS last_pos FROM {name}_{i - 1} p JOIN wr w ON w.session_id = p.session_id
            AND w.pos > p.last_pos AND w.pos <= p.last_pos + {gap + 1} AND w.clean IN {_in(tokens)} GROUP BY 1, 2)"""
    return sql + f", {name} AS (SELECT session_id, min(first_pos) AS first_pos, arg_min(last_pos, first_pos) AS last_pos FROM {name}_{len(phrase) - 1} GROUP BY 1)"


@q("phrase_match_exact", "words", f"WITH {_WR}, {_chain_sql('a', _PH2, 0)} SELECT a.session_id, first_pos, last_pos FROM a")
def _(t):
    m = phrases.match(word_rows(t), "session_id", "pos", "clean", {"a": _PH2}, max_gap=0)
    return m.select("session_id", "first_pos", "last_pos")


@q("phrase_match_fuzzy", "words", f"WITH {_WR}, {_chain_sql('a', _PH, 3)} SELECT a.session_id, first_pos, last_pos FROM a")
def _(t):
    m = phrases.match(word_rows(t), "session_id", "pos", "clean", {"a": _PH}, max_gap=3)
    return m.select("session_id", "first_pos", "last_pos")


_ALT = [([["que"], ["la"]], [["de"], ["la"]]), ([["the"], ["of", "in"]], [["that"], ["the", "is"]]), ([["in"], ["the"]], [["the"], ["on"]])]


@q("passage_bounds", "words", f"WITH {_WR}, " + ", ".join(f"{_chain_sql(f's{i}', s, 3)}, {_chain_sql(f'e{i}', e, 3)}" for i, (s, e) in enumerate(_ALT))
   + ", c AS (" + " UNION ALL ".join(f"SELECT s{i}.session_id, {i} AS alt, s{i}.first_pos, e{i}.last_pos FROM s{i} JOIN e{i} ON e{i}.session_id = s{i}.session_id AND e{i}.last_pos >= s{i}.first_pos" for i in range(3))
   + """), b AS (SELECT session_id, min(alt) AS alt, arg_min(first_pos, alt) AS a, arg_min(last_pos, alt) AS z FROM c GROUP BY 1)
    SELECT b.session_id, alt, round(w1.word_start, 6) AS start_time, round(w2.word_end, 6) AS end_time FROM b JOIN wr w1 ON w1.session_id = b.session_id AND w1.pos = a JOIN wr w2 ON w2.session_id = b.session_id AND w2.pos = z""")
def _(t):
    return phrases.passage_bounds(word_rows(t), "session_id", "pos", "clean", "word_start", "word_end", _ALT, 3).select(
        "session_id", "alt", r6("start_time"), r6("end_time"))


# --- landmarks -----------------------------------------------------------------------------------------

_EYES = ([0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11])
_IRIS = ([12, 13, 14, 15, 16], [17, 18, 19, 20, 21])


def landmarks(t):
    """Embeddings read as 32 points (x, y); z is the x of the point 16 further on."""
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        F.get(F.col("vec"), 2 * i).alias("x"), F.get(F.col("vec"), 2 * i + 1).alias("y"), F.get(F.col("vec"), (2 * i + 32) % 64).alias("z")))
    return t.vectors.select("frame_idx", "vec", pts.alias("face"))


def _p(i):
    return f"vec[{2 * i + 1}]", f"vec[{2 * i + 2}]"


def _d(a, b, scale=1):
    (ax, ay), (bx, by) = _p(a), _p(b)
    return f"sqrt(power(({ax} - {bx}) * {scale}, 2) + power(({ay} - {by}) * {scale}, 2))"


def _ear(e):
    return f"(({_d(e[1], e[5])} + {_d(e[2], e[4])}) / (2 * {_d(e[0], e[3])}))"


@q("eye_aspect_ratio", "vectors", f"SELECT frame_idx, {r(f'({_ear(_EYES[0])} + {_ear(_EYES[1])}) / 2', 'ear')} FROM vectors")
def _(t):
    return landmarks(t).select("frame_idx", r6(face.eye_aspect_ratio("face", 1.0, 1.0, *_EYES), "ear"))


@q("eye_distance", "vectors", f"SELECT frame_idx, {r(_d(0, 6, 100), 'eye_distance')} FROM vectors")
def _(t):
    return landmarks(t).select("frame_idx", r6(face.eye_distance("face", 100.0, 100.0, 0, 6), "eye_distance"))


_POSE = {"nose": 1, "forehead": 2, "chin": 3, "left_eye": 4, "right_eye": 5, "left_ear": 6, "right_ear": 7}


def _z(i):
    return f"vec[{(2 * i + 32) % 64 + 1}]"


_clip = "greatest(-90, least(90, {}))"


@q("head_pose_angles", "vectors", f"""WITH a AS (SELECT frame_idx, ({_clip.format(f'({_z(7)} - {_z(6)}) * 500')} + ({_z(5)} - {_z(4)}) * 300) / 2 AS yaw,
        CASE WHEN {_p(3)[1]} > {_p(2)[1]} THEN ({_p(1)[1]} - {_p(2)[1]}) / ({_p(3)[1]} - {_p(2)[1]}) ELSE 0.5 END AS nose_at, {_clip.format(f'({_z(2)} - {_z(1)}) * 300')} AS p0,
        degrees(atan2({_p(5)[1]} - {_p(4)[1]}, {_p(5)[0]} - {_p(4)[0]})) AS roll FROM vectors),
    b AS (SELECT *, p0 + CASE WHEN nose_at < 0.4 THEN -20 WHEN nose_at > 0.6 THEN 20 ELSE 0 END AS pitch FROM a)
    SELECT frame_idx, {r('yaw', 'yaw')}, {r('pitch', 'pitch')}, {r('roll', 'roll')}, pitch < -15 AS head_down FROM b""")
def _(t):
    pose = face.head_pose("face", _POSE)
    return landmarks(t).select("frame_idx", *[r6(c, n) for n, c in pose.items()], (pose["pitch"] < -15).alias("head_down"))


def _mean(points, k):
    return "(" + " + ".join(_p(i)[k] for i in points) + f") / {len(points)}"


_GX, _GY = [f"(({_mean(_IRIS[0], k)} - {_mean(_EYES[0], k)}) + ({_mean(_IRIS[1], k)} - {_mean(_EYES[1], k)})) / 2 * 100" for k in (0, 1)]


@q("gaze_class", "vectors", f"""WITH g AS (SELECT frame_idx, {_GX} AS x, {_GY} AS y FROM vectors)
    SELECT frame_idx, CASE WHEN abs(x) < 5 AND abs(y) < 5 THEN 'center' WHEN x > 5 THEN 'right' WHEN x < -5 THEN 'left' WHEN y > 5 THEN 'down' WHEN y < -5 THEN 'up' END AS gaze FROM g""")
def _(t):
    return landmarks(t).select("frame_idx", face.gaze_class("face", 100.0, 100.0, _EYES, _IRIS).alias("gaze"))


_CX, _CY = (_mean([0, 1, 2, 3], 0), _mean([0, 1, 2, 3], 1))


@q("hand_face_contact", "vectors", f"""WITH c AS (SELECT frame_idx, vec, {_CX} AS cx, {_CY} AS cy FROM vectors),
    d AS (SELECT *, greatest({', '.join(f'sqrt(power({_p(i)[0]} - cx, 2) + power({_p(i)[1]} - cy, 2))' for i in range(4))}) * 1.2 * 0.4 AS rad,
        least({', '.join(f'sqrt(power({_p(i)[0]} - cx, 2) + power({_p(i)[1]} - cy, 2))' for i in range(24, 32))}) AS nearest FROM c)
    SELECT frame_idx, nearest < rad AS touching FROM d""")
def _(t):
    hands = F.slice("face", 25, 8)
    return landmarks(t).select("frame_idx", face.hand_face_contact("face", hands, 1.0, 1.0, [0, 1, 2, 3], 1.2 * 0.4).alias("touching"))


@q("emotion_argmax", "vectors", """WITH s AS (SELECT frame_idx, [vec[1] * 100, (vec[3] + vec[2]) * 50, vec[4] * 100, vec[5] * 100, vec[6] * 100, vec[7] * 100, vec[8] * 100] AS s FROM vectors)
    SELECT frame_idx, ['angry', 'disgust', 'fear', 'happy', 'neutral', 'sad', 'surprise'][list_position(s, list_max(s))] AS emotion FROM s""")
def _(t):
    return t.vectors.select("frame_idx", face.dominant_emotion("vec").alias("emotion"))
