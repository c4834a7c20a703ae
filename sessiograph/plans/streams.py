"""Streams over the stored tables as file sources; results equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..sources import media
from ..streaming import jobs, state
from ._sql import r
from .frames import W
from .registry import Registry, r6

registry = Registry()
q = registry.query

#: The stored events are hours apart: six hours of the table are one second of recording, counted from START (microseconds).
SLOWER, START = 21_600, 1_704_067_200_000_000
RECORDED_SQL = f"{START} + (epoch_us(ts) - {START}) // {SLOWER}"


def recorded(ts):
    """Recording time of an event as an instant, the same in every session time zone."""
    return F.timestamp_micros((F.lit(START) + F.floor((F.unix_micros(jobs.event_time(ts)) - START) / SLOWER)).cast("long"))


def event_stream(t):
    """Events as a stream, with their recording time."""
    src = jobs.file_stream(t.spark, f"{t.dir}/events.parquet", t.table("events").schema)
    return src.withColumns({"series_id": F.col("user_id"), "at": recorded("ts")})


def delay(t):
    """Files may come in any order, so a row may be as late as the table is long."""
    return jobs.span(t.table("events").select(recorded("ts").alias("at")), "at")


#: Seconds of recording that are buffered, sorted and released together.
SLOT = 60.0
W2 = "OVER (PARTITION BY series_id, stretch ORDER BY frame_idx"


@q("stream_new_media", "listing media scripts", "SELECT listing_id, file_id, label FROM media WHERE file_id NOT IN (SELECT file_id FROM scripts)")
def _(t):
    src = jobs.file_stream(t.spark, f"{t.dir}/orders.parquet", t.table("orders").schema)
    ext = F.element_at(F.create_map(*[F.lit(x) for kv in _EXT.items() for x in kv]), F.col("o_orderpriority"))
    folder = F.when(F.col("o_orderstatus") == "F", "0").when(F.col("o_orderstatus") == "O", "1").otherwise("draft")
    listing = src.select(F.col("o_orderkey").alias("listing_id"), F.concat(F.lit("audio_wav/"), folder, F.lit("/rec_"), F.col("o_custkey").cast("string"), F.lit("."), ext).alias("path"))
    return jobs.new_media(media.labelled_media(listing), t.transcript_listing, "file_id").select("listing_id", "file_id", "label")


_EXT = {"1-URGENT": "mp4", "2-HIGH": "WAV", "3-MEDIUM": "mov", "4-NOT SPECIFIED": "txt", "5-LOW": "wav"}


@q("stream_upsert_features", "", """SELECT user_id, event_id, value FROM events
    UNION ALL SELECT c_custkey, CAST(0 AS BIGINT), c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def _(t):
    initial = t.table("customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"))
    return jobs.upsert_features(event_stream(t).select("user_id", "event_id", "value"), initial, "user_id")


@q("stream_episodes", "frames", f"""WITH f AS (SELECT *, value > 40 AS f, lead(frame_idx) {W}) AS nxt, coalesce(lag(value > 40) {W}), false) AS was FROM frames),
    n AS (SELECT *, sum(CASE WHEN f AND NOT was THEN 1 ELSE 0 END) {W}) AS run FROM f)
    SELECT series_id, min(frame_idx) AS first_frame, arg_max(coalesce(nxt, frame_idx), frame_idx) AS end_frame, arg_max(event_type, frame_idx) AS details FROM n WHERE f GROUP BY series_id, run""")
def _(t):
    s = event_stream(t).select("series_id", "at", "event_id", (F.col("value") > 40).alias("loud"), "event_type")
    return state.episodes(s, "series_id", "at", ["event_id"], "loud", "event_type", delay=delay(t), slot=SLOT).select("series_id", "first_frame", "end_frame", "details")


@q("stream_frame_state", "frames", f"""WITH b AS (SELECT *, level / 22 AS ear, event_type IN ('error', 'click', 'view') AS away FROM frames),
    e AS (SELECT *, CASE WHEN ear < 0.21 AND coalesce(lag(ear) {W}), 1) >= 0.21 THEN 1 ELSE 0 END AS e, sum(CASE WHEN away THEN 1 ELSE -1 END) {W}) AS s,
        frame_idx - coalesce(max(CASE WHEN NOT away THEN frame_idx END) {W}), -1) AS run, list(ear) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM b)
    SELECT series_id, frame_idx, CAST(sum(e) {W}) AS BIGINT) AS blink_count, {r('run / CAST(30 AS DOUBLE)', 'streak')}, {r(f'(s - least(0, min(s) {W}))) / CAST(30 AS DOUBLE)', 'gaze_away_time')},
    {r('list_reduce(v, lambda y, x: 0.3 * x + 0.7 * y, CAST(0 AS DOUBLE))', 'smoothed')} FROM e""")
def _(t):
    s = event_stream(t).select("series_id", "at", "event_id", (F.sqrt("value") / 22).alias("ear"), F.col("event_type").isin("error", "click", "view").alias("away"))
    out = state.frame_state(s, "series_id", "at", ["event_id"], "ear", "away", delay=delay(t), slot=SLOT)
    return out.select("series_id", "frame_idx", "blink_count", r6("streak"), r6("gaze_away_time"), r6("smoothed"))


@q("stream_turns", "", f"""WITH f0 AS (SELECT user_id AS series_id, event_id, ts, value, {RECORDED_SQL} AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events),
    f1 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY series_id ORDER BY frame_idx) > 2000000 THEN 1 ELSE 0 END AS cut FROM f0),
    frames AS (SELECT *, sum(cut) OVER (PARTITION BY series_id ORDER BY frame_idx) AS stretch FROM f1),
    s AS (SELECT *, frame_idx - coalesce(max(CASE WHEN NOT value > 40 THEN frame_idx END) {W2}), min(frame_idx) {W2}) - 1) = 2 AS turn_on,
        frame_idx - coalesce(max(CASE WHEN NOT value < 25 THEN frame_idx END) {W2}), min(frame_idx) {W2}) - 1) = 2 AS turn_off FROM frames),
    e AS (SELECT *, CASE WHEN turn_on THEN 1 WHEN turn_off THEN 0 END AS ev FROM s),
    st AS (SELECT *, last(ev IGNORE NULLS) {W2} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur, last(ev IGNORE NULLS) {W2} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e),
    n AS (SELECT *, sum(CASE WHEN turn_on AND coalesce(was, 0) = 0 THEN 1 ELSE 0 END) {W2}) AS turn, max(frame_idx) OVER (PARTITION BY series_id, stretch) AS mx FROM st)
    SELECT series_id, min(frame_idx) - 1 AS first_frame, CASE WHEN max(frame_idx) < max(mx) THEN max(frame_idx) - 1 ELSE max(frame_idx) END AS last_frame FROM n WHERE cur = 1 GROUP BY series_id, stretch, turn""")
def _(t):
    s = event_stream(t).select("series_id", "at", "event_id", "value")
    return state.turns(s, "series_id", "at", ["event_id"], "value", 40.0, 25.0, 2, 2, timeout=2.0, delay=delay(t), slot=SLOT).select("series_id", "first_frame", "last_frame")


_AGG = ", ".join([r("avg(level)", "mean"), r("stddev_pop(level)", "std"), r("min(level)", "min"), r("max(level)", "max")])


def _rounded(df, keys):
    return df.select(*keys, "window_start", "n", *[r6(c) for c in ("mean", "std", "min", "max")])


@q("stream_tumbling_functionals", "", f"""WITH f AS (SELECT event_type, sqrt(value) AS level, ({RECORDED_SQL}) // 4000000 * 4000 AS window_start FROM events)
    SELECT event_type, window_start, count(*) AS n, {_AGG} FROM f GROUP BY 1, 2""")
def _(t):
    s = event_stream(t).select("event_type", "at", F.sqrt("value").alias("level"))
    return _rounded(jobs.windowed_functionals(s, ["event_type"], "at", "level", "4 seconds", watermark=delay(t)), ["event_type"])


@q("stream_sliding_functionals", "", f"""WITH f AS (SELECT event_type, sqrt(value) AS level, (({RECORDED_SQL}) // 500000 - unnest(range(0, 4))) * 500 AS window_start FROM events)
    SELECT event_type, window_start, count(*) AS n, {_AGG} FROM f GROUP BY 1, 2""")
def _(t):
    s = event_stream(t).select("event_type", "at", F.sqrt("value").alias("level"))
    return _rounded(jobs.windowed_functionals(s, ["event_type"], "at", "level", "2 seconds", "500 milliseconds", watermark=delay(t)), ["event_type"])


@q("stream_chunk_scores", "", f"""WITH c AS (SELECT user_id AS series_id, ({RECORDED_SQL}) // 15000000 AS c, avg(sqrt(value)) AS p FROM events GROUP BY 1, 2)
    SELECT series_id, count(*) AS chunks_used, {r('avg(p)', 'probability')} FROM c GROUP BY 1""")
def _(t):
    s = event_stream(t).select("series_id", "at", F.sqrt("value").alias("p"))
    return jobs.chunk_scores(s, "series_id", "at", "p", "15 seconds", watermark=delay(t)).select("series_id", "chunks_used", r6("probability"))


@q("stream_latest_session_score", "", """SELECT user_id AS series_id, count(*) AS uploads, arg_max(value, (ts, event_id)) AS latest_score, max(value) AS highest_score FROM events GROUP BY 1""")
def _(t):
    return jobs.session_scores(event_stream(t), "series_id", ["ts", "event_id"], "value")


@q("stream_dedup_segments", "", "SELECT DISTINCT user_id AS series_id, event_type FROM events")
def _(t):
    s = event_stream(t).select("series_id", "event_type", "at")
    return jobs.dedup(s, ["series_id", "event_type"], "at", watermark=delay(t)).select("series_id", "event_type")



