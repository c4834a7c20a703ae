"""Scans and sinks. Sinks are checked by reading back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import frames as fr
from ..session import shared_dir
from ..sources import media, tables, transcripts
from ._sql import r
from .frames import W
from .registry import Registry, r6

registry = Registry()
q = registry.query
_FCSV = "session_id long, segment_idx int, label int, loudness double, F0 double, jitter double, shimmer double"


def _features_csv(t):
    path = shared_dir(t.spark, "features")
    tables.csv_sink(t.features, path)
    return tables.scan_feature_csv(t.spark, path, _FCSV)


@q("scan_feature_csv", "features", 'SELECT session_id, segment_idx, loudness, "F0", jitter FROM features')
def _(t):
    return _features_csv(t).select("session_id", "segment_idx", "loudness", "F0", "jitter")


@q("csv_sink", "features", "SELECT * FROM features")
def _(t):
    return _features_csv(t)


@q("scan_delimited_series", "frames", "SELECT series_id, frame_idx, value FROM frames WHERE frame_idx BETWEEN 10 AND 40")
def _(t):
    path = shared_dir(t.spark, "series")
    tables.series_sink(t.frames.select("series_id", "frame_idx", "value"), path)
    return tables.scan_series(t.spark, path, "series_id long, frame_idx long, value double", ";", "frame_idx", 10, 40)


@q("scan_transcripts", "words", """SELECT session_id, CAST(count(DISTINCT segment_idx) AS INTEGER) AS n_segments, count(*) AS n_words FROM words GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark, "transcripts")
    docs = transcripts.nested(t.segments, "session_id", "segment_idx", t.words)
    docs.write.json(path)
    read = transcripts.scan_transcript_lines(t.spark, path, "session_id")
    n_words = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.size(F.coalesce(s["words"], F.array())))
    return read.select("session_id", F.size("segments").alias("n_segments"), n_words.alias("n_words"))


@q("explode_transcript_segments", "segments", r"""SELECT session_id, CASE WHEN segment_idx % 5 = 0 THEN 'transcript_segment_' || printf('%04d', rn) ELSE segment_id END AS segment_id,
    round(CASE WHEN segment_idx % 7 = 3 THEN 0 ELSE start_time END, 6) AS start_time, round(end_time, 6) AS end_time, round(end_time - CASE WHEN segment_idx % 7 = 3 THEN 0 ELSE start_time END, 6) AS duration,
    regexp_replace(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ''), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '') AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY segment_idx) - 1 AS rn FROM segments)""")
def _(t):
    s = t.segments.withColumns({"segment_id": F.when(F.col("segment_idx") % 5 != 0, F.col("segment_id")),
                                "start_time": F.when(F.col("segment_idx") % 7 == 3, F.lit("not a time")).otherwise(F.col("start_time").cast("string"))})
    docs = transcripts.nested(s, "session_id", "segment_idx").withColumn("json", F.to_json(F.struct("segments")))
    parsed = docs.select("session_id", F.from_json("json", transcripts.SCHEMA).alias("d")).select("session_id", "d.segments")
    return transcripts.explode_segments(parsed, "session_id").select("session_id", "segment_id", r6("start_time"), r6("end_time"), r6("duration"), "text")


@q("list_labelled_media", "listing media", "SELECT listing_id, file_id, label, ext, path FROM media")
def _(t):
    return media.labelled_media(t.media_listing).select("listing_id", "file_id", "label", "ext", "path")


@q("arff_ingest", "features", "SELECT 'order_' || session_id AS name, loudness, CASE WHEN jitter > 0 THEN jitter END AS jitter, CASE WHEN shimmer > 0 THEN shimmer END AS shimmer FROM features")
def _(t):
    path = shared_dir(t.spark, "arff")
    f = t.features.select(F.concat(F.lit("order_"), F.col("session_id").cast("string")).alias("name"), "loudness",
                          F.when(F.col("jitter") > 0, F.col("jitter")).alias("jitter"), F.when(F.col("shimmer") > 0, F.col("shimmer")).otherwise(float("nan")).alias("shimmer"))
    tables.arff_sink(f, "features", path)
    return tables.arff_ingest(t.spark, path)


@q("jsonl_event_sink", "frames", f"""WITH f AS (SELECT *, value > 40 AS f, lead(t) {W}) AS nxt, coalesce(lag(value > 40) {W}), false) AS was FROM frames),
    n AS (SELECT *, sum(CASE WHEN f AND NOT was THEN 1 ELSE 0 END) {W}) AS run FROM f), e AS (SELECT series_id, run, min(t) AS s, arg_max(coalesce(nxt, t), frame_idx) AS e, arg_max(event_type, frame_idx) AS d FROM n WHERE f GROUP BY 1, 2)
    SELECT series_id, 'loud' AS event, round_even(s, 2) AS start_time, round_even(e, 2) AS end_time, d AS last_type FROM e""")
def _(t):
    path = shared_dir(t.spark, "events")
    tables.jsonl_sink(fr.episodes(t.frames, ["series_id"], "frame_idx", "t", F.col("value") > 40, "loud", F.create_map(F.lit("type"), F.col("event_type"))), path)
    read = t.spark.read.schema("series_id long, event string, start_time double, end_time double, duration double, details map<string,string>").json(path)
    return read.select("series_id", "event", "start_time", "end_time", F.col("details")["type"].alias("last_type"))


def _report_sql():
    from .models import _AN, _LEX
    return f"WITH {_LEX}, {_AN} SELECT session_id, n_segments, {r('overall', 'risk_score')} FROM a"


@q("json_report_sink", "tokens", _report_sql())
def _(t):
    from ..operators import reports
    from .models import analysed
    path = shared_dir(t.spark, "reports")
    tables.report_sink(reports.pack_json(analysed(t), "session_id"), "report", path)
    read = t.spark.read.text(path)
    return read.select(F.get_json_object("value", "$.session_id").alias("session_id"), F.get_json_object("value", "$.n_segments").cast("long").alias("n_segments"),
                       r6(F.get_json_object("value", "$.overall.risk_score").cast("double"), "risk_score"))


@q("libsvm_sink", "features", 'SELECT CAST(label AS DOUBLE) AS label, loudness, "F0", jitter, shimmer FROM features')
def _(t):
    path, names = shared_dir(t.spark, "libsvm"), ["loudness", "F0", "jitter", "shimmer"]
    tables.libsvm_sink(t.features, "label", names, path)
    return tables.scan_libsvm(t.spark, path, names)


@q("vector_table_sink", "vectors", "SELECT subject, frame_idx, len(vec) AS n, round(list_sum(vec), 6) + CAST(0 AS DOUBLE) AS total FROM vectors")
def _(t):
    path = shared_dir(t.spark, "vectors")
    tables.vector_sink(t.vectors, path, ["subject"])
    read = t.spark.read.schema("frame_idx long, vec array<double>, subject string").parquet(path)
    return read.select("subject", "frame_idx", F.size("vec").cast("long").alias("n"), r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), "total"))


@q("upsert_by_session", "", """SELECT user_id, event_id, value, CAST(NULL AS VARCHAR) AS note FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    UNION ALL SELECT c_custkey, -1, c_acctbal, 'replaced' FROM customer WHERE c_acctbal > 5000""")
def _(t):
    old = t.table("events").select("user_id", "event_id", "value")
    new = t.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"), F.lit("replaced").alias("note"))
    return tables.upsert_by_session(old, new, "user_id")



