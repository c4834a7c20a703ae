"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins, ordered, sessions
from ..sources import media
from ._sql import r
from .registry import Registry, r6

registry = Registry()
q = registry.query
ID = ["session_id", "segment_idx"]


def _raw_features(t):
    """Per order: mean features under a session id spelled with prefix or copy suffix."""
    k = F.col("l_orderkey").cast("string")
    spelled = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("0_rec"), k)).otherwise(F.concat(F.lit("rec"), k, F.lit(" (3)")))
    return t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("shimmer")).select(
        spelled.alias("session_id"), F.col("l_linenumber").cast("string").alias("segment_id"), "shimmer")


def _raw_segments(t):
    k = F.col("l_orderkey").cast("string")
    return t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price")).select(
        F.concat(F.lit("rec"), k).alias("session_id"), F.col("l_linenumber").cast("string").alias("segment_id"), "price")


@q("join_segments_features", "", """SELECT 'rec' || l_orderkey AS session_id, CAST(l_linenumber AS VARCHAR) AS segment_id, max(l_extendedprice) AS price, max(l_tax) AS shimmer
    FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def _(t):
    return joins.join_segments_features(_raw_segments(t), _raw_features(t))


@q("semi_filter_common_sessions", "", """SELECT 'first' AS side, count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM events)
    UNION ALL SELECT 'second', count(*) FROM events WHERE user_id IN (SELECT o_custkey FROM orders)""")
def _(t):
    a, b = joins.keep_common(t.table("orders").select(F.col("o_custkey").alias("k")), t.table("events").select(F.col("user_id").alias("k")), "k")
    return a.agg(F.lit("first").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(b.agg(F.lit("second").alias("side"), F.count(F.lit(1)).alias("n")))


_MULTI = """WITH a AS (SELECT l_orderkey AS session_id, l_orderkey % 2 AS label, avg(l_quantity) AS audio_loudness_mean FROM lineitem GROUP BY 1, 2),
    b AS (SELECT o_orderkey AS session_id, o_orderkey % 2 AS label, o_totalprice AS text_price FROM orders)"""


def _modalities(t):
    a = t.table("lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.avg("l_quantity").alias("audio_loudness_mean"))
    a = a.withColumn("label", (F.col("session_id") % 2).cast("int"))
    b = t.table("orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 2).cast("int").alias("label"), F.col("o_totalprice").alias("text_price"))
    return a, b


@q("join_sessions_modalities", "", _MULTI + f" SELECT a.session_id, CAST(a.label AS INTEGER) AS label, {r('audio_loudness_mean', 'audio_loudness_mean')}, text_price FROM a JOIN b ON a.session_id = b.session_id")
def _(t):
    return sessions.merge_modalities(*_modalities(t), "session_id").select("session_id", "label", r6("audio_loudness_mean"), "text_price")


@q("modality_overlap_report", "", _MULTI + f""", n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a JOIN b USING (session_id)) AS c)
    SELECT a - c AS only_first, b - c AS only_second, c AS common, {r('c * 100.0 / greatest(a, b)', 'overlap_pct')}, c * 100.0 / greatest(a, b) < 50 AS low_overlap FROM n""")
def _(t):
    a, b = _modalities(t)
    return sessions.overlap_report(a, b, "session_id").withColumn("overlap_pct", F.round("overlap_pct", 6))


@q("left_join_session_parts", "segments", f"""SELECT s.session_id, {r('avg(score)', 'score_mean')}, max(t.full_text) AS full_text, count(*) AS n_segments, min(label) AS label
    FROM segments s LEFT JOIN (SELECT session_id, string_agg(trim(text), ' ' ORDER BY segment_idx) AS full_text FROM segments GROUP BY 1) t ON t.session_id = s.session_id GROUP BY 1""")
def _(t):
    stats = t.segments.groupBy("session_id").agg(r6(F.avg("score"), "score_mean"), F.count(F.lit(1)).alias("n_segments"), F.min("label").alias("label"))
    return stats.join(sessions.session_text(t.segments, "session_id", "segment_idx"), "session_id", "left")


@q("anti_join_completed", "listing media scripts", "SELECT DISTINCT label, file_id FROM media WHERE file_id NOT IN (SELECT file_id FROM scripts)")
def _(t):
    return media.unprocessed(media.samples(media.labelled_media(t.media_listing)), t.transcript_listing).select("label", "file_id")


_SAMPLES = """s AS (SELECT label, file_id, max(path) FILTER (ext = 'wav') AS audio_path, max(path) FILTER (ext <> 'wav') AS video_path,
    max(modification_time) FILTER (ext = 'wav') AS audio_time, max(modification_time) FILTER (ext <> 'wav') AS video_time FROM media GROUP BY 1, 2)"""


@q("stale_artifact_join", "listing media", f"WITH {_SAMPLES} SELECT label, file_id, video_path FROM s WHERE video_path IS NOT NULL AND (audio_path IS NULL OR video_time > audio_time)")
def _(t):
    return media.needs_conversion(media.samples(media.labelled_media(t.media_listing))).select("label", "file_id", "video_path")


@q("resolve_label_conflicts", "listing media scripts", f"""WITH {_SAMPLES}, f AS (SELECT s.*, t.file_id IS NOT NULL AS has FROM s LEFT JOIN (SELECT DISTINCT file_id, label FROM scripts) t ON t.file_id = s.file_id AND t.label = s.label)
    SELECT file_id, CAST(arg_max(label, (has, label)) AS INTEGER) AS label, arg_max(has, (has, label)) AS has_transcript, count(*) > 1 AS conflict FROM f GROUP BY 1""")
def _(t):
    s = media.samples(media.labelled_media(t.media_listing))
    return media.resolve_label_conflicts(s, t.transcript_listing).select("file_id", "label", "has_transcript", "conflict")


@q("tolerance_join_pause", "segments", f"""WITH o AS (SELECT session_id, segment_idx, start_time + CASE segment_idx % 3 WHEN 0 THEN 0.004 WHEN 1 THEN -0.009 ELSE 0.02 END AS s2, end_time - 0.003 AS e2, score AS pause_ratio FROM segments)
    SELECT s.session_id, s.segment_idx, {r('coalesce(max(pause_ratio), 0)', 'pause_ratio')} FROM segments s LEFT JOIN o ON o.session_id = s.session_id AND abs(s.start_time - s2) < 0.01 AND abs(s.end_time - e2) < 0.01 GROUP BY 1, 2""")
def _(t):
    i = F.col("segment_idx")
    shift = F.when(i % 3 == 0, 0.004).when(i % 3 == 1, -0.009).otherwise(0.02)
    other = t.segments.select("session_id", (F.col("start_time") + shift).alias("start_time"), (F.col("end_time") - 0.003).alias("end_time"), F.col("score").alias("pause_ratio"))
    j = joins.tolerance_join(t.segments.select(*ID, "start_time", "end_time"), other, "session_id")
    return j.select(*ID, r6(F.coalesce("pause_ratio", F.lit(0.0)), "pause_ratio"))


PARTS_SQL = """parts AS (SELECT session_id, segment_idx, start_time, end_time, duration, text, unnest(range(0, n)) AS part, n FROM
        (SELECT *, CASE WHEN duration > 5 THEN CAST(floor(duration / 5) AS BIGINT) + 1 ELSE 1 END AS n FROM segments WHERE duration >= 2)),
    bounds AS (SELECT *, start_time + part * (duration / n) AS part_start, least(start_time + (part + 1) * (duration / n), end_time) AS part_end FROM parts)"""


def split_parts(t):
    from ..operators.windows import split_segments
    return split_segments(t.segments.where(F.col("duration") >= 2.0), 5.0)


@q("interval_join_words", "words", f"""WITH {PARTS_SQL} SELECT b.session_id, b.segment_idx, part, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS words
    FROM bounds b JOIN words w ON w.session_id = b.session_id AND w.segment_idx = b.segment_idx AND ((word_start >= part_start AND word_start < part_end) OR (word_end > part_start AND word_end <= part_end)) GROUP BY 1, 2, 3""")
def _(t):
    w = t.words.select("session_id", "segment_idx", "word_idx", "word", "word_start", "word_end")
    hit = joins.interval_join_words(split_parts(t).select(*ID, "part", "part_start", "part_end"), w, ID)
    words = F.array_sort(F.collect_list(F.struct("word_idx", "word")))  # the words of one part of a segment
    return hit.groupBy(*ID, "part").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("words"))


@q("priority_key_join", "", """WITH k AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'p' || s_suppkey WHEN 1 THEN '0_p' || s_suppkey ELSE '1_p' || s_suppkey END AS file_id FROM supplier),
    a AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 2 WHEN 0 THEN 'p' || o_custkey ELSE '1_p' || o_custkey END AS wanted FROM orders),
    c AS (SELECT o_orderkey, wanted, unnest([wanted, '1_' || wanted, replace(replace(wanted, '0_', ''), '1_', ''), '0_' || wanted]) AS file_id, unnest([0, 1, 2, 3]) AS rnk FROM a),
    e AS (SELECT o_orderkey, arg_min(c.file_id, rnk) AS file_id, min(rnk) AS rnk FROM c JOIN k ON k.file_id = c.file_id GROUP BY 1),
    u AS (SELECT DISTINCT wanted FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)),
    s AS (SELECT wanted, min(k.file_id) AS file_id FROM u JOIN k ON contains(k.file_id, wanted) OR contains(wanted, k.file_id) GROUP BY 1)
    SELECT o_orderkey, file_id, CAST(rnk AS INTEGER) AS rank FROM e UNION ALL SELECT o_orderkey, s.file_id, 99 FROM a JOIN s ON s.wanted = a.wanted WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)""")
def _(t):
    sk = F.col("s_suppkey").cast("string")
    known = t.table("supplier").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "p").when(F.col("s_suppkey") % 3 == 1, "0_p").otherwise("1_p"), sk).alias("file_id"))
    ck = F.col("o_custkey").cast("string")
    asked = t.table("orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("1_p"), ck).alias("wanted"))
    w = F.col("wanted")
    exact = joins.priority_join(asked, F.array(w, F.concat(F.lit("1_"), w), F.replace(F.replace(w, F.lit("0_"), F.lit("")), F.lit("1_"), F.lit("")), F.concat(F.lit("0_"), w)),
                                known, "file_id", "o_orderkey")
    rest = asked.join(exact, "o_orderkey", "left_anti")
    spelled = rest.select("wanted").distinct()
    loose = joins.substring_match(spelled.withColumn("row_id", F.col("wanted")), known, "file_id", "row_id", "wanted")
    late = rest.join(loose, rest["wanted"] == loose["row_id"]).select("o_orderkey", "file_id", F.lit(99).alias("rank"))
    return exact.select("o_orderkey", "file_id", "rank").unionByName(late)


@q("candidate_subject_join", "", r"""WITH k AS (SELECT DISTINCT 'subj' || CASE s_suppkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '-' END || s_suppkey AS subject FROM supplier),
    a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'subj-' || o_custkey WHEN 1 THEN ' subj_' || o_custkey || ' (1)' ELSE 'subj--' || o_custkey || '.' END AS pid FROM orders),
    p AS (SELECT o_orderkey, trim(pid) AS p, trim(regexp_replace(trim(pid), '\(.*?\)', '', 'g')) AS b FROM a),
    c AS (SELECT o_orderkey, unnest([p, replace(p, '-', '_'), replace(p, '-', '.'), replace(p, '_', '.'), replace(p, '.', '_'), b, replace(b, '-', '_'), replace(b, '.', '_')]) AS x, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS rnk FROM p),
    n AS (SELECT o_orderkey, regexp_replace(regexp_replace(x, '[_.\-]{2,}', '_', 'g'), '^[_.\- ]+|[_.\- ]+$', '', 'g') AS subject, rnk FROM c)
    SELECT o_orderkey, arg_min(n.subject, rnk) AS subject FROM n JOIN k ON k.subject = n.subject GROUP BY 1""")
def _(t):
    sk = F.col("s_suppkey").cast("string")
    known = t.table("supplier").select(F.concat(F.lit("subj"), F.when(F.col("s_suppkey") % 3 == 0, "_").when(F.col("s_suppkey") % 3 == 1, ".").otherwise("-"), sk).alias("subject"))
    ck, o = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    asked = t.table("orders").select("o_orderkey", F.when(o % 3 == 0, F.concat(F.lit("subj-"), ck)).when(o % 3 == 1, F.concat(F.lit(" subj_"), ck, F.lit(" (1)")))
                                     .otherwise(F.concat(F.lit("subj--"), ck, F.lit("."))).alias("pid"))
    return joins.priority_join(asked, sc.subject_candidates("pid"), known, "subject", "o_orderkey").select("o_orderkey", "subject")


def _aligned(t):
    """Audio chunks from order lines, video frames from embeddings with a dense index per subject."""
    frames = ordered.dense_index(t.vectors.select("subject", F.col("frame_idx").alias("vec_id"), "vec"), ["subject"], ["vec_id"], ordered.chunk_of("vec_id"), "frame_idx")
    li = t.table("orders")
    chunks = li.select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("subj_"), (F.col("o_custkey") % 12).cast("string")).alias("subject"),
                       F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 9 + 1).alias("segment_index"),
                       F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 20).cast("double") / 2).alias("duration"),
                       (F.col("o_custkey") % 70).cast("double").alias("start_time"), ((F.col("o_custkey") % 70) + 6.5).alias("end_time"))
    lengths = frames.groupBy("subject").agg(F.count(F.lit(1)).alias("n_frames"))
    return frames, chunks, lengths


_ALIGN = """fr AS (SELECT subject, vec, row_number() OVER (PARTITION BY subject ORDER BY frame_idx) - 1 AS frame_idx FROM vectors),
    len0 AS (SELECT subject, count(*) AS n_frames FROM fr GROUP BY 1),
    ch AS (SELECT o_orderkey AS chunk_id, 'subj_' || (o_custkey % 12) AS subject, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 9 + 1 END AS segment_index,
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 20 AS DOUBLE) / 2 END AS duration, CAST(o_custkey % 70 AS DOUBLE) AS start_time, CAST(o_custkey % 70 AS DOUBLE) + 6.5 AS end_time FROM orders),
    byidx AS (SELECT chunk_id, subject, n_frames, s0, d, CASE WHEN s0 >= n_frames THEN greatest(0, n_frames - d) ELSE s0 END AS first_frame FROM
        (SELECT *, (coalesce(segment_index, 1) - 1) * d AS s0 FROM (SELECT ch.*, n_frames, CAST(coalesce(greatest(1, round_even(duration, 0)), 15) AS BIGINT) AS d FROM ch LEFT JOIN len0 ON len0.subject = ch.subject))),
    idx AS (SELECT chunk_id, subject, n_frames, first_frame, least(first_frame + d, n_frames) AS last_frame FROM byidx),
    tim AS (SELECT chunk_id, ch.subject, n_frames, greatest(0, CASE WHEN segment_index >= 1 THEN (segment_index - 1) * 15 ELSE CAST(floor(start_time) AS BIGINT) END) AS first_frame,
        least(CASE WHEN segment_index >= 1 THEN (segment_index - 1) * 15 + CASE WHEN duration > 0 THEN CAST(ceil(duration) AS BIGINT) ELSE 15 END ELSE CAST(ceil(end_time) AS BIGINT) END, n_frames) AS last_frame
        FROM ch LEFT JOIN len0 ON len0.subject = ch.subject)"""


def _range_sql(src):
    return f"""WITH {_ALIGN} SELECT chunk_id, first_frame, last_frame, count(*) AS n, round(avg(vec[1]), 6) + CAST(0 AS DOUBLE) AS v0, round(avg(vec[64]), 6) + CAST(0 AS DOUBLE) AS v63
    FROM {src} c JOIN fr ON fr.subject = c.subject AND fr.frame_idx >= first_frame AND fr.frame_idx < last_frame GROUP BY 1, 2, 3"""


def _range(t, fn):
    frames, chunks, lengths = _aligned(t)
    out = joins.frame_range_join(fn(chunks, lengths, ["subject"]), frames, ["subject"], "vec")
    return out.select("chunk_id", "first_frame", "last_frame", (F.col("last_frame") - F.col("first_frame")).alias("n"),
                      r6(F.get("vec", F.lit(0)), "v0"), r6(F.get("vec", F.lit(63)), "v63"))


@q("chunk_frame_range_join", "vectors", _range_sql("idx"))
def _(t):
    return _range(t, joins.chunk_frames_by_index)


@q("chunk_frame_range_join_time", "vectors", _range_sql("tim"))
def _(t):
    return _range(t, joins.chunk_frames_by_time)


@q("alignment_skip_report", "vectors", f"""WITH {_ALIGN} SELECT CASE WHEN c.subject NOT IN (SELECT subject FROM len0) THEN 'no_subject' WHEN last_frame <= first_frame THEN 'zero_length' ELSE 'aligned' END AS reason,
    count(*) AS chunks FROM tim c GROUP BY 1""")
def _(t):
    frames, chunks, lengths = _aligned(t)
    return joins.alignment_reasons(joins.chunk_frames_by_time(chunks, lengths, ["subject"]), frames, "subject")


@q("nearest_point_join", "frames", """WITH p AS (SELECT series_id, frame_idx, epoch_us(ts) / 1e6 AS x, value AS y FROM (SELECT f.*, e.ts FROM frames f JOIN events e ON e.event_id = f.event_id)),
    g AS (SELECT o_orderkey AS target_id, o_custkey % 160 AS series_id, 1704067200 + CAST(o_orderkey * 137 % 2592000 AS DOUBLE) AS x FROM orders)
    SELECT target_id, g.series_id, arg_min(y, (abs(p.x - g.x), frame_idx)) AS nearest_y FROM g JOIN p ON p.series_id = g.series_id GROUP BY 1, 2""")
def _(t):
    micros = F.unix_date(F.to_date("ts")).cast("double") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    points = t.frames.select("series_id", micros.alias("x"), F.col("value").alias("y"), F.col("frame_idx").alias("tie"))
    targets = t.table("orders").select(F.col("o_orderkey").alias("target_id"), (F.col("o_custkey") % 160).alias("series_id"),
                                       (F.lit(1704067200) + F.col("o_orderkey") * 137 % 2592000).cast("double").alias("x"))
    near = joins.nearest_point(points, targets, ["series_id"], "x", "y", "x", 86400.0)
    return near.where(F.col("nearest_y").isNotNull()).select("target_id", "series_id", "nearest_y")


@q("broadcast_label_lookup", "", "SELECT event_id, c_nationkey % 2 AS label FROM events LEFT JOIN customer ON c_custkey = user_id")
def _(t):
    labels = t.table("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 2).alias("label"))
    return joins.label_lookup(t.table("events").select("event_id", "user_id"), labels, "user_id").select("event_id", "label")


@q("annotation_media_join", "listing media", r"""WITH m AS (SELECT file_id, min(path) AS path FROM media WHERE ext <> 'wav' GROUP BY 1)
    SELECT c_custkey, path, path IS NOT NULL AS matched FROM customer LEFT JOIN m ON file_id = 'rec_' || c_custkey""")
def _(t):
    m = media.labelled_media(t.media_listing).where(F.col("ext") != "wav").groupBy("file_id").agg(F.min("path").alias("path"))
    notes = t.table("customer").select("c_custkey", sc.base_session_id(F.concat(F.lit("rec_"), F.col("c_custkey").cast("string"), F.lit("_transcript"))).alias("file_id"))
    return joins.annotation_media(notes, m, "file_id").select("c_custkey", "path", "matched")


@q("frame_sync_concat", "frames", """SELECT series_id, frame_idx, value AS f0, value * 2 AS loudness, e AS event_type FROM frames
    JOIN (SELECT series_id AS s, frame_idx AS i, event_type AS e FROM frames) ON s = series_id AND i = frame_idx""")
def _(t):
    k = ["series_id", "frame_idx"]
    levels = [t.frames.select(*k, F.col("value").alias("f0")), t.frames.select(*k, (F.col("value") * 2).alias("loudness")),
              t.frames.select(*k, "event_type")]
    return joins.frame_sync(levels, k)


@q("positional_join", "", "SELECT vec_id AS instance_id, label, value FROM embeddings JOIN events ON event_id = vec_id")
def _(t):
    # both tables store their instance numbers; files and splits give no order to count rows in
    a = t.table("embeddings").select(F.col("vec_id").alias("instance_id"), "label")
    b = t.table("events").select(F.col("event_id").alias("instance_id"), "value")
    return joins.positional(a, b, "instance_id").select("instance_id", "label", "value")
