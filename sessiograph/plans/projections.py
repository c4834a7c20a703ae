"""Projections, filters, predicates and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import UPLOAD_EXTENSIONS, UPLOAD_MIME_TYPES
from ..functions import text as tx
from ..operators import ordered
from ..operators import projections as pr
from ..sources import media
from ._sql import AWL, N, TTR, count_of, listed, r
from .registry import Registry, r6
from .scalar_functions import EN, EN_STOP

registry = Registry()
q = registry.query
ID = ["session_id", "segment_idx"]
_FEATS = "session_id, segment_idx, label, loudness, \"F0\", jitter, shimmer"


@q("select_features_by_pattern", "features",
   "SELECT session_id, segment_idx, loudness, \"F0\", jitter, shimmer, loudness * 2 AS duration FROM features")
def _(t):
    wide = t.features.withColumn("duration", F.col("loudness") * 2).withColumn("other", F.lit(1.0)).withColumn("asr_conf_mean", F.lit(0.5))
    return pr.select_features_by_pattern(wide, ID)


@q("select_features_by_prefix", "features",
   "SELECT session_id, avg_l AS audio_l, n AS text_n FROM (SELECT session_id, round(avg(loudness), 6) AS avg_l, count(*) AS n FROM features GROUP BY 1)")
def _(t):
    s = t.features.groupBy("session_id").agg(r6(F.avg("loudness"), "audio_l"), F.count("*").alias("text_n"), F.min("label").alias("text_label"),
                                             F.count("*").alias("n_segments"))
    return pr.select_features_by_prefix(s, ("audio_", "text_"), ["session_id"], ("text_label",))


@q("drop_loudness_features", "features", """WITH s AS (SELECT avg(loudness) AS m, stddev_samp(loudness) AS d FROM features)
    SELECT session_id, segment_idx, label, "F0", jitter, shimmer, """ + r("(loudness - m) / d", "loudness_z") + " FROM features, s")
def _(t):
    z = pr.treat_loudness(t.features, "normalize").withColumn("z", F.round("loudness", 6))
    return pr.treat_loudness(z.withColumnRenamed("loudness", "loudness_raw"), "exclude").withColumnRenamed("z", "loudness_z")


@q("select_numeric_columns", "", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def _(t):
    return pr.select_numeric(t.table("lineitem"), ["l_orderkey"], ("l_tax",))


@q("project_audio_schema", "segments tokens", "SELECT session_id AS file_id, segment_id, start_time AS \"start\", end_time AS \"end\", duration, label, "
   "score AS \"loudness_sma3_amean\", score * 2 AS \"F0semitoneFrom27.5Hz_sma3nz_amean\", " + r(TTR, "type_token_ratio")
   + ", '' AS segment_path, CAST(0 AS DOUBLE) AS asr_conf_mean, CAST(0 AS DOUBLE) AS asr_conf_std, " + N + " AS word_count FROM toks")
def _(t):
    s = t.segments.select(F.col("session_id").alias("file_id"), "segment_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"),
                          "duration", "label", "text", F.col("score").alias("loudness_sma3_amean"),
                          (F.col("score") * 2).alias("F0semitoneFrom27.5Hz_sma3nz_amean"), F.round(tx.type_token_ratio("text"), 6).alias("type_token_ratio"))
    return pr.project_audio_schema(s)


def text_table(t):
    """The text feature table of all segments, lists in English where the data is."""
    gapped = ordered.over_neighbours(
        t.segments, ["session_id"], "segment_idx",
        lambda w: {"_gap": F.col("start_time") - F.lag("start_time").over(w)}, 1, 0, 4096)
    return pr.project_text_schema(gapped, F.col("_gap"), EN, EN_STOP)


_STOP, _HARD = listed(EN_STOP), "CAST(len(list_filter(w, lambda x: length(x) > 6)) AS INTEGER)"
TEXT_TABLE_SQL = f"""SELECT start_time, end_time, CAST(NULL AS VARCHAR) AS speaker, text, session_id, label, duration,
    start_time - lag(start_time) OVER (PARTITION BY session_id ORDER BY segment_idx) AS pause_prev, {N} AS num_tokens,
    CAST(len(list_distinct(lw)) AS INTEGER) AS num_unique_tokens, CAST(length(text) AS INTEGER) AS num_chars, {N} AS word_count,
    {count_of('[.!?]')} + 1 AS sent_count, len(w) / duration AS words_per_sec, {TTR} AS type_token_ratio, {AWL} AS avg_word_len,
    {_HARD} AS num_complex_words, {_HARD} / (len(w) + 1e-10) AS complex_word_ratio, {_STOP} AS num_stopwords,
    {_STOP} / (len(w) + 1e-10) AS stopword_ratio, {count_of('[?]')} AS qmark_count, {count_of('!')} AS excl_count,
    {', '.join(f'{listed(x)} AS {k}' for k, x in EN.items())} FROM toks"""
_ROUNDED = ["words_per_sec", "type_token_ratio", "avg_word_len", "complex_word_ratio", "stopword_ratio"]


@q("project_text_schema", "tokens", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}) FROM ({TEXT_TABLE_SQL})")
def _(t):
    return text_table(t).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@q("sync_columns_to_reference", "", "SELECT l_orderkey, l_tax, l_quantity FROM lineitem")
def _(t):
    reference = t.table("lineitem").select("l_orderkey", "l_tax", "l_shipdate", "l_quantity")
    return pr.sync_columns(t.table("lineitem"), reference, drop=("l_shipdate",))


@q("select_and_rename_fields", "frames", "SELECT series_id AS series, frame_idx AS frame, value AS loudness FROM frames")
def _(t):
    return pr.select_and_rename(t.frames, ["series_id", "frame_idx", "value"], ["series", "frame", "loudness"])


@q("fill_missing_features", "features", """SELECT session_id, segment_idx, CASE WHEN jitter > 0 THEN loudness / jitter ELSE 0 END AS ratio,
    CASE WHEN shimmer > 0 THEN shimmer ELSE 0 END AS shimmer, CAST(0 AS DOUBLE) AS absent FROM features""")
def _(t):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    f = t.features.select(*ID, F.when(F.col("jitter") > 0, F.col("loudness") / F.col("jitter")).otherwise(inf).alias("ratio"),
                          F.when(F.col("shimmer") > 0, F.col("shimmer")).otherwise(nan).alias("shimmer"))
    return pr.fill_missing_features(f, ["ratio", "shimmer", "absent"])


@q("missing_feature_gate", "features", """WITH s AS (SELECT session_id, 5 - max(CAST(loudness > 25 AS INTEGER)) - max(CAST(jitter > 0.05 AS INTEGER)) - 1 - max(CAST(shimmer > 0 AS INTEGER)) AS n FROM features GROUP BY 1)
    SELECT session_id, n AS n_missing, n / CAST(5 AS DOUBLE) AS missing_ratio FROM s WHERE n / CAST(5 AS DOUBLE) <= 0.25""")
def _(t):
    f = t.features.select("session_id", F.when(F.col("loudness") > 25, F.col("loudness")).alias("a"), F.when(F.col("jitter") > 0.05, F.col("jitter")).alias("b"),
                          F.col("F0").alias("c"), F.when(F.col("shimmer") > 0, F.col("shimmer")).alias("d"))
    return pr.missing_feature_gate(f, "session_id", ["a", "b", "c", "d", "not_there"])


@q("filter_sessions_by_id", "segments", "SELECT session_id, segment_idx FROM segments WHERE session_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000)")
def _(t):
    ids = t.table("customer").where("c_acctbal > 5000").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("session_id"))
    return pr.keep_ids(t.segments.select(*ID), ids, "session_id")


@q("report_missing_ids", "segments", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS session_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT session_id FROM segments)")
def _(t):
    ids = t.table("customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    return pr.missing_ids(ids, t.segments, "session_id")


@q("filter_nonempty_text", "", r"SELECT doc_id, lang FROM documents WHERE regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g') <> ''")
def _(t):
    return t.table("documents").where(tx.strip_blanks("text") != "").select("doc_id", "lang")


@q("filter_min_duration", "segments", "SELECT session_id, segment_idx, duration FROM segments WHERE duration >= 2")
def _(t):
    return t.segments.where(F.col("duration") >= 2.0).select(*ID, "duration")


@q("duration_window_with_fallback", "segments", """WITH f AS (SELECT *, max(CASE WHEN duration BETWEEN 3 AND 13 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has FROM segments WHERE score > 0.05)
    SELECT session_id, segment_idx, duration, score FROM f WHERE has = 0 OR duration BETWEEN 3 AND 13""")
def _(t):
    s = t.segments.withColumn("score", F.when(F.col("score") > 0.05, F.col("score")))
    return pr.duration_window(s, "session_id", "segment_idx").select(*ID, "duration", "score")


@q("resolve_label", "listing media scripts", r"""WITH rows0 AS (SELECT o_orderkey, 'rec_' || CAST(o_custkey AS VARCHAR) AS file_id,
        CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 2 AS VARCHAR) WHEN 1 THEN 'unknown' END AS own,
        CASE WHEN o_orderstatus <> 'P' THEN NULL ELSE 'wav/' || CAST(o_orderkey % 3 AS VARCHAR) || '/x.wav' END AS path FROM orders),
    best AS (SELECT file_id, max(label) AS label FROM media GROUP BY 1)
    SELECT o_orderkey, rows0.file_id, CAST(coalesce(try_cast(own AS INTEGER), CAST(nullif(regexp_extract(path, '(?:^|/)([01])(?:/|$)', 1), '') AS INTEGER),
        best.label, scripts.label, 0) AS INTEGER) AS label
    FROM rows0 LEFT JOIN best ON best.file_id = rows0.file_id LEFT JOIN scripts ON scripts.file_id = rows0.file_id""")
def _(t):
    key = F.col("o_orderkey")
    rows = t.table("orders").select("o_orderkey", F.concat(F.lit("rec_"), F.col("o_custkey").cast("string")).alias("file_id"),
                                    F.when(key % 5 == 0, (key % 2).cast("string")).when(key % 5 == 1, "unknown").alias("own"),
                                    F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("wav/"), (key % 3).cast("string"), F.lit("/x.wav"))).alias("path"))
    best = media.labelled_media(t.media_listing).groupBy("file_id").agg(F.max("label").alias("label"))
    return pr.resolve_label(rows, F.col("own"), F.col("path"), "file_id", best, t.transcript_listing).select("o_orderkey", "file_id", "label")


@q("gate_frames_by_value", "frames", """SELECT series_id, frame_idx, value, CASE WHEN value >= 40 THEN value ELSE 0 END AS voiced,
    CASE WHEN value < 40 THEN value ELSE 0 END AS unvoiced FROM frames WHERE value >= 5""")
def _(t):
    kept = pr.gate_by_value(t.frames.select("series_id", "frame_idx", "value"), F.col("value"), [], 5.0)
    both = kept.withColumns({"voiced": F.col("value"), "unvoiced": F.col("value")})
    both = pr.gate_by_value(both, F.col("value"), ["voiced"], 40.0, zero=True)
    return pr.gate_by_value(both, F.col("value"), ["unvoiced"], 40.0, invert=True, zero=True)


@q("sample_every_nth_frame", "frames", """SELECT series_id, frame_idx, value FROM frames WHERE frame_idx % 3 = 0""")
def _(t):
    return pr.every_nth(t.frames, "frame_idx", 3).select("series_id", "frame_idx", "value")


@q("sample_at_fps", "frames", """SELECT series_id, frame_idx, value FROM frames WHERE frame_idx % greatest(1, CAST(floor((series_id % 30 + 1) / CAST(4 AS DOUBLE)) AS BIGINT)) = 0""")
def _(t):
    return pr.every_nth(t.frames, "frame_idx", pr.fps_interval(F.col("series_id") % 30 + 1, 4.0)).select("series_id", "frame_idx", "value")


@q("even_chunk_subsample", "segments", """WITH d AS (SELECT session_id, max(end_time) * 8 AS d FROM segments GROUP BY 1),
    n AS (SELECT *, greatest(1, CAST(ceil(d / 15) AS BIGINT)) AS n FROM d),
    c AS (SELECT session_id, d, unnest(CASE WHEN n > 24 THEN list_transform(range(0, 24), lambda i: CAST(round_even(i * ((n - 1) / CAST(23 AS DOUBLE)), 0) AS BIGINT)) ELSE range(0, n) END) AS chunk FROM n)
    SELECT session_id, chunk, chunk * CAST(15 AS DOUBLE) AS chunk_start, least((chunk + 1) * CAST(15 AS DOUBLE), d) AS chunk_end FROM c WHERE least((chunk + 1) * CAST(15 AS DOUBLE), d) > chunk * 15""")
def _(t):
    lengths = t.segments.groupBy("session_id").agg((F.max("end_time") * 8).alias("d"))
    return pr.even_chunks(lengths, F.col("d"), at_most=24).drop("d")


@q("downsample_timeline", "frames", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM frames)
    SELECT series_id, frame_idx, value FROM n WHERE n <= 20 OR frame_idx % CAST(ceil(n / CAST(20 AS DOUBLE)) AS BIGINT) = 0 OR frame_idx = n - 1""")
def _(t):
    return pr.downsample_timeline(t.frames, ["series_id"], "frame_idx", 20).select("series_id", "frame_idx", "value")


_MIME = {"F": "VIDEO/mp4 ", "O": "text/plain", "P": "video/x-unlisted"}


@q("validate_media_type", "listing", f"""SELECT l.listing_id, l.path FROM listing l JOIN orders o ON o.o_orderkey = l.listing_id
    WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ({', '.join(f"'{e}'" for e in UPLOAD_EXTENSIONS)})
    OR lower(trim(CASE o_orderstatus WHEN 'F' THEN 'VIDEO/mp4 ' WHEN 'O' THEN 'text/plain' ELSE 'video/x-unlisted' END)) IN ({', '.join(f"'{e}'" for e in UPLOAD_MIME_TYPES)})
    OR o_orderstatus = 'P'""")
def _(t):
    mimes = t.table("orders").select(F.col("o_orderkey").alias("listing_id"), F.element_at(
        F.create_map(*[F.lit(x) for kv in _MIME.items() for x in kv]), F.col("o_orderstatus")).alias("mime"))
    listed_ = t.media_listing.join(mimes, "listing_id")
    return listed_.where(pr.valid_upload(F.col("path"), F.col("mime"))).select("listing_id", "path")
