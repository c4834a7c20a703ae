"""The stored tables, and the logical tables that stand on them.

Recordings are not shipped with this repository, so conversations stand in for transcripts, events for
frame series, order lines for wide acoustic features and embeddings for frame vectors and landmarks.
Every logical table has the same meaning in ``SQL`` (common table expressions) for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered

TURNS_PER_CHUNK = 4096
CHARS_PER_SECOND = 16.0


class Tables:
    """Lazy access to one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def segments(self) -> DataFrame:
        """Speech segments: one conversation turn each, placed one after the other in time."""
        base = self.table("conversations").select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.col("turn").alias("segment_idx"),
            F.concat(F.col("conv_id").cast("string"), F.lit("_segment_"), F.format_string("%04d", F.col("turn"))).alias("segment_id"),
            "role", "text", (F.col("conv_id") % 2).cast("int").alias("label"),
            (F.length("text") / F.lit(CHARS_PER_SECOND)).alias("duration"),
            (F.length("text") % 101 / F.lit(100.0)).alias("score"))
        timed = ordered.running(base, ["session_id"], ["segment_idx"], ordered.chunk_of("segment_idx", TURNS_PER_CHUNK),
                                {"end_time": ("sum", F.col("duration"))})
        return timed.withColumn("start_time", F.col("end_time") - F.col("duration"))

    @cached_property
    def words(self) -> DataFrame:
        """Words of a segment, spaced evenly, each spoken for three quarters of its slot."""
        from ..functions import text as tx
        s = self.segments.withColumn("_w", tx.tokens("text"))
        slot = F.col("duration") / F.size("_w")
        exploded = s.select("session_id", "segment_idx", "segment_id", "start_time", "end_time", "duration", slot.alias("_slot"), F.posexplode("_w").alias("word_idx", "word"))
        start = F.col("start_time") + F.col("_slot") * F.col("word_idx")
        return exploded.select(
            "session_id", "segment_idx", "segment_id", "start_time", "end_time", "duration",
            F.col("word_idx").cast("long").alias("word_idx"), "word",
            start.alias("word_start"), (start + F.col("_slot") * 0.75).alias("word_end"),
            (F.length("word") % 10 / 10.0).alias("word_score"))

    @cached_property
    def frames(self) -> DataFrame:
        """Frame series: the events of a user in time order, 100 frames a second."""
        numbered = ordered.dense_index(
            self.table("events").select(F.col("user_id").alias("series_id"), "event_id", "ts", "value", "event_type"),
            ["series_id"], ["ts", "event_id"], ordered.ten_minutes("ts"), "frame_idx")
        return numbered.withColumns({"t": F.col("frame_idx") / F.lit(100.0), "level": F.sqrt("value")})

    @cached_property
    def features(self) -> DataFrame:
        """Wide acoustic features of segments; orders are sessions."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("segment_idx"),
            (F.col("l_orderkey") % 2).cast("int").alias("label"),
            F.col("l_quantity").alias("loudness"), F.col("l_extendedprice").alias("F0"),
            F.col("l_discount").alias("jitter"), F.col("l_tax").alias("shimmer"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Frame vectors: subject = label, two passages by vector number."""
        return self.table("embeddings").select(
            F.concat(F.lit("subj_"), F.col("label").cast("string")).alias("subject"),
            F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("vec"))


SQL = {
    "segments": """
seg0 AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS segment_idx,
    CAST(conv_id AS VARCHAR) || '_segment_' || printf('%04d', turn) AS segment_id,
    role, text, CAST(conv_id % 2 AS INTEGER) AS label,
    CAST(length(text) AS DOUBLE) / CAST(16 AS DOUBLE) AS duration,
    CAST(length(text) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM conversations),
segments AS (SELECT *, end_time - duration AS start_time FROM (SELECT *, sum(duration) OVER (PARTITION BY session_id ORDER BY segment_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_time FROM seg0))""",
    "tokens": r"""
toks AS (SELECT *, list_filter(string_split_regex(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda x: x <> '') AS w,
    list_filter(string_split_regex(lower(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda x: x <> '') AS lw FROM segments)""",
    "words": """
wlong AS (SELECT session_id, segment_idx, segment_id, start_time, end_time, duration, unnest(w) AS word,
    generate_subscripts(w, 1) - 1 AS word_idx, duration / len(w) AS slot FROM toks),
words AS (SELECT session_id, segment_idx, segment_id, start_time, end_time, duration, word_idx, word, start_time + slot * word_idx AS word_start,
    start_time + slot * word_idx + slot * CAST(0.75 AS DOUBLE) AS word_end, CAST(length(word) % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS word_score FROM wlong)""",
    "frames": """
fr0 AS (SELECT user_id AS series_id, event_id, value, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events),
frames AS (SELECT *, CAST(frame_idx AS DOUBLE) / CAST(100 AS DOUBLE) AS t, sqrt(value) AS level FROM fr0)""",
    "features": """
features AS (SELECT l_orderkey AS session_id, l_linenumber AS segment_idx, CAST(l_orderkey % 2 AS INTEGER) AS label,
    l_quantity AS loudness, l_extendedprice AS "F0", l_discount AS jitter, l_tax AS shimmer FROM lineitem)""",
    "vectors": """
vectors AS (SELECT 'subj_' || CAST(label AS VARCHAR) AS subject, vec_id AS frame_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)""",
}


def with_sql(names: str, body: str) -> str:
    """An oracle query: the named logical tables, then ``body``."""
    needs = {"words": ["segments", "tokens", "words"], "tokens": ["segments", "tokens"]}
    parts: list[str] = []
    for name in names.split():
        for part in needs.get(name, [name]):
            if part not in parts:
                parts.append(part)
    body = body.strip()
    ctes = ",".join(SQL[p] for p in parts)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _media_listing(self: Tables) -> DataFrame:
    """Media files by path: customers are recordings, the order status names the label folder."""
    o = self.table("orders")
    ext = F.element_at(F.create_map(*[F.lit(x) for kv in EXT_OF.items() for x in kv]), F.col("o_orderpriority"))
    folder = F.when(F.col("o_orderstatus") == "F", "0").when(F.col("o_orderstatus") == "O", "1").otherwise("draft")
    file_id = F.concat(F.lit("rec_"), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("listing_id"),
        F.concat(F.lit("audio_wav/"), folder, F.lit("/"), file_id, F.lit("."), ext).alias("path"),
        F.col("o_orderdate").alias("modification_time"))


def _transcript_listing(self: Tables) -> DataFrame:
    """Transcript files: customers with a positive balance."""
    return self.table("customer").where(F.col("c_acctbal") > 0).select(
        F.concat(F.lit("rec_"), F.col("c_custkey").cast("string")).alias("file_id"),
        (F.col("c_nationkey") % 2).cast("int").alias("label"))


EXT_OF = {"1-URGENT": "mp4", "2-HIGH": "WAV", "3-MEDIUM": "mov", "4-NOT SPECIFIED": "txt", "5-LOW": "wav"}
Tables.media_listing = cached_property(_media_listing)
Tables.media_listing.__set_name__(Tables, "media_listing")
Tables.transcript_listing = cached_property(_transcript_listing)
Tables.transcript_listing.__set_name__(Tables, "transcript_listing")

SQL["listing"] = """
listing AS (SELECT o_orderkey AS listing_id, 'audio_wav/' || CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE 'draft' END
    || '/rec_' || CAST(o_custkey AS VARCHAR) || '.' || CASE o_orderpriority WHEN '1-URGENT' THEN 'mp4' WHEN '2-HIGH' THEN 'WAV'
    WHEN '3-MEDIUM' THEN 'mov' WHEN '4-NOT SPECIFIED' THEN 'txt' ELSE 'wav' END AS path, o_orderdate AS modification_time FROM orders)"""
SQL["media"] = r"""
media AS (SELECT listing_id, path, modification_time, CAST(regexp_extract(path, '^audio_wav/([01])/', 1) AS INTEGER) AS label,
    regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS file_id, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext FROM listing
    WHERE regexp_matches(path, '^audio_wav/[01]/') AND lower(regexp_extract(path, '\.([^./]*)$', 1)) IN ('wav', 'mp4', 'mov', 'mkv', 'avi'))"""
SQL["scripts"] = """
scripts AS (SELECT 'rec_' || CAST(c_custkey AS VARCHAR) AS file_id, CAST(c_nationkey % 2 AS INTEGER) AS label FROM customer WHERE c_acctbal > 0)"""
