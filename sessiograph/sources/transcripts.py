"""Transcripts: nested documents of segments and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx

SCHEMA = "segments array<struct<id:string,start:string,`end`:string,text:string,words:array<struct<word:string,start:double,`end`:double,score:double>>>>"


def scan_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; the id is the name of its folder or file. Times stay text until they are coerced."""
    df = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def scan_transcript_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row per line: many documents a file, each with its id in ``key``; files are split between tasks."""
    return spark.read.schema(f"{key} string, {SCHEMA}").json(path)


def explode_segments(transcripts: DataFrame, key: str) -> DataFrame:
    """One row per segment: default id, start and end as numbers, duration not below 0, trimmed text."""
    e = transcripts.select(key, F.posexplode_outer("segments").alias("pos", "s"))
    start = F.coalesce(sc.to_number("s.start"), F.lit(0.0))
    end = F.coalesce(sc.to_number("s.end"), start)
    default = F.format_string("transcript_segment_%04d", F.col("pos"))
    return e.where(F.col("pos").isNotNull()).select(
        key, "pos", F.coalesce("s.id", default).alias("segment_id"), start.alias("start_time"), end.alias("end_time"),
        F.greatest(F.lit(0.0), end - start).alias("duration"), tx.strip_blanks("s.text").alias("text"), F.col("s.words").alias("words"))


def nested(segments: DataFrame, session: str, index: str, words: DataFrame | None = None) -> DataFrame:
    """One document per session, from flat segments (and their words). A document is one value, which Spark limits to 2 GB."""
    s = segments
    if words is not None:
        w = F.array_sort(F.collect_list(F.struct("word_idx", "word", "word_start", "word_end", "word_score")))  # words of one segment
        listed = words.groupBy(session, index).agg(F.transform(w, lambda x: F.struct(
            x["word"].alias("word"), x["word_start"].alias("start"), x["word_end"].alias("end"), x["word_score"].alias("score"))).alias("words"))
        s = s.join(listed, [session, index], "left")
    else:
        s = s.withColumn("words", F.lit(None).cast("array<struct<word:string,start:double,end:double,score:double>>"))
    entry = F.struct(F.col(index), F.struct(F.col("segment_id").alias("id"), F.col("start_time").cast("string").alias("start"), F.col("end_time").cast("string").alias("end"), "text", "words").alias("s"))
    grouped = s.groupBy(session).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return grouped.select(session, F.transform("_l", lambda x: x["s"]).alias("segments"))
