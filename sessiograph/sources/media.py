"""Listings of media files, their labels and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AUDIO_EXTENSIONS, VIDEO_EXTENSIONS
from ..functions import scalars as sc

MEDIA_EXTENSIONS = [*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS]


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, modification time and length of every file below ``root``; the content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root))
    return files.select("path", F.col("modificationTime").alias("modification_time"), "length")


def labelled_media(listing: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Files directly under a folder named 0 or 1, with a known extension; the id is the file stem."""
    out = listing.withColumns({
        "label": F.regexp_extract("path", r"(?:^|/)([01])/[^/]*$", 1),
        "file_id": sc.file_stem("path"), "ext": sc.file_ext("path")})
    return (out.where((F.col("label") != "") & F.col("ext").isin(*(extensions or MEDIA_EXTENSIONS)))
            .withColumn("label", F.col("label").cast("int")))


def samples(media: DataFrame) -> DataFrame:
    """One row per (label, file_id): the last audio path, the last video path, whether there is a wav."""
    audio = F.col("ext").isin(*AUDIO_EXTENSIONS)
    return media.groupBy("label", "file_id").agg(
        F.max(F.when(audio, F.col("path"))).alias("audio_path"), F.max(F.when(~audio, F.col("path"))).alias("video_path"),
        F.max(F.when(audio, F.col("modification_time"))).alias("audio_time"),
        F.max(F.when(~audio, F.col("modification_time"))).alias("video_time"))


def resolve_label_conflicts(sample: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One label per id: one with a transcript under the same label first, else the higher label.

    An aggregate with a struct order, so no group is collected.
    """
    flagged = sample.join(transcripts.select("file_id", "label").distinct().withColumn("has_transcript", F.lit(True)), ["file_id", "label"], "left")
    flagged = flagged.withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False)))
    rest = [c for c in flagged.columns if c != "file_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col("has_transcript"), F.col("label")))
    return flagged.groupBy("file_id").agg(best.alias("_b"), (F.count(F.lit(1)) > 1).alias("conflict")).select("file_id", "_b.*", "conflict")


def needs_conversion(sample: DataFrame) -> DataFrame:
    """Samples with a video and no wav, or a wav older than the video."""
    stale = F.col("video_path").isNotNull() & (F.col("audio_path").isNull() | (F.col("video_time") > F.col("audio_time")))
    return sample.where(stale)


def unprocessed(sample: DataFrame, done: DataFrame, key: str = "file_id") -> DataFrame:
    return sample.join(done.select(key), key, "left_anti")
