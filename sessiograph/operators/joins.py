"""Joins beyond plain equality: tolerance, interval, priority, nearest, frame ranges.

Each one is turned into an equi-join on a bucket or a rank, so Spark never falls back to comparing all
pairs of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import ordered


def join_segments_features(segments: DataFrame, features: DataFrame, session: str = "session_id", segment: str = "segment_id") -> DataFrame:
    """Inner join on (session, segment) after bringing both ids to one spelling; the key appears once."""
    left = segments.withColumn(session, sc.base_session_id(session))
    right = features.withColumn(session, sc.base_session_id(session))
    return left.where(F.col(session).isNotNull()).join(right, [session, segment])


def keep_common(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the sessions present on both."""
    return a.join(b.select(key), key, "left_semi"), b.join(a.select(key), key, "left_semi")


def tolerance_join(df: DataFrame, other: DataFrame, key: str, tolerance: float = 0.01, how: str = "left") -> DataFrame:
    """Rows whose start and end both differ by less than ``tolerance``.

    The start is cut into buckets of the tolerance; a row of the small-range side is looked up in its own
    bucket and the two beside it, so the join is an equi-join on (key, bucket). ``other`` keeps its columns
    under their names; its start and end are called ``_start`` and ``_end``. The last match by start wins.
    """
    cell = F.floor(F.col("start_time") / tolerance).cast("long")
    left = df.withColumn("_cell", cell).withColumn("_row", F.monotonically_increasing_id())
    right = (other.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
             .withColumnRenamed("start_time", "_start").withColumnRenamed("end_time", "_end"))
    near = (F.abs(left["start_time"] - right["_start"]) < tolerance) & (F.abs(left["end_time"] - right["_end"]) < tolerance)
    same = (left[key] == right[key]) & (left["_cell"] == right["_cell"])
    values = [c for c in other.columns if c not in (key, "start_time", "end_time")]
    joined = left.join(right, same & near, how)
    pick = F.max_by(F.struct(*[right[c] for c in values]), F.struct(right["_start"], right["_end"]))
    own = F.first(F.struct(*[left[c] for c in df.columns]))  # equal rows stay as many as they are
    return joined.groupBy("_row").agg(pick.alias("_m"), own.alias("_own")).select("_own.*", *[F.col(f"_m.{c}").alias(c) for c in values])


def interval_join_words(parts: DataFrame, words: DataFrame, keys: list[str], start: str = "part_start", end: str = "part_end") -> DataFrame:
    """Words of a segment to its parts: a word belongs where it starts or where it ends, so one that
    straddles a cut belongs to both. ``keys`` name the segment, whose parts are equally long and numbered in ``part``.

    Each word meets only the parts its ends fall into (and their neighbours, for rounding), never all parts of a long segment.
    """
    first = F.min_by(F.struct(F.col(start).alias("s"), (F.col(end) - F.col(start)).alias("w")), "part")
    shape = parts.groupBy(*keys).agg(first.alias("_f"))
    at = [F.floor((F.col(c) - F.col("_f.s")) / F.nullif(F.col("_f.w"), F.lit(0.0))) for c in ("word_start", "word_end")]
    near = F.array_distinct(F.array(*[F.coalesce(p, F.lit(0)).cast("long") + d for p in at for d in (-1, 0, 1)]))
    words = words.join(shape, keys).withColumn("_part", F.explode(near)).drop("_f")
    parts = parts.withColumn("_part", F.col("part").cast("long"))
    hit = (((F.col("word_start") >= F.col(start)) & (F.col("word_start") < F.col(end)))
           | ((F.col("word_end") > F.col(start)) & (F.col("word_end") <= F.col(end))))
    return parts.join(words, [*keys, "_part"]).where(hit).drop("_part")


def priority_join(df: DataFrame, candidates: Column, other: DataFrame, key: str, row_id: str) -> DataFrame:
    """The first of several ids of a row that exists in ``other``; rows without any are left out.

    Candidates are exploded with their rank, joined by equality, and the lowest rank is kept by an
    aggregate.
    """
    tried = df.select(row_id, F.posexplode(candidates).alias("_rank", key))
    known = other.select(key).distinct()
    best = tried.join(known, key).groupBy(row_id).agg(F.min_by(key, "_rank").alias(key), F.min("_rank").alias("rank"))
    return df.join(best, row_id)


def _substrings(c: str) -> Column:
    """Every distinct substring; ids are short, so this is a bounded list."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col(c), i, k)))))


def substring_match(rest: DataFrame, known: DataFrame, key: str, row_id: str, wanted: str) -> DataFrame:
    """The smallest id that contains the wanted one or is contained in it.

    Substrings are joined by equality. On the container side each substring keeps only its smallest id,
    reduced on the map side, so a fragment shared by all ids still yields one row and no pairs.
    """
    asked = rest.select(row_id, F.col(wanted).alias("_w")).where(F.length("_w") > 0)
    have = known.select(F.col(key).alias("_k")).where(F.length("_k") > 0).distinct()
    containers = have.select("_k", F.explode(_substrings("_k")).alias("_w")).groupBy("_w").agg(F.min("_k").alias("_k"))
    inside = asked.join(containers, "_w").select(row_id, "_k")
    around = asked.select(row_id, F.explode(_substrings("_w")).alias("_k")).join(have, "_k").select(row_id, "_k")
    return inside.unionByName(around).groupBy(row_id).agg(F.min("_k").alias(key))


def frame_range_join(chunks: DataFrame, frames: DataFrame, keys: list[str], vec: str, cell: int = 64) -> DataFrame:
    """Mean vector of the frames [first_frame, last_frame) of each chunk.

    Each distinct range is computed once, however many chunks share it. A range is exploded over the cells of ``cell`` frames it covers and joined on (keys, cell); a frame
    then meets only chunks of its own cell. Elements are averaged on the map side.
    """
    from .series import vector_mean
    bounds = [*keys, "first_frame", "last_frame"]
    cells = F.sequence(F.floor(F.col("first_frame") / cell), F.floor((F.col("last_frame") - 1) / cell))
    ranges = chunks.where(F.col("last_frame") > F.col("first_frame")).select(*bounds).distinct()
    spread = ranges.select(*bounds, F.explode(cells).alias("_cell"))
    placed = frames.withColumn("_cell", F.floor(F.col("frame_idx") / cell))
    hit = spread.join(placed, [*keys, "_cell"]).where((F.col("frame_idx") >= F.col("first_frame")) & (F.col("frame_idx") < F.col("last_frame")))
    return chunks.join(vector_mean(hit.select(*bounds, vec), bounds, vec), bounds)


def chunk_frames_by_index(chunks: DataFrame, lengths: DataFrame, keys: list[str], default: int = 15) -> DataFrame:
    """Frames of the i-th chunk (from 1), the last window if it lies past the end. Needs segment_index, duration."""
    d = F.coalesce(F.greatest(F.lit(1), F.bround("duration")), F.lit(default)).cast("long")
    c = chunks.join(lengths, keys, "left").withColumn("_d", d)
    c = c.withColumn("_s", (F.coalesce("segment_index", F.lit(1)) - 1) * F.col("_d"))
    c = c.withColumn("first_frame", F.when(F.col("_s") >= F.col("n_frames"), F.greatest(F.lit(0), F.col("n_frames") - F.col("_d"))).otherwise(F.col("_s")))
    return c.withColumn("last_frame", F.least(F.col("first_frame") + F.col("_d"), F.col("n_frames"))).drop("_s", "_d")


def chunk_frames_by_time(chunks: DataFrame, lengths: DataFrame, keys: list[str], default: int = 15) -> DataFrame:
    """Frames of a chunk by index and rounded-up duration, or by its times where the index is missing."""
    c = chunks.join(lengths, keys, "left")
    indexed = F.coalesce(F.col("segment_index") >= 1, F.lit(False))
    start = F.when(indexed, (F.col("segment_index") - 1) * default).otherwise(F.floor(F.coalesce("start_time", F.lit(0.0))))
    size = F.when(F.col("duration") > 0, F.ceil("duration")).otherwise(F.lit(default))
    end = F.when(indexed, start + size).otherwise(F.ceil(F.coalesce(F.col("end_time"), F.coalesce("start_time", F.lit(0.0)) + default)))
    return c.withColumns({"first_frame": F.greatest(F.lit(0), start).cast("long"), "last_frame": F.least(end, F.col("n_frames")).cast("long")})


def alignment_reasons(chunks: DataFrame, subjects: DataFrame, subject_key: str) -> DataFrame:
    """Chunks by outcome: aligned, no subject, no passage, zero length. ``n_frames`` is null without a passage."""
    marked = chunks.join(subjects.select(subject_key).distinct().withColumn("_known", F.lit(True)), subject_key, "left")
    reason = (F.when(F.col("_known").isNull(), "no_subject").when(F.col("n_frames").isNull(), "no_passage")
              .when(F.col("last_frame") <= F.col("first_frame"), "zero_length").otherwise("aligned"))
    return marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("chunks"))


def nearest_point(points: DataFrame, targets: DataFrame, keys: list[str], x: str, y: str, target: str, chunk_width: float) -> DataFrame:
    """Nearest timeline point of each target, the earlier one on equal distance.

    Both tables are stacked and scanned once in each direction; the last point before and the first point
    after are carried across chunks, so no pair of a session is ever compared. Points carry ``tie`` to
    order equal x.
    """
    pts = points.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_kind"), F.col("tie").cast("long").alias("_tie"), F.lit(None).cast("long").alias("_id"),
                        F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p"))
    tgt = targets.select(*keys, F.col(target).alias("_x"), F.lit(1).alias("_kind"), F.col("target_id").cast("long").alias("_tie"),
                         F.col("target_id").cast("long").alias("_id"), F.lit(None).cast("struct<x:double,y:double>").alias("_p"))
    both = pts.unionByName(tgt)
    # of points at the same x the first counts, as in a scan that only moves on when strictly nearer
    both = both.withColumn("_back", -F.col("_x")).withColumn("_rtie", -F.col("_tie"))
    cell = F.floor(F.col("_x") / chunk_width).cast("long")
    fore = ordered.running(both, keys, ["_x", "_kind", "_rtie"], cell, {"_before": ("last", F.col("_p"))})
    both_ways = ordered.running(fore, keys, ["_back", "_kind", "_rtie"], -cell, {"_after": ("last", F.col("_p"))})
    t = both_ways.where(F.col("_kind") == 1)
    db, da = F.col("_x") - F.col("_before.x"), F.col("_after.x") - F.col("_x")
    closest = F.when(F.col("_before").isNull() | (da < db), F.col("_after")).otherwise(F.col("_before"))
    return t.select(*keys, F.col("_id").alias("target_id"), F.col("_x").alias(target), closest["x"].alias("nearest_x"), closest["y"].alias("nearest_y"))


def frame_sync(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Fields of several levels side by side at the same frame."""
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level, keys)
    return out


def positional(a: DataFrame, b: DataFrame, instance: str) -> DataFrame:
    """Rows of two tables with the same instance number."""
    return a.join(b, instance)


def with_instance_number(df: DataFrame, name: str = "instance_id") -> DataFrame:
    """Number rows from 0 in file order: rows are counted per input partition, then offset.

    The row number inside a partition comes from ``monotonically_increasing_id``; only the list of
    partition sizes is carried, one small row per partition.
    """
    bits = 33
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    marked = marked.withColumns({"_p": F.shiftright("_m", bits), "_i": F.col("_m").bitwiseAND(F.lit((1 << bits) - 1))})
    sizes = marked.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return marked.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_m", "_p", "_i", "_o")


def label_lookup(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join of a (key, label) lookup; AQE broadcasts it when its measured size allows."""
    return df.join(labels.select(key, "label"), key, "left")


def annotation_media(annotations: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Annotations with their media; ``matched`` says whether there is any."""
    return annotations.join(media, key, "left").withColumn("matched", F.col("path").isNotNull())
