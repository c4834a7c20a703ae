"""Windows over the segments and signals of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACOUSTIC_INSIGHTS, ACOUSTIC_SIGNALS, VIDEO_SIGNALS
from ..functions import scalars as sc
from . import ordered
from .reports import insights
from .scoring import top_per_session


def start_gap(df: DataFrame, session: str, order: list[str], chunk: Column) -> DataFrame:
    """Step from the previous start, and the true pause since the previous end."""
    out = ordered.previous(df, [session], order, chunk, {"_s": F.col("start_time"), "_e": F.col("end_time")})
    return out.withColumns({"start_gap": F.col("start_time") - F.col("_s"), "pause": F.col("start_time") - F.col("_e")}).drop("_s", "_e")


def score_jump(df: DataFrame, session: str, order: list[str], chunk: Column, score: str = "score") -> DataFrame:
    out = ordered.previous(df, [session], order, chunk, {"_p": F.col(score)})
    return out.withColumn("jump", F.abs(F.col(score) - F.col("_p"))).drop("_p")


def minmax_normalize(df: DataFrame, session: str, index: str, signals: dict[str, bool], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min) within the session; ``signals[name]`` says whether to invert.

    A constant signal gives 0.5, a signal without values 0, a missing value 0. The extremes are an
    aggregate joined back, so they combine on the map side and a long session is not one task.
    """
    cells = {s: sc.finite(s) for s in signals}
    stats = df.groupBy(session).agg(*[f(c).alias(f"_{n}_{s}") for s, c in cells.items() for n, f in (("lo", F.min), ("hi", F.max))],
                                    F.max(index).alias("_top"))

    def scaled(s: str, invert: bool) -> Column:
        x, lo, hi = cells[s], F.col(f"_lo_{s}"), F.col(f"_hi_{s}")
        flat = F.abs(lo - hi) <= 1e-8 + 1e-5 * F.abs(hi)
        y = F.when(lo.isNull(), 0.0).when(flat, 0.5).otherwise(F.coalesce((x - lo) / F.when(flat, F.lit(1.0)).otherwise(hi - lo), F.lit(0.0)))
        return 1.0 - y if invert else y

    joined = ordered.attach(df, stats, [session], index)
    return joined.select(*df.columns, *[scaled(s, inv).alias(f"{s}{suffix}") for s, inv in signals.items()])


def video_risk(frames: DataFrame, session: str, index: str) -> DataFrame:
    """Weighted sum of the normalized signals that exist; y is the clamped score."""
    present = [(c, label, w, inv) for c, label, w, inv in VIDEO_SIGNALS if c in frames.columns]
    n = minmax_normalize(frames, session, index, {c: inv for c, _, _, inv in present})
    total = sum((F.col(f"{c}_norm") * w for c, _, w, _ in present), F.lit(0.0))
    signals = F.array(*[F.struct(F.lit(label).alias("feature"), sc.clamp01(F.col(f"{c}_norm")).alias("value")) for c, label, _, _ in present])
    return n.withColumn("raw_score", total).withColumns({"y": sc.clamp01("raw_score"), "signals": signals})


def video_risk_markers(frames: DataFrame, session: str, index: str, k: int = 4, drivers: int = 3) -> DataFrame:
    """The k highest frames with their strongest non-zero signals; ties keep the order of the signals."""
    top = top_per_session(video_risk(frames, session, index), session, "raw_score", [index], k)
    tagged = F.transform("signals", lambda s, i: F.struct((-s["value"]).alias("o"), i.alias("i"), s["feature"].alias("feature"), s["value"].alias("value")))
    best = F.filter(F.slice(F.array_sort(tagged), 1, drivers), lambda s: s["value"] > 0)
    return top.withColumn("top_signals", F.transform(best, lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"))))


def acoustic_index(segments: DataFrame, session: str, index: str) -> DataFrame:
    """Weighted index of pauses, slowness, articulation, confidence and energy; x is the segment midpoint."""
    present = [(c, w, inv) for c, w, inv in ACOUSTIC_SIGNALS if c in segments.columns]
    n = minmax_normalize(segments, session, index, {c: inv for c, _, inv in present})
    n = n.withColumns({f"{c}_norm": F.lit(0.0) for c, _, _ in ACOUSTIC_SIGNALS if c not in segments.columns})
    total = sum((F.col(f"{c}_norm") * w for c, w, _ in ACOUSTIC_SIGNALS), F.lit(0.0))
    middle = F.col("start_time") + F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")) / 2
    return n.withColumns({"x": middle, "y": sc.clamp01(total)})


def acoustic_profile(index: DataFrame, session: str, order: str) -> DataFrame:
    """Session means of the five signals and the index, added in segment order, with the messages they call for."""
    p = ordered.moments(index, [session], [order], ordered.chunk_of(order, 4096), {**{c: F.col(f"{c}_norm") for c, _, _ in ACOUSTIC_SIGNALS}, "acoustic_risk": F.col("y")}).drop("n")
    rules = [(F.col(c) >= limit if op == ">=" else F.col(c) < limit, text) for c, op, limit, text in ACOUSTIC_INSIGHTS]
    return p.withColumn("insights", insights(rules))


def split_segments(df: DataFrame, max_duration: float = 5.0) -> DataFrame:
    """Segments longer than the maximum become floor(d / max) + 1 equal parts. One row in, few rows out."""
    n = F.when(F.col("duration") > max_duration, F.floor(F.col("duration") / max_duration) + 1).otherwise(F.lit(1)).cast("long")
    parts = df.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    size = F.col("duration") / F.col("_n")
    return parts.withColumns({
        "part_start": F.col("start_time") + F.col("part") * size,
        "part_end": F.least(F.col("start_time") + (F.col("part") + 1) * size, F.col("end_time"))}).drop("_n")


def renumber_parts(parts: DataFrame, session: str, order: list[str], chunk: Column) -> DataFrame:
    """New segment ids over the parts of a session."""
    out = ordered.dense_index(parts, [session], order, chunk, "new_idx")
    return out.withColumn("new_segment_id", F.concat(session, F.lit("_segment_"), F.format_string("%04d", "new_idx")))


def answer_intervals(questions: DataFrame, session: str, index: str, media_end: str) -> DataFrame:
    """From the end of a question to the end of the next one; empty or past the recording is skipped."""
    out = ordered.over_neighbours(questions, [session], index, lambda w: {"answer_end": F.lead("end_time").over(w)}, 0, 1, 4096)
    out = out.withColumn("answer_start", F.col("end_time"))
    return out.where((F.col("answer_start") < F.col("answer_end")) & (F.col("answer_end") <= F.col(media_end)))


def chunk_index(frames: DataFrame, session: str, t: str, index: str, seconds: float = 15.0, at_most: int | None = None) -> DataFrame:
    """Chunk of each frame with its clipped bounds; with ``at_most`` the first so many frames of each chunk.

    The window is per chunk, whose frames are bounded by its length in seconds.
    """
    d = frames.groupBy(session).agg(F.max(t).alias("_d"), F.max(index).alias("_top"))
    c = ordered.attach(frames, d, [session], index).withColumn("chunk", F.floor(F.col(t) / seconds).cast("long"))
    c = c.withColumns({"chunk_start": F.col("chunk") * F.lit(seconds), "chunk_end": F.least((F.col("chunk") + 1) * F.lit(seconds), F.col("_d"))})
    kept = c.where(F.col("chunk_end") > F.col("chunk_start"))
    if at_most is None:
        return kept.drop("_d")
    w = Window.partitionBy(session, "chunk").orderBy(index)
    kept = kept.withColumn("_rn", F.row_number().over(w))
    return kept.where(F.col("_rn") <= at_most).drop("_rn", "_d")
