"""State over video frames: counters, streaks, smoothing, episodes, turns.

Frames carry a dense number per series. All scans run chunk by chunk (see ``ordered``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import ordered

FPS = 30


def _lagged(df: DataFrame, keys: list[str], index: str, cols: dict[str, Column], *, keep: bool = True) -> DataFrame:
    return ordered.over_neighbours(df, keys, index, lambda w: {n: F.lag(c).over(w) for n, c in cols.items()}, 1, 0, keep_chunk=keep)


def falling_edge_count(df: DataFrame, keys: list[str], index: str, value: str, threshold: float, name: str = "blink_count", start: float = 1.0) -> DataFrame:
    """Running count of drops from at least the threshold to below it; before the first frame the value is ``start``."""
    marked = _lagged(df, keys, index, {"_p": F.col(value)})
    edge = (F.col(value) < threshold) & (F.coalesce("_p", F.lit(start)) >= threshold)
    return ordered.running(marked, keys, [index], None, {name: ("sum", edge.cast("long"))}).drop("_p")


def rising_edge_count(df: DataFrame, keys: list[str], index: str, flag: Column, name: str = "face_touch_count") -> DataFrame:
    """Running count of changes from false to true."""
    marked = _lagged(df.withColumn("_f", flag), keys, index, {"_p": F.col("_f")})
    edge = F.col("_f") & ~F.coalesce("_p", F.lit(False))
    return ordered.running(marked, keys, [index], None, {name: ("sum", edge.cast("long"))}).drop("_p", "_f")


def streaks(df: DataFrame, keys: list[str], index: str, flags: dict[str, Column], *, keep_chunk: bool = False) -> DataFrame:
    """Per flag the frames in a row for which it holds: the distance to the last frame where it did not. One scan for all flags."""
    last_off = {f"_off_{n}": ("last", F.when(~flag, F.col(index))) for n, flag in flags.items()}
    out = ordered.running(df, keys, [index], ordered.chunk_of(index), last_off, keep_chunk=keep_chunk)
    return out.withColumns({n: F.col(index) - F.coalesce(f"_off_{n}", F.lit(-1)) for n in flags}).drop(*last_off)


def streak(df: DataFrame, keys: list[str], index: str, flag: Column, name: str, *, keep_chunk: bool = False) -> DataFrame:
    return streaks(df, keys, index, {name: flag}, keep_chunk=keep_chunk)


def leaky_counter(df: DataFrame, keys: list[str], index: str, away: Column, name: str = "gaze_away_time", fps: int = FPS) -> DataFrame:
    """+1 frame while away, -1 otherwise, never below 0, in seconds.

    With S the running sum of the steps, the counter is S minus the lowest S so far (at most 0).
    """
    low = ordered.running_low(df, keys, [index], ordered.chunk_of(index), F.when(away, 1).otherwise(-1).cast("long"), "_s", "_m")
    return low.withColumn(name, (F.col("_s") - F.least(F.lit(0), F.col("_m"))) / fps).drop("_s", "_m")


#: Frames a smoothing block holds at most.
BLOCK_FRAMES = 1 << 20


def exponential_smoothing(df: DataFrame, keys: list[str], index: str, value: str, name: str, alpha: float = 0.3) -> DataFrame:
    """y = alpha x + (1 - alpha) y before, starting from 0; as exact as the loop, whatever the size of earlier values.

    The weights inside a short block are explicit powers, so a block is a plain running sum and carries one affine map
    (decay, end). A group of blocks composes its maps in order. Groups are so long that a whole one weighs less than the least
    double times the inverse of the largest: what a group carries on is its own end alone, and no earlier value is cut.
    """
    if alpha <= 0:
        return df.withColumn(name, F.lit(0.0))
    keep = 1.0 - alpha
    block = max(1, min(BLOCK_FRAMES, math.floor(-math.log(1e8) / math.log(keep)))) if keep > 0 else 1
    decay = keep ** block
    group = max(2, math.ceil(-math.log(1e300) * 2.2 / math.log(decay))) if decay > 0 else 2
    b, p = F.floor(F.col(index) / block).cast("long"), F.col(index) % block
    boosted = F.col(value) * alpha * F.pow(F.lit(keep), -p)
    numbered = df.withColumns({"_b": b, "_p": p})
    w = ordered.Window.partitionBy(*keys, "_b").orderBy(index).rowsBetween(ordered.Window.unboundedPreceding, 0)
    local = numbered.withColumn("_y", F.sum(boosted).over(w) * F.pow(F.lit(keep), F.col("_p")))
    ends = numbered.groupBy(*keys, "_b").agg((F.coalesce(F.sum(boosted), F.lit(0.0)) * keep ** (block - 1)).alias("_e"))
    groups = ends.groupBy(*keys, F.floor(F.col("_b") / group).cast("long").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_b", "_e"))).alias("_l"))
    composed = groups.withColumn("_before", F.aggregate("_l", F.array(F.lit(0.0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) * decay + x["_e"]))))
    linked = ordered.over_neighbours(composed, keys, "_g", lambda win: {"_in": F.coalesce(F.lag(F.element_at("_before", -1)).over(win), F.lit(0.0))}, 1, 0)
    carried = linked.select(*keys, "_before", "_in", F.posexplode("_l").alias("_at", "_x")).select(
        *keys, F.col("_x._b").alias("_b"), (F.get("_before", F.col("_at")) + F.pow(F.lit(decay), F.col("_at")) * F.col("_in")).alias("_c"))
    out = local.join(carried, [*keys, "_b"])
    return out.select(*df.columns, (F.coalesce("_y", F.lit(0.0)) + F.col("_c") * F.pow(F.lit(keep), F.col("_p") + 1)).alias(name))


def rolling_stability(df: DataFrame, keys: list[str], index: str, x: str, y: str, name: str = "head_stability", size: int = 10, least: int = 5) -> DataFrame:
    """1 - 100 x mean variance of the last positions, clamped; 1 until there are enough."""
    def expr(w):
        last = w.rowsBetween(-(size - 1), 0)
        var = (F.var_pop(x).over(last) + F.var_pop(y).over(last)) / 2
        return {name: F.when(F.count(x).over(last) >= least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - var * 100))).otherwise(1.0)}
    return ordered.over_neighbours(df, keys, index, expr, size, 0)


def baseline_ratio(df: DataFrame, keys: list[str], index: str, value: str, first: int = 11) -> DataFrame:
    """Mean of the first distances and the ratio to it; null in series shorter than that."""
    head = F.when(F.col(index) < first, F.col(value))
    base = df.groupBy(*keys).agg(F.when(F.max(index) >= first - 1, F.avg(head)).alias("baseline"), F.max(index).alias("_top"))
    return ordered.attach(df, base, keys, index).withColumn("distance_ratio", F.col(value) / F.col("baseline"))


def since_change(df: DataFrame, keys: list[str], index: str, value: Column, t: str, every: int, name: str = "emotion_duration") -> DataFrame:
    """Time since the current label began, the label being looked at on every ``every``-th frame only."""
    sampled = F.when(F.col(index) % every == 0, value)
    held = ordered.running(df, keys, [index], ordered.chunk_of(index),
                           {"current": ("last", sampled), "_before": ("last_before", sampled)}, keep_chunk=True)
    began = F.when(~F.col("current").eqNullSafe(F.col("_before")), F.col(t))
    out = ordered.running(held, keys, [index], None, {"_t0": ("last", began)})
    return out.withColumn(name, F.col(t) - F.col("_t0")).drop("_t0", "_before")


def risk_state_flags(df: DataFrame) -> DataFrame:
    """Four risk markers with the values that explain them."""
    return df.withColumns({
        "head_down_long": F.col("head_down") & (F.col("head_down_duration") >= 3.0),
        "gaze_avoidance": ~F.col("looking_at_camera") & (F.col("gaze_away_time") >= 5.0),
        "long_sadness": (F.col("emotion") == "sad") & (F.col("emotion_duration") >= 5.0),
        "low_head_stability": F.col("head_stability") < 0.5,
        "payload": F.create_map(
            F.lit("head_down_duration"), F.bround("head_down_duration", 2), F.lit("gaze_away_time"), F.bround("gaze_away_time", 2),
            F.lit("emotion_duration"), F.bround("emotion_duration", 2), F.lit("head_stability"), F.bround("head_stability", 2))})


def concurrent_risks(df: DataFrame, sad_seconds: float = 15.0) -> Column:
    """How many markers hold at once, sadness counting only after ``sad_seconds``."""
    parts = [F.col("head_down") & (F.col("head_down_duration") > 3), ~F.col("looking_at_camera") & (F.col("gaze_away_time") > 5),
             (F.col("emotion") == "sad") & (F.col("emotion_duration") > sad_seconds), F.col("head_stability") < 0.5]
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0))


def episodes(df: DataFrame, keys: list[str], index: str, t: str, flag: Column, event: str, payload: Column) -> DataFrame:
    """One row per stretch of a flag: it ends at the first frame without it, or at the last frame.

    Rows of a stretch are counted together by a run number, so a long stretch is reduced on the map side.
    """
    base = df.select(*keys, index, t, F.coalesce(flag, F.lit(False)).alias("_f"), payload.alias("_pay"))
    marked = ordered.over_neighbours(
        base, keys, index, lambda w: {"_next": F.lead(t).over(w), "_was": F.coalesce(F.lag("_f").over(w), F.lit(False))}, 1, 1, keep_chunk=True)
    numbered = ordered.running(marked, keys, [index], None, {"_run": ("sum", (F.col("_f") & ~F.col("_was")).cast("long"))})
    runs = numbered.where(F.col("_f")).groupBy(*keys, "_run").agg(
        F.min(t).alias("_s"), F.max_by(F.coalesce("_next", t), index).alias("_e"), F.max_by("_pay", index).alias("details"))
    return runs.select(*keys, F.lit(event).alias("event"), F.bround("_s", 2).alias("start_time"), F.bround("_e", 2).alias("end_time"),
                       F.bround(F.col("_e") - F.col("_s"), 2).alias("duration"), "details")


def turns(df: DataFrame, keys: list[str], index: str, level: str, threshold: float, threshold2: float, n_pre: int = 10, n_post: int = 20,
          max_frames: int | None = None) -> DataFrame:
    """Speech turns with hysteresis, as first and last frame.

    A turn starts with a stretch of n_pre frames above ``threshold`` and ends before a stretch of n_post
    frames below ``threshold2``. Stretches are distances to the last frame that broke them, the state is
    the last start or end seen. Turns longer than ``max_frames`` are cut into pieces of that length.
    """
    x, i = F.col(level), F.col(index)
    loud, quiet = x > threshold, x < threshold2
    streaks = ordered.running(df.select(*keys, index, level), keys, [index], ordered.chunk_of(index), {
        "_loud0": ("last", F.when(~loud, i)), "_quiet0": ("last", F.when(~quiet, i))}, keep_chunk=True)
    on = i - F.coalesce("_loud0", F.lit(-1)) == n_pre
    off = i - F.coalesce("_quiet0", F.lit(-1)) == n_post
    signal = F.when(on, 1).when(off, 0)
    state = ordered.running(streaks, keys, [index], None, {"_on": ("last", signal), "_was": ("last_before", signal)}, keep_chunk=True)
    starts = on & (F.coalesce("_was", F.lit(0)) == 0)
    numbered = ordered.running(state, keys, [index], None, {"turn": ("sum", starts.cast("long"))})
    length = df.groupBy(*keys).agg(F.max(index).alias("_n"))
    spans = numbered.where(F.col("_on") == 1).groupBy(*keys, "turn").agg(F.min(index).alias("_a"), F.max(index).alias("_b")).join(length, keys)
    out = spans.select(*keys, "turn", (F.col("_a") - n_pre + 1).alias("first_frame"),
                       F.when(F.col("_b") < F.col("_n"), F.col("_b") + 1 - n_post).otherwise(F.col("_b")).alias("last_frame"))
    if max_frames is None:
        return out
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last_frame") - F.col("first_frame")) / max_frames)))
    cut = out.withColumn("piece", piece).withColumn("_s", F.col("first_frame") + F.col("piece") * max_frames)
    return cut.select(*keys, "turn", "piece", F.col("_s").alias("first_frame"), F.least(F.col("_s") + max_frames - 1, F.col("last_frame")).alias("last_frame"))


def adaptive_gate(df: DataFrame, keys: list[str], index: str, gate: str, frames: int = 200) -> DataFrame:
    """Keep frames at or above the mean of the frames before them; the first frame has no mean and is kept."""
    out = ordered.over_neighbours(df, keys, index, lambda w: {"threshold": F.avg(gate).over(w.rowsBetween(-frames, -1))}, frames, 0)
    return out.where(F.col("threshold").isNull() | (F.col(gate) >= F.col("threshold")))


def event_rate(count: Column, elapsed: Column) -> Column:
    return sc.safe_div(count.cast("double") * 60, elapsed)
