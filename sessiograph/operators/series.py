"""Functionals of frame series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..session import durable
from . import ordered
from .quantiles import group_quantiles


def vector_stats(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Element-wise mean, population deviation, minimum and maximum of array columns, per key."""
    long = df.select(*keys, F.posexplode(vec).alias("_pos", "_x"))
    per = long.groupBy(*keys, "_pos").agg(
        F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "m", "s", "lo", "hi")))  # as long as one vector
    out = per.groupBy(*keys).agg(rows.alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{f}").alias(f"{vec}_{n}") for f, n in (("m", "mean"), ("s", "std"), ("lo", "min"), ("hi", "max"))])


def vector_mean(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Element-wise mean of vectors per key; the elements are averaged on the map side first."""
    long = df.select(*keys, F.posexplode(vec).alias("_pos", "_x"))
    per = long.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_m")))  # as long as one vector
    return per.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_m"]).alias(vec))


def smooth_over(w: WindowSpec, value: str, width: int = 3, *, no_zero: bool = False) -> Column:
    """Centred moving average, narrower at the ends. ``no_zero`` leaves zeros out and keeps a zero as zero."""
    near = w.rowsBetween(-(width // 2), width // 2)
    if not no_zero:
        return F.avg(value).over(near)
    voiced = F.avg(F.when(F.col(value) != 0, F.col(value))).over(near)
    return F.when(F.col(value) == 0, 0.0).otherwise(voiced)


def smooth(df: DataFrame, keys: list[str], index: str, value: str, width: int = 3, *, no_zero: bool = False, name: str = "smoothed") -> DataFrame:
    """``smooth_over`` as a column; several columns of one neighbourhood go into one ``over_neighbours``."""
    return ordered.over_neighbours(df, keys, index, lambda w: {name: smooth_over(w, value, width, no_zero=no_zero)}, width // 2, width // 2)


def delta_over(w: WindowSpec, value: str, half: int = 2, *, mode: str = "plain", across_zero: bool = True) -> Column:
    """Regression slope over +-half frames, end values repeated; half 0 is the difference to the frame before.

    mode: plain, abs, halfwave (negative to 0) or relative (divided by the value). Without
    ``across_zero`` a frame whose neighbourhood touches a zero gets 0.
    """
    x = F.col(value)
    touched = [x]
    if half == 0:
        before = F.coalesce(F.lag(x).over(w), x)
        slope = x - before
        touched.append(before)
    else:
        # outside the series the first or last value of the neighbourhood stands in
        near = w.rowsBetween(-half, half)
        first, last = F.first(x).over(near), F.last(x).over(near)
        terms = []
        for n in range(1, half + 1):
            ahead, back = F.coalesce(F.lead(x, n).over(w), last), F.coalesce(F.lag(x, n).over(w), first)
            terms.append(n * (ahead - back))
            touched += [ahead, back]
        slope = sum(terms[1:], terms[0]) / (2 * sum(n * n for n in range(1, half + 1)))
    if not across_zero:
        slope = F.when(F.least(*[F.abs(v) for v in touched]) == 0, 0.0).otherwise(slope)
    return {"plain": slope, "abs": F.abs(slope), "halfwave": F.greatest(slope, F.lit(0.0)),
            "relative": F.when(x != 0, slope / F.when(x == 0, 1.0).otherwise(x)).otherwise(0.0)}[mode]


def delta(df: DataFrame, keys: list[str], index: str, value: str, half: int = 2, *, mode: str = "plain", across_zero: bool = True, name: str = "delta") -> DataFrame:
    """``delta_over`` as a column; several columns of one neighbourhood go into one ``over_neighbours``."""
    reach = max(half, 1)
    return ordered.over_neighbours(df, keys, index, lambda w: {name: delta_over(w, value, half, mode=mode, across_zero=across_zero)}, reach, reach)


def median_filter(df: DataFrame, keys: list[str], index: str, value: str, width: int = 5, name: str = "median") -> DataFrame:
    half = width // 2
    return ordered.over_neighbours(df, keys, index, lambda w: {name: F.percentile(value, 0.5).over(w.rowsBetween(-half, half))}, half, half)


def trend(df: DataFrame, keys: list[str], index: str, value: str, short: int = 5, long: int = 20, flat: float = 0.0) -> DataFrame:
    """Mean of the last ``short`` frames minus that of the last ``long``, to nine places: fall -1, flat 0, rise 1."""
    out = ordered.over_neighbours(df, keys, index, lambda w: {
        "score": F.round(F.avg(value).over(w.rowsBetween(-(short - 1), 0)) - F.avg(value).over(w.rowsBetween(-(long - 1), 0)), 9)}, long, 0)
    return out.withColumn("direction", F.when(F.col("score") > flat, 1).when(F.col("score") < -flat, -1).otherwise(0))


def normalize_series(df: DataFrame, keys: list[str], index: str, value: str, *, variance: bool = False, skip_zero: bool = False, name: str = "normalized") -> DataFrame:
    """Subtract the series mean, divide by its population deviation if asked. ``skip_zero`` ignores zeros and keeps them."""
    x = F.col(value)
    used = F.when(x != 0, x) if skip_zero else x
    stats = df.groupBy(*keys).agg(F.avg(used).alias("_m"), F.stddev_pop(used).alias("_s"), F.max(index).alias("_top"))
    y = x - F.col("_m")
    if variance:
        y = y / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    if skip_zero:
        y = F.when(x == 0, 0.0).otherwise(y)
    return ordered.attach(df, stats, keys, index).withColumn(name, y).drop("_m", "_s")


def saved_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and deviation of each feature as a small table (feature, mean, std), to be stored and used elsewhere."""
    row = df.agg(*[F.struct(F.lit(f).alias("feature"), F.avg(sc.skip_nan(f)).alias("mean"), F.stddev_pop(sc.skip_nan(f)).alias("std")).alias(f"_{i}")
                   for i, f in enumerate(features)])
    return row.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(features))])).alias("s")).select("s.*")


def standardize(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Apply saved statistics; a feature without spread is only centred. The table has one row per feature."""
    wide = stats.agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{f}") for f in features for c in ("mean", "std")])
    joined = ordered.with_scalars(df, wide)
    return joined.select(*[c for c in df.columns if c not in features], *[
        ((F.col(f) - F.col(f"_mean_{f}")) / F.when(F.col(f"_std_{f}") > 0, F.col(f"_std_{f}")).otherwise(1.0)).alias(f) for f in features])


# --- functionals: one row per series (or per series and window) ------------------------------------------


def unit_windows(df: DataFrame, index: str, size: int, step: int, name: str = "window") -> DataFrame:
    """Give each frame the windows [w step, w step + size) it lies in; consecutive windows need no copy."""
    if size == step:
        return df.withColumn(name, F.floor(F.col(index) / size).cast("long"))
    first = F.greatest(F.lit(0), F.floor((F.col(index) - size) / step) + 1)
    return df.withColumn(name, F.explode(F.sequence(first.cast("long"), F.floor(F.col(index) / step).cast("long"))))


def nonzero(x: str) -> Column:
    return F.when(F.col(x) != 0, F.col(x))


def means(x: Column) -> dict[str, Column]:
    nz, a = F.when(x != 0, x), F.abs(x)
    geometric = F.exp(F.avg(F.ln(F.when(x != 0, a))))
    return {
        "amean": F.avg(x), "absmean": F.avg(a), "qmean": F.avg(x * x), "rqmean": F.sqrt(F.avg(x * x)),
        "nzamean": F.avg(nz), "nzabsmean": F.avg(F.abs(nz)), "nzqmean": F.avg(nz * nz), "nzrqmean": F.sqrt(F.avg(nz * nz)), "nzgmean": geometric,
        "posamean": F.avg(F.when(x > 0, x)), "negamean": F.avg(F.when(x < 0, x)), "nnz": F.count(nz),
        "flatness": F.try_divide(geometric, F.avg(F.abs(nz)))}


def moments(x: Column) -> dict[str, Column]:
    return {"amean": F.avg(x), "variance": F.var_pop(x), "stddev": F.stddev_pop(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
            "stddevNorm": F.try_divide(F.stddev_pop(x), F.abs(F.avg(x)))}


PERCENTILES = {"p20": 0.2, "q1": 0.25, "p50": 0.5, "q3": 0.75, "p80": 0.8}


def percentiles(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Percentiles, quartiles, their ranges and the 80/20 quotient; exact for series of any length."""
    q = group_quantiles(df, keys, {"x": x}, PERCENTILES)
    p = {n: F.col(f"x_{n}") for n in PERCENTILES}
    return q.select(*keys, *[c.alias(n) for n, c in p.items()], (p["p50"] - p["q1"]).alias("iqr12"), (p["q3"] - p["p50"]).alias("iqr23"),
                    (p["q3"] - p["q1"]).alias("iqr13"), (p["p80"] - p["p20"]).alias("pctlrange"), F.try_divide(p["p80"], p["p20"]).alias("pctlquot"))


def extremes(df: DataFrame, keys: list[str], index: str, x: str) -> DataFrame:
    """Extremes, their first positions in frames and as share of the series, distance to the mean."""
    v = F.col(x)
    e = df.groupBy(*keys).agg(F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("_m"), F.max(index).alias("_n"),
                              F.min_by(index, F.struct(-v, F.col(index))).alias("max_pos"), F.min_by(index, F.struct(v, F.col(index))).alias("min_pos"))
    return e.select(*keys, "max", "min", (F.col("max") - F.col("min")).alias("range"), "max_pos", "min_pos",
                    (F.col("max_pos") / (F.col("_n") + 1)).alias("max_share"), (F.col("max") - F.col("_m")).alias("max_to_mean"),
                    (F.col("_m") - F.col("min")).alias("min_to_mean"))


def linear_regression(df: DataFrame, keys: list[str], index: str, x: str) -> DataFrame:
    """Slope per frame, offset, mean absolute and mean squared error of the line."""
    i, v = F.col(index).cast("double"), F.col(x)
    fit = df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.covar_pop(i, v), F.var_pop(i)), F.lit(0.0)).alias("slope"), F.avg(i).alias("_i"), F.avg(v).alias("_v"), F.max(index).alias("_top"))
    fit = fit.select(*keys, "slope", (F.col("_v") - F.col("slope") * F.col("_i")).alias("offset"), "_top")
    return _with_errors(df, keys, index, fit, v, F.col("slope") * i + F.col("offset"))


def _with_errors(df: DataFrame, keys: list[str], index: str, fit: DataFrame, v: Column, line: Column) -> DataFrame:
    names = [c for c in fit.columns if c not in (*keys, "_top")]
    err = v - line
    return ordered.attach(df, fit, keys, index).groupBy(*keys).agg(*[F.max(c).alias(c) for c in names], F.avg(F.abs(err)).alias("error_abs"), F.avg(err * err).alias("error_sq"))


def quadratic_regression(df: DataFrame, keys: list[str], index: str, x: str) -> DataFrame:
    """a t^2 + b t + c over a series numbered without gaps, errors, vertex, slopes of the two sides.

    With the frame numbers centred, the odd power sums vanish and the even ones follow from n, so the
    solution is a closed form of n, sum x, sum t x and sum t^2 x. Fewer than three frames give a = 0.
    """
    i, v = F.col(index).cast("double"), F.col(x)
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("x0"), F.sum(i * v).alias("x1"), F.sum(i * i * v).alias("x2"), F.max(index).alias("_top"))
    n, m = F.col("n"), (F.col("n") - 1) / 2
    u2 = n * (n * n - 1) / 12
    u4 = n * (n * n - 1) * (3 * n * n - 7) / 240
    ux, u2x = F.col("x1") - m * F.col("x0"), F.col("x2") - 2 * m * F.col("x1") + m * m * F.col("x0")
    s = s.withColumns({"a": F.when(n > 2, F.try_divide(n * u2x - u2 * F.col("x0"), n * u4 - u2 * u2)).otherwise(0.0),
                       "bu": F.when(n > 1, F.try_divide(ux, u2)).otherwise(0.0)})
    s = s.withColumn("cu", (F.col("x0") - F.col("a") * u2) / n)
    fit = s.select(*keys, "_top", "n", "a", (F.col("bu") - 2 * F.col("a") * m).alias("b"), (F.col("cu") - F.col("bu") * m + F.col("a") * m * m).alias("c"))
    out = _with_errors(df, keys, index, fit, v, F.col("a") * i * i + F.col("b") * i + F.col("c"))
    last = F.col("n") - 1
    vertex = F.when(F.col("a") != 0, F.greatest(F.lit(0.0), F.least(last, F.try_divide(-F.col("b"), 2 * F.col("a")))))

    def at(p: Column) -> Column:
        return F.col("a") * p * p + F.col("b") * p + F.col("c")
    out = out.withColumn("vertex", vertex)
    return out.withColumns({
        "vertex_value": at(F.col("vertex")), "left_slope": F.try_divide(at(F.col("vertex")) - F.col("c"), F.col("vertex")),
        "right_slope": F.try_divide(at(last) - at(F.col("vertex")), last - F.col("vertex"))}).drop("n")


def centroid(t: Column, x: Column) -> Column:
    return F.try_divide(F.sum(t * F.abs(x)), F.sum(F.abs(x)))


def crossings(df: DataFrame, keys: list[str], index: str, x: str) -> DataFrame:
    """Share of frames at which the signal (or the signal minus its mean) changes sign."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.max(index).alias("_top"))
    near = ordered.over_neighbours(df.select(*keys, index, x), keys, index, lambda w: {"_p": F.lag(x).over(w)}, 1, 0, keep_chunk=True)
    c = ordered.attach(near, mean, keys, index)

    def crossed(a: Column, b: Column) -> Column:
        return F.avg(F.coalesce((a * b < 0) | ((a == 0) & (b != 0)), F.lit(False)).cast("double"))
    return c.groupBy(*keys).agg(crossed(F.col("_p"), F.col(x)).alias("zcr"), crossed(F.col("_p") - F.col("_m"), F.col(x) - F.col("_m")).alias("mcr"))


def segments_by_value(df: DataFrame, keys: list[str], index: str, inside: Column, fps: float, min_run: int = 1, min_pause: int = 1) -> DataFrame:
    """Stretches where a condition holds, stretches with a shorter pause than ``min_pause`` joined, then
    those shorter than ``min_run`` dropped: their number, rate and length in seconds."""
    flagged = df.select(*keys, index, F.coalesce(inside, F.lit(False)).alias("_in"))
    stretch = ordered.run_table(flagged, keys, index, "_in").where("_in").drop("_in", "run", "length")
    cell = ordered.chunk_of("first_idx")
    paused = ordered.previous(stretch, keys, ["first_idx"], cell, {"_end": F.col("last_idx")})
    fresh = F.col("_end").isNull() | (F.col("first_idx") - F.col("_end") - 1 >= min_pause)
    grouped = ordered.running(paused, keys, ["first_idx"], cell, {"_g": ("sum", fresh.cast("long"))})
    seg = grouped.groupBy(*keys, "_g").agg((F.max("last_idx") - F.min("first_idx") + 1).alias("_l")).where(F.col("_l") >= min_run)
    sec = F.col("_l") / fps
    stats = seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_segments"), F.avg(sec).alias("mean_len"), F.max(sec).alias("max_len"), F.min(sec).alias("min_len"), F.stddev_pop(sec).alias("std_len"))
    n = df.groupBy(*keys).agg((F.count(F.lit(1)) / fps).alias("_sec"))
    out = n.join(stats, keys, "left").fillna(0)
    return out.withColumn("segments_per_sec", F.col("num_segments") / F.col("_sec")).drop("_sec")


def segments_by_delta(df: DataFrame, keys: list[str], index: str, x: str, fps: float, share: float = 0.2, average_over: int = 10) -> DataFrame:
    """A new segment begins where the value leaves the mean of the frames before it by a share of the range."""
    span = df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("_r"), F.max(index).alias("_top"))
    near = ordered.over_neighbours(df.select(*keys, index, x), keys, index, lambda w: {"_a": F.avg(x).over(w.rowsBetween(-average_over, -1))}, average_over, 0, keep_chunk=True)
    away = ordered.attach(near, span, keys, index).withColumn("_away", F.coalesce(F.abs(F.col(x) - F.col("_a")) > share * F.col("_r"), F.lit(False)))
    edges = ordered.over_neighbours(away, keys, index, lambda w: {"_was": F.coalesce(F.lag("_away").over(w), F.lit(False))}, 1, 0, keep_chunk=True)
    seg = ordered.running(edges, keys, [index], None, {"_s": ("sum", (F.col("_away") & ~F.col("_was")).cast("long"))})
    lengths = seg.groupBy(*keys, "_s").agg((F.count(F.lit(1)) / fps).alias("_l"))
    return lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_segments"), F.avg("_l").alias("mean_len"), F.max("_l").alias("max_len"), F.min("_l").alias("min_len"), F.stddev_pop("_l").alias("std_len"))


def times(df: DataFrame, keys: list[str], index: str, x: str, fps: float) -> DataFrame:
    """Share of time above and below shares of the range, rising, falling, curved left and right; duration."""
    span = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.max(index).alias("_top"))
    near = ordered.over_neighbours(df.select(*keys, index, x), keys, index, lambda w: {"_p": F.lag(x).over(w), "_q": F.lead(x).over(w)}, 1, 1, keep_chunk=True)
    near = ordered.attach(near, span, keys, index)
    v = F.col(x)

    def share(c: Column) -> Column:
        return F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = {}
    for p in (25, 50, 75, 90):
        level = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (p / 100)
        out[f"up{p}"], out[f"down{p}"] = share(v > level), share(v < level)
    bend = F.col("_q") - 2 * v + F.col("_p")
    out |= {"rise": share(v > F.col("_p")), "fall": share(v < F.col("_p")), "left_curved": share(bend > 0), "right_curved": share(bend < 0)}
    return near.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()], (F.count(F.lit(1)) / fps).alias("duration"))


def onsets(df: DataFrame, keys: list[str], index: str, x: str, fps: float, on: float, off: float | None = None) -> DataFrame:
    """Onsets (rise above ``on``) and offsets (fall to ``off`` or below): positions, counts, rate."""
    off = on if off is None else off
    near = ordered.over_neighbours(df.select(*keys, index, x), keys, index, lambda w: {"_p": F.lag(x).over(w)}, 1, 0)
    rise = (F.col(x) > on) & F.coalesce(F.col("_p") <= on, F.lit(True))
    fall = F.coalesce((F.col(x) <= off) & (F.col("_p") > off), F.lit(False))
    o = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(rise, F.col(index))).alias("first_onset"), F.max(F.when(fall, F.col(index))).alias("last_offset"),
                                F.count_if(rise).alias("num_onsets"), F.count_if(fall).alias("num_offsets"))
    return o.select(*keys, (F.col("first_onset") / F.col("_n")).alias("onset_pos"), (F.col("last_offset") / F.col("_n")).alias("offset_pos"),
                    "num_onsets", "num_offsets", (F.col("num_onsets") * fps / F.col("_n")).alias("onset_rate"))


def peaks(df: DataFrame, keys: list[str], index: str, x: str) -> DataFrame:
    """Frames above both neighbours: number, mean distance and its deviation, mean height. A plateau is no peak."""
    near = ordered.over_neighbours(df.select(*keys, index, x), keys, index, lambda w: {"_p": F.lag(x).over(w), "_q": F.lead(x).over(w)}, 1, 1)
    top = near.where((F.col(x) > F.col("_p")) & (F.col(x) > F.col("_q"))).select(*keys, index, x)
    spaced = ordered.previous(top, keys, [index], ordered.chunk_of(index), {"_b": F.col(index)}).withColumn("_d", F.col(index) - F.col("_b"))
    stats = spaced.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_peaks"), F.avg("_d").alias("mean_dist"), F.stddev_pop("_d").alias("std_dist"), F.avg(x).alias("peak_mean"))
    out = df.groupBy(*keys).agg(F.avg(x).alias("_m")).join(stats, keys, "left")
    return out.select(*keys, F.coalesce("num_peaks", F.lit(0)).alias("num_peaks"), "mean_dist", "std_dist", "peak_mean", (F.col("peak_mean") - F.col("_m")).alias("peak_to_mean"))


def peaks2(df: DataFrame, keys: list[str], index: str, x: str, fps: float, share: float = 0.1) -> DataFrame:
    """Peaks and valleys that stand out, and the slopes between them.

    Equal neighbours are first joined to one stretch, so highs and lows strictly alternate. One of them
    counts if it differs from the extreme before or after it by at least ``share`` of the range. A slope
    is the line from a counted low to the next counted high (rising) or the other way (falling), per second.
    This pruning looks at neighbours only, so it runs as windows over series of any length.
    """
    span = df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("_r"), F.avg(x).alias("_m"), (F.count(F.lit(1)) / fps).alias("_sec"), F.max(index).alias("_top"))
    steps = ordered.run_table(df.select(*keys, index, x), keys, index, x).withColumn("_i", F.col("run") - 1)
    near = ordered.over_neighbours(steps, keys, "_i", lambda w: {"_p": F.lag(x).over(w), "_q": F.lead(x).over(w)}, 1, 1)
    high = (F.col(x) > F.col("_p")) & (F.col(x) > F.col("_q"))
    low = (F.col(x) < F.col("_p")) & (F.col(x) < F.col("_q"))
    extreme = near.withColumn("_k", F.when(high, 1).when(low, -1)).where(F.col("_k").isNotNull())
    extreme = ordered.dense_index(extreme.select(*keys, "first_idx", x, "_k"), keys, ["first_idx"], ordered.chunk_of("first_idx"), "_e")
    swings = ordered.over_neighbours(extreme, keys, "_e", lambda w: {"_a": F.abs(F.col(x) - F.lag(x).over(w)), "_b": F.abs(F.col(x) - F.lead(x).over(w))}, 1, 1)
    swings = ordered.attach(swings, span.select(*keys, "_r", "_top"), keys, "first_idx")
    kept = swings.where(F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))) >= share * F.col("_r"))
    step = ordered.previous(kept, keys, ["first_idx"], ordered.chunk_of("first_idx"), {"_pk": F.col("_k"), "_px": F.col(x), "_pi": F.col("first_idx")})
    slope = (F.col(x) - F.col("_px")) / (F.col("first_idx") - F.col("_pi")) * fps
    up, down = F.when((F.col("_k") == 1) & (F.col("_pk") == -1), slope), F.when((F.col("_k") == -1) & (F.col("_pk") == 1), -slope)
    top, bottom = F.when(F.col("_k") == 1, F.col(x)), F.when(F.col("_k") == -1, F.col(x))
    aggs = [F.count(top).alias("num_peaks"), F.avg(top).alias("peak_mean"), (F.max(top) - F.min(top)).alias("peak_range"), F.avg(bottom).alias("min_mean"), (F.max(bottom) - F.min(bottom)).alias("min_range")]
    for name, s in (("rising", up), ("falling", down)):
        aggs += [F.avg(s).alias(f"mean_{name}"), F.stddev_pop(s).alias(f"std_{name}"), F.min(s).alias(f"min_{name}"), F.max(s).alias(f"max_{name}"),
                 F.try_divide(F.stddev_pop(s), F.avg(s)).alias(f"cov_{name}")]
    out = span.join(step.groupBy(*keys).agg(*aggs), keys, "left")
    return out.withColumns({"num_peaks": F.coalesce("num_peaks", F.lit(0)), "peaks_per_sec": F.coalesce("num_peaks", F.lit(0)) / F.col("_sec"),
                            "peak_to_mean": F.col("peak_mean") - F.col("_m")}).drop("_r", "_m", "_sec", "_top")


def samples(df: DataFrame, keys: list[str], index: str, x: str, positions: list[float]) -> DataFrame:
    """Values at relative positions 0..1 of the series."""
    n = df.groupBy(*keys).agg(F.max(index).alias("_n"), F.max(index).alias("_top"))
    at = [F.floor(F.col("_n") * p + 0.5) for p in positions]
    return ordered.attach(df, n, keys, index).groupBy(*keys).agg(*[F.max(F.when(F.col(index) == a, F.col(x))).alias(f"at_{round(p * 100)}") for a, p in zip(at, positions, strict=True)])


def dct(df: DataFrame, keys: list[str], index: str, x: str, first: int = 0, last: int = 5) -> DataFrame:
    """Cosine coefficients of the contour."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(index).alias("_top"))
    angle = F.lit(3.141592653589793) * (F.col(index) + 0.5) / F.col("_n")
    return ordered.attach(df, n, keys, index).groupBy(*keys).agg(*[F.sum(F.col(x) * F.cos(angle * k)).alias(f"dct{k}") for k in range(first, last + 1)])


def level_db(x: Column) -> Column:
    """10 log10 of the mean energy; null for silence."""
    return 10 * F.log10(F.when(F.avg(x) > 0, F.avg(x)))


def acoustic_set(df: DataFrame, keys: list[str], index: str, f0: str, loudness: str, fps: float = 100.0) -> DataFrame:
    """The declared set for a pitch contour (zeros are unvoiced) and a loudness contour.

    Moments and percentiles of voiced pitch and of loudness, slopes between their extremes, loudness in
    voiced and unvoiced stretches, peak and segment rates, equivalent level. The smoothed contours are stored once, because
    every scan reads them and would number and smooth the series anew.
    """
    voiced = F.col(f0) != 0
    smoothed = smooth(df.select(*keys, index, f0, loudness), keys, index, f0, 3, no_zero=True, name="_f")
    smoothed = durable(smooth(smoothed, keys, index, loudness, 3, name="_l"), "smoothed")
    long = smoothed.select(*keys, index, F.explode(F.array(
        F.struct(F.lit(f0).alias("contour"), F.col("_f").alias("_v"), F.when(F.col("_f") != 0, F.col("_f")).alias("_x")),
        F.struct(F.lit(loudness).alias("contour"), F.col("_l").alias("_v"), F.col("_l").alias("_x")))).alias("_e")).select(*keys, index, "_e.*")
    both = [*keys, "contour"]
    m = moments(F.col("_x"))
    q = group_quantiles(long, both, {"x": F.col("_x")}, {"20": 0.2, "50": 0.5, "80": 0.8}, [m["amean"].alias("amean"), m["stddevNorm"].alias("stddevNorm")])
    slopes = peaks2(long, both, index, "_v", fps)
    stats = {
        "amean": F.col("amean"), "stddevNorm": F.col("stddevNorm"), **{f"percentile{p}": F.col(f"x_{p}") for p in (20, 50, 80)},
        "pctlrange0-2": F.col("x_80") - F.col("x_20"), "meanRisingSlope": F.col("mean_rising"), "stddevRisingSlope": F.col("std_rising"),
        "meanFallingSlope": F.col("mean_falling"), "stddevFallingSlope": F.col("std_falling")}
    wide = q.join(slopes, both).groupBy(*keys).agg(
        *[F.max(F.when(F.col("contour") == n, c)).alias(f"{n}_{s}") for n in (f0, loudness) for s, c in stats.items()],
        F.max(F.when(F.col("contour") == loudness, F.col("peaks_per_sec"))).alias(f"{loudness}PeaksPerSec"))

    level = smoothed.groupBy(*keys).agg(
        F.avg(F.when(voiced, F.col("_l"))).alias(f"{loudness}V_amean"), F.avg(F.when(~voiced, F.col("_l"))).alias(f"{loudness}UV_amean"),
        level_db(F.col(loudness) * F.col(loudness)).alias("equivalentSoundLevel_dBp"), (F.count(F.lit(1)) / fps).alias("_sec"))
    stretch = run_lengths(smoothed.select(*keys, index, voiced.alias("_voiced")), keys, index, "_voiced", fps)
    on, off = F.when(F.col("_voiced"), F.col("_l")), F.when(~F.col("_voiced"), F.col("_l"))
    zero = F.lit(0.0)
    runs = stretch.groupBy(*keys).agg(
        F.count(on).alias("_n"), F.coalesce(F.avg(on), zero).alias("MeanVoicedSegmentLengthSec"), F.coalesce(F.stddev_pop(on), zero).alias("StddevVoicedSegmentLengthSec"),
        F.coalesce(F.avg(off), zero).alias("MeanUnvoicedSegmentLength"), F.coalesce(F.stddev_pop(off), zero).alias("StddevUnvoicedSegmentLength"))
    out = wide.join(level, keys).join(runs, keys)
    return out.withColumn("VoicedSegmentsPerSec", F.col("_n") / F.col("_sec")).drop("_n", "_sec")


def run_lengths(df: DataFrame, keys: list[str], index: str, flag: str, fps: float) -> DataFrame:
    """Length in seconds of every stretch of a flag."""
    return ordered.run_table(df, keys, index, flag).select(*keys, flag, (F.col("length") / fps).alias("_l"))
