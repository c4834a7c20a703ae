"""Functionals of frame series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ._sql import r
from .frames import GAPPY, W, gappy
from .registry import Registry, r6
from .sessions import _rounded

registry = Registry()
q = registry.query
K, IDX = ["series_id"], "frame_idx"
_SIGNED = "g AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN -1 - level ELSE level + 1 END AS f0 FROM frames)"


def signed(t):
    """The contour with zeros and negative values."""
    e, v = F.col("event_type"), F.col("level") + 1
    return t.frames.withColumn("f0", F.when(e == "error", 0.0).when(e == "view", -v).otherwise(v))


def _cols(d):
    return ", ".join(r(e, f'"{n}"') for n, e in d.items())


def _round(df):
    return _rounded(df, K)


_WIN = {"amean": "avg(value)", "stddev": "stddev_pop(value)"}


@q("functional_frames", "frames", f"""WITH w AS (SELECT 'tumbling' AS mode, series_id, frame_idx // 10 AS win, value FROM frames
    UNION ALL SELECT 'sliding', series_id, unnest(range(greatest(0, CAST(floor((frame_idx - 12) / CAST(5 AS DOUBLE)) AS BIGINT) + 1), frame_idx // 5 + 1)), value FROM frames)
    SELECT mode, series_id, win AS "window", count(*) AS n, {_cols(_WIN)} FROM w GROUP BY 1, 2, 3""")
def _(t):
    def stats(size, step, mode):
        u = series.unit_windows(t.frames, IDX, size, step)
        m = series.moments(F.col("value"))
        return u.groupBy("series_id", "window").agg(F.count(F.lit(1)).alias("n"), m["amean"].alias("amean"), m["stddev"].alias("stddev")).withColumn("mode", F.lit(mode))
    return _rounded(stats(10, 10, "tumbling").unionByName(stats(12, 5, "sliding")), ["mode", "series_id", "window"])


_NZ = "CASE WHEN f0 <> 0 THEN f0 END"
_MEANS = {"amean": "avg(f0)", "absmean": "avg(abs(f0))", "qmean": "avg(f0 * f0)", "rqmean": "sqrt(avg(f0 * f0))", "nzamean": f"avg({_NZ})", "nzabsmean": f"avg(abs({_NZ}))",
          "nzqmean": f"avg(power({_NZ}, 2))", "nzrqmean": f"sqrt(avg(power({_NZ}, 2)))", "nzgmean": f"exp(avg(ln(abs({_NZ}))))", "posamean": "avg(CASE WHEN f0 > 0 THEN f0 END)",
          "negamean": "avg(CASE WHEN f0 < 0 THEN f0 END)", "flatness": f"exp(avg(ln(abs({_NZ})))) / avg(abs({_NZ}))"}


@q("fn_means", "frames", f"WITH {_SIGNED} SELECT series_id, {_cols(_MEANS)}, count({_NZ}) AS nnz FROM g GROUP BY 1")
def _(t):
    return _round(signed(t).groupBy(*K).agg(*[c.alias(n) for n, c in series.means(F.col("f0")).items()]))


def _moments_sql(x):
    m2 = f"var_pop({x})"
    return {"amean": f"avg({x})", "variance": m2, "stddev": f"stddev_pop({x})",
            "skewness": f"(avg(power({x}, 3)) - 3 * avg({x}) * avg(power({x}, 2)) + 2 * power(avg({x}), 3)) / power({m2}, 1.5)",
            "kurtosis": f"kurtosis_pop({x})", "stddevNorm": f"stddev_pop({x}) / abs(avg({x}))"}


@q("fn_moments", "frames", f"SELECT series_id, {_cols(_moments_sql('level'))} FROM frames GROUP BY 1")
def _(t):
    return _round(t.frames.groupBy(*K).agg(*[c.alias(n) for n, c in series.moments(F.col("level")).items()]))


@q("fn_nonzero_mode", "frames", f"WITH {GAPPY} SELECT series_id, {_cols(_moments_sql('f0'))}, {r('median(f0)', 'p50')} FROM g WHERE f0 <> 0 GROUP BY 1")
def _(t):
    x = series.nonzero("f0")
    m = gappy(t).groupBy(*K).agg(*[c.alias(n) for n, c in series.moments(x).items()])
    return _round(m.join(series.percentiles(gappy(t), K, x).select("series_id", "p50"), K))


def _pct(p):
    return f"quantile_cont(value, {p})"


@q("fn_percentiles", "frames", "SELECT series_id, " + _cols({"p20": _pct(0.2), "q1": _pct(0.25), "p50": _pct(0.5), "q3": _pct(0.75), "p80": _pct(0.8), "iqr12": f"{_pct(0.5)} - {_pct(0.25)}",
   "iqr23": f"{_pct(0.75)} - {_pct(0.5)}", "iqr13": f"{_pct(0.75)} - {_pct(0.25)}", "pctlrange": f"{_pct(0.8)} - {_pct(0.2)}", "pctlquot": f"{_pct(0.8)} / {_pct(0.2)}"}) + " FROM frames GROUP BY 1")
def _(t):
    return _round(series.percentiles(t.frames, K, F.col("value")))


@q("fn_extremes", "frames", "SELECT series_id, " + _cols({"max": "max(level)", "min": "min(level)", "range": "max(level) - min(level)", "max_share": "arg_min(frame_idx, (-level, frame_idx)) / CAST(count(*) AS DOUBLE)",
   "max_to_mean": "max(level) - avg(level)", "min_to_mean": "avg(level) - min(level)"}) + ", arg_min(frame_idx, (-level, frame_idx)) AS max_pos, arg_min(frame_idx, (level, frame_idx)) AS min_pos FROM frames GROUP BY 1")
def _(t):
    return _round(series.extremes(t.frames, K, IDX, "level"))


@q("fn_linear_regression", "frames", f"""WITH c0 AS (SELECT series_id, regr_slope(value, frame_idx) AS slope, regr_intercept(value, frame_idx) AS o FROM frames GROUP BY 1)
    SELECT f.series_id, {r('max(slope)', 'slope')}, {r('max(o)', '"offset"')}, {r('avg(abs(value - slope * frame_idx - o))', 'error_abs')}, {r('avg(power(value - slope * frame_idx - o, 2))', 'error_sq')} FROM frames f JOIN c0 AS c ON c.series_id = f.series_id GROUP BY 1""")
def _(t):
    return _round(series.linear_regression(t.frames, K, IDX, "value"))


@q("fn_quadratic_regression", "frames", f"""WITH n AS (SELECT series_id, count(*) AS n, (count(*) - 1) / CAST(2 AS DOUBLE) AS m FROM frames GROUP BY 1),
    u AS (SELECT f.series_id, n, m, frame_idx - m AS u, value AS x FROM frames f JOIN n ON n.series_id = f.series_id),
    s AS (SELECT series_id, max(n) AS n, max(m) AS m, sum(u * u) AS u2, sum(power(u, 4)) AS u4, sum(x) AS x0, sum(u * x) AS x1, sum(u * u * x) AS x2 FROM u GROUP BY 1),
    k AS (SELECT *, (n * x2 - u2 * x0) / (n * u4 - u2 * u2) AS a, x1 / u2 AS bu FROM s), k2 AS (SELECT *, (x0 - a * u2) / n AS cu FROM k),
    k3 AS (SELECT series_id, n - 1 AS l, a, bu - 2 * a * m AS b, cu - bu * m + a * m * m AS c FROM k2),
    v AS (SELECT *, greatest(0, least(l, -b / (2 * a))) AS v FROM k3), w AS (SELECT *, a * v * v + b * v + c AS y FROM v),
    e AS (SELECT f.series_id, avg(abs(value - (a * frame_idx * frame_idx + b * frame_idx + c))) AS ea, avg(power(value - (a * frame_idx * frame_idx + b * frame_idx + c), 2)) AS es FROM frames f JOIN k3 ON k3.series_id = f.series_id GROUP BY 1)
    SELECT w.series_id, {_cols({'a': 'a', 'b': 'b', 'c': 'c', 'error_abs': 'ea', 'error_sq': 'es', 'vertex': 'v', 'vertex_value': 'y'})},
    {r('CASE WHEN v <> 0 THEN (y - c) / v END', 'left_slope')}, {r('CASE WHEN l <> v THEN (a * l * l + b * l + c - y) / (l - v) END', 'right_slope')} FROM w JOIN e ON e.series_id = w.series_id""")
def _(t):
    return _round(series.quadratic_regression(t.frames, K, IDX, "value"))


@q("fn_centroid", "frames", f"SELECT series_id, {r('sum(t * abs(value)) / sum(abs(value))', 'centroid')} FROM frames GROUP BY 1")
def _(t):
    return _round(t.frames.groupBy(*K).agg(series.centroid(F.col("t"), F.col("value")).alias("centroid")))


def _cross(a, b):
    return f"avg(CASE WHEN {a} * {b} < 0 OR ({a} = 0 AND {b} <> 0) THEN 1 ELSE 0 END)"


@q("fn_crossings", "frames", f"""WITH {_SIGNED}, p AS (SELECT *, lag(f0) {W}) AS p, avg(f0) OVER (PARTITION BY series_id) AS m FROM g)
    SELECT series_id, {r(_cross('p', 'f0'), 'zcr')}, {r(_cross('(p - m)', '(f0 - m)'), 'mcr')} FROM p GROUP BY 1""")
def _(t):
    return _round(series.crossings(signed(t), K, IDX, "f0"))


@q("fn_rms", "frames", f"SELECT series_id, {r('sqrt(avg(value * value))', 'rms')} FROM frames GROUP BY 1")
def _(t):
    return _round(t.frames.groupBy(*K).agg(series.means(F.col("value"))["rqmean"].alias("rms")))


_SEGSTATS = {"mean_len": "coalesce(avg(l), 0)", "max_len": "coalesce(max(l), 0)", "min_len": "coalesce(min(l), 0)", "std_len": "coalesce(stddev_pop(l), 0)"}


@q("fn_segments_by_value", "frames", f"""WITH b AS (SELECT *, CASE WHEN value > 40 IS DISTINCT FROM lag(value > 40) {W}) THEN 1 ELSE 0 END AS c FROM frames),
    n AS (SELECT *, sum(c) {W}) AS run FROM b), s AS (SELECT series_id, min(frame_idx) AS a, max(frame_idx) AS z FROM n WHERE value > 40 GROUP BY series_id, run),
    p AS (SELECT *, CASE WHEN lag(z) OVER (PARTITION BY series_id ORDER BY a) IS NULL OR a - lag(z) OVER (PARTITION BY series_id ORDER BY a) - 1 >= 2 THEN 1 ELSE 0 END AS f FROM s),
    g AS (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY a) AS g FROM p), l AS (SELECT series_id, (max(z) - min(a) + 1) / CAST(100 AS DOUBLE) AS l FROM g GROUP BY series_id, g HAVING max(z) - min(a) + 1 >= 3),
    c AS (SELECT series_id, count(*) / CAST(100 AS DOUBLE) AS sec FROM frames GROUP BY 1)
    SELECT c.series_id, count(l) AS num_segments, {_cols(_SEGSTATS)}, {r('count(l) / max(sec)', 'segments_per_sec')} FROM c LEFT JOIN l ON l.series_id = c.series_id GROUP BY 1""")
def _(t):
    return _round(series.segments_by_value(t.frames, K, IDX, F.col("value") > 40, 100.0, 3, 2))


@q("fn_segments_by_delta", "frames", f"""WITH a AS (SELECT *, avg(value) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, max(value) OVER (PARTITION BY series_id) - min(value) OVER (PARTITION BY series_id) AS rg FROM frames),
    b AS (SELECT *, coalesce(abs(value - a) > 0.2 * rg, false) AS away FROM a), c AS (SELECT *, CASE WHEN away AND NOT coalesce(lag(away) {W}), false) THEN 1 ELSE 0 END AS f FROM b),
    s AS (SELECT *, sum(f) {W}) AS s FROM c), l AS (SELECT series_id, s, count(*) / CAST(100 AS DOUBLE) AS l FROM s GROUP BY 1, 2)
    SELECT series_id, count(*) AS num_segments, {_cols(_SEGSTATS)} FROM l GROUP BY 1""")
def _(t):
    return _round(series.segments_by_delta(t.frames, K, IDX, "value", 100.0))


_T = {}
for _p in (25, 50, 75, 90):
    _T[f"up{_p}"] = f"avg(CASE WHEN value > lo + (hi - lo) * {_p / 100} THEN 1 ELSE 0 END)"
    _T[f"down{_p}"] = f"avg(CASE WHEN value < lo + (hi - lo) * {_p / 100} THEN 1 ELSE 0 END)"
_T |= {"rise": "avg(CASE WHEN value > p THEN 1 ELSE 0 END)", "fall": "avg(CASE WHEN value < p THEN 1 ELSE 0 END)", "left_curved": "avg(CASE WHEN q - 2 * value + p > 0 THEN 1 ELSE 0 END)",
       "right_curved": "avg(CASE WHEN q - 2 * value + p < 0 THEN 1 ELSE 0 END)", "duration": "count(*) / CAST(100 AS DOUBLE)"}


@q("fn_times", "frames", f"WITH a AS (SELECT *, lag(value) {W}) AS p, lead(value) {W}) AS q, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi FROM frames) SELECT series_id, {_cols(_T)} FROM a GROUP BY 1")
def _(t):
    return _round(series.times(t.frames, K, IDX, "value", 100.0))


@q("fn_onsets", "frames", f"""WITH a AS (SELECT *, lag(value) {W}) AS p FROM frames), b AS (SELECT *, value > 60 AND coalesce(p <= 60, true) AS o, coalesce(value <= 50 AND p > 50, false) AS f FROM a)
    SELECT series_id, {_cols({'onset_pos': 'min(CASE WHEN o THEN frame_idx END) / CAST(count(*) AS DOUBLE)', 'offset_pos': 'max(CASE WHEN f THEN frame_idx END) / CAST(count(*) AS DOUBLE)', 'onset_rate': 'count(*) FILTER (o) * 100 / CAST(count(*) AS DOUBLE)'})},
    count(*) FILTER (o) AS num_onsets, count(*) FILTER (f) AS num_offsets FROM b GROUP BY 1""")
def _(t):
    return _round(series.onsets(t.frames, K, IDX, "value", 100.0, 60.0, 50.0))


@q("fn_peaks", "frames", f"""WITH a AS (SELECT *, lag(level) {W}) AS p, lead(level) {W}) AS q FROM frames), b AS (SELECT series_id, frame_idx, level, frame_idx - lag(frame_idx) {W}) AS d FROM a WHERE level > p AND level > q),
    s AS (SELECT series_id, count(*) AS n, avg(d) AS md, stddev_pop(d) AS sd, avg(level) AS pm FROM b GROUP BY 1), m AS (SELECT series_id, avg(level) AS m FROM frames GROUP BY 1)
    SELECT m.series_id, coalesce(n, 0) AS num_peaks, {_cols({'mean_dist': 'md', 'std_dist': 'sd', 'peak_mean': 'pm', 'peak_to_mean': 'pm - m'})} FROM m LEFT JOIN s ON s.series_id = m.series_id""")
def _(t):
    return _round(series.peaks(t.frames, K, IDX, "level"))


def _coarse(t):
    """Values in steps of ten, so that plateaus occur."""
    return t.frames.withColumn("step", F.floor(F.col("value") / 10).cast("double"))


_P2 = {"peak_mean": "pm", "peak_range": "pr", "min_mean": "mm", "min_range": "mr", "peak_to_mean": "pm - m", "peaks_per_sec": "coalesce(np, 0) / sec"}
for _d in ("rising", "falling"):
    _P2 |= {f"{k}_{_d}": f"{k}_{_d}" for k in ("mean", "std", "min", "max", "cov")}


def _p2agg(d, e):
    return ", ".join([f"avg({e}) AS mean_{d}", f"stddev_pop({e}) AS std_{d}", f"min({e}) AS min_{d}", f"max({e}) AS max_{d}", f"stddev_pop({e}) / avg({e}) AS cov_{d}"])


@q("fn_peaks2", "frames", f"""WITH f AS (SELECT series_id, frame_idx, floor(value / 10) AS v FROM frames), c AS (SELECT *, v IS DISTINCT FROM lag(v) {W}) AS c FROM f), r AS (SELECT * FROM c WHERE c),
    x AS (SELECT *, lag(v) {W}) AS p, lead(v) {W}) AS q FROM r), k AS (SELECT *, CASE WHEN v > p AND v > q THEN 1 WHEN v < p AND v < q THEN -1 END AS k FROM x),
    e AS (SELECT *, abs(v - lag(v) {W})) AS a, abs(v - lead(v) {W})) AS b FROM k WHERE k IS NOT NULL),
    sp AS (SELECT series_id, max(v) - min(v) AS rg, avg(v) AS m, count(*) / CAST(100 AS DOUBLE) AS sec FROM f GROUP BY 1),
    kept AS (SELECT e.*, lag(k) OVER w AS pk, (v - lag(v) OVER w) / (frame_idx - lag(frame_idx) OVER w) * 100 AS s FROM e JOIN sp ON sp.series_id = e.series_id
        WHERE greatest(coalesce(a, 0), coalesce(b, 0)) >= 0.15 * rg WINDOW w AS (PARTITION BY e.series_id ORDER BY frame_idx)),
    st AS (SELECT series_id, count(*) FILTER (k = 1) AS np, avg(v) FILTER (k = 1) AS pm, max(v) FILTER (k = 1) - min(v) FILTER (k = 1) AS pr, avg(v) FILTER (k = -1) AS mm, max(v) FILTER (k = -1) - min(v) FILTER (k = -1) AS mr,
        {_p2agg('rising', 'CASE WHEN k = 1 AND pk = -1 THEN s END')}, {_p2agg('falling', 'CASE WHEN k = -1 AND pk = 1 THEN -s END')} FROM kept GROUP BY 1)
    SELECT sp.series_id, coalesce(np, 0) AS num_peaks, {_cols(_P2)} FROM sp LEFT JOIN st ON st.series_id = sp.series_id""")
def _(t):
    return _round(series.peaks2(_coarse(t), K, IDX, "step", 100.0, 0.15))


@q("fn_samples", "frames", f"""WITH n AS (SELECT *, max(frame_idx) OVER (PARTITION BY series_id) AS n FROM frames) SELECT series_id, {', '.join(f'max(CASE WHEN frame_idx = CAST(floor(n * {p / 100} + 0.5) AS BIGINT) THEN value END) AS at_{p}' for p in (0, 25, 50, 75, 100))} FROM n GROUP BY 1""")
def _(t):
    return _round(series.samples(t.frames, K, IDX, "value", [0.0, 0.25, 0.5, 0.75, 1.0]))


@q("fn_dct", "frames", f"""WITH n AS (SELECT *, 3.141592653589793 * (frame_idx + 0.5) / CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS a FROM frames) SELECT series_id, {_cols({f'dct{k}': f'sum(value * cos(a * {k}))' for k in range(6)})} FROM n GROUP BY 1""")
def _(t):
    return _round(series.dct(t.frames, K, IDX, "value"))


@q("fn_level_db", "frames", f"SELECT series_id, {r('10 * log10(avg(value * value))', 'level_db')} FROM frames GROUP BY 1")
def _(t):
    return _round(t.frames.groupBy(*K).agg(series.level_db(F.col("value") * F.col("value")).alias("level_db")))


def _slopes(x, src, name):
    """CTEs of extremes and slopes of a smoothed contour x in src."""
    return f"""{name}c AS (SELECT *, {x} IS DISTINCT FROM lag({x}) {W}) AS ch FROM {src}), {name}r AS (SELECT * FROM {name}c WHERE ch),
    {name}x AS (SELECT *, lag({x}) {W}) AS p, lead({x}) {W}) AS q FROM {name}r), {name}k AS (SELECT *, CASE WHEN {x} > p AND {x} > q THEN 1 WHEN {x} < p AND {x} < q THEN -1 END AS k FROM {name}x),
    {name}e AS (SELECT *, abs({x} - lag({x}) {W})) AS a, abs({x} - lead({x}) {W})) AS b FROM {name}k WHERE k IS NOT NULL),
    {name}s AS (SELECT series_id, max({x}) - min({x}) AS rg, count(*) / CAST(100 AS DOUBLE) AS sec FROM {src} GROUP BY 1),
    {name}kept AS (SELECT e.*, lag(k) OVER w AS pk, ({x} - lag({x}) OVER w) / (frame_idx - lag(frame_idx) OVER w) * 100 AS s FROM {name}e e JOIN {name}s sp ON sp.series_id = e.series_id
        WHERE greatest(coalesce(a, 0), coalesce(b, 0)) >= 0.1 * rg WINDOW w AS (PARTITION BY e.series_id ORDER BY frame_idx)),
    {name} AS (SELECT sp.series_id, count(k) FILTER (k = 1) / max(sec) AS pps, avg(CASE WHEN k = 1 AND pk = -1 THEN s END) AS mr, stddev_pop(CASE WHEN k = 1 AND pk = -1 THEN s END) AS sr,
        avg(CASE WHEN k = -1 AND pk = 1 THEN -s END) AS mf, stddev_pop(CASE WHEN k = -1 AND pk = 1 THEN -s END) AS sf FROM {name}s sp LEFT JOIN {name}kept kk ON kk.series_id = sp.series_id GROUP BY 1)"""


def _runs_sql(cond, name):
    return f"""{name}b AS (SELECT *, CASE WHEN ({cond}) IS DISTINCT FROM lag({cond}) {W}) THEN 1 ELSE 0 END AS c FROM g), {name}n AS (SELECT *, sum(c) {W}) AS run FROM {name}b),
    {name}l AS (SELECT series_id, run, count(*) / CAST(100 AS DOUBLE) AS l FROM {name}n WHERE {cond} GROUP BY 1, 2),
    {name} AS (SELECT series_id, count(*) AS n, avg(l) AS ml, stddev_pop(l) AS sl FROM {name}l GROUP BY 1)"""


_SET = {}
for _n, _x, _s in (("f0", "CASE WHEN f <> 0 THEN f END", "pf"), ("loudness", "l", "pl")):
    _SET |= {f"{_n}_amean": f"avg({_x})", f"{_n}_stddevNorm": f"stddev_pop({_x}) / abs(avg({_x}))", f"{_n}_percentile20": f"quantile_cont({_x}, 0.2)", f"{_n}_percentile50": f"quantile_cont({_x}, 0.5)",
             f"{_n}_percentile80": f"quantile_cont({_x}, 0.8)", f"{_n}_pctlrange0-2": f"quantile_cont({_x}, 0.8) - quantile_cont({_x}, 0.2)", f"{_n}_meanRisingSlope": f"max({_s}.mr)",
             f"{_n}_stddevRisingSlope": f"max({_s}.sr)", f"{_n}_meanFallingSlope": f"max({_s}.mf)", f"{_n}_stddevFallingSlope": f"max({_s}.sf)"}
_SET |= {"loudnessPeaksPerSec": "max(pl.pps)", "loudnessV_amean": "avg(CASE WHEN f0 <> 0 THEN l END)", "loudnessUV_amean": "avg(CASE WHEN f0 = 0 THEN l END)", "equivalentSoundLevel_dBp": "10 * log10(avg(loudness * loudness))",
         "VoicedSegmentsPerSec": "coalesce(max(vs.n), 0) / (count(*) / CAST(100 AS DOUBLE))", "MeanVoicedSegmentLengthSec": "coalesce(max(vs.ml), 0)", "StddevVoicedSegmentLengthSec": "coalesce(max(vs.sl), 0)",
         "MeanUnvoicedSegmentLength": "coalesce(max(us.ml), 0)", "StddevUnvoicedSegmentLength": "coalesce(max(us.sl), 0)"}


@q("acoustic_functional_set", "frames", f"""WITH g AS (SELECT series_id, frame_idx, CASE WHEN event_type = 'error' THEN 0 ELSE level END AS f0, level AS loudness FROM frames),
    sm AS (SELECT *, CASE WHEN f0 = 0 THEN 0 ELSE avg(CASE WHEN f0 <> 0 THEN f0 END) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS f, avg(loudness) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM g),
    {_slopes('f', 'sm', 'pf')}, {_slopes('l', 'sm', 'pl')}, {_runs_sql('f0 <> 0', 'vs')}, {_runs_sql('f0 = 0', 'us')}
    SELECT sm.series_id, {_cols(_SET)} FROM sm LEFT JOIN pf ON pf.series_id = sm.series_id LEFT JOIN pl ON pl.series_id = sm.series_id LEFT JOIN vs ON vs.series_id = sm.series_id LEFT JOIN us ON us.series_id = sm.series_id GROUP BY 1""")
def _(t):
    return _round(series.acoustic_set(gappy(t).withColumn("loudness", F.col("level")), K, IDX, "f0", "loudness"))


@q("series_normalize", "frames", f"""WITH {GAPPY}, s AS (SELECT series_id, avg(level) AS m, avg(CASE WHEN f0 <> 0 THEN f0 END) AS fm, stddev_pop(CASE WHEN f0 <> 0 THEN f0 END) AS fs FROM g GROUP BY 1)
    SELECT g.series_id, frame_idx, {r('level - m', 'centred')}, {r('CASE WHEN f0 = 0 THEN 0 ELSE (f0 - fm) / fs END', 'voiced_mvn')} FROM g JOIN s ON s.series_id = g.series_id""")
def _(t):
    n = series.normalize_series(gappy(t), K, IDX, "level", name="centred")
    n = series.normalize_series(n, K, IDX, "f0", variance=True, skip_zero=True, name="voiced_mvn")
    return n.select("series_id", "frame_idx", r6("centred"), r6("voiced_mvn"))


@q("standardize_with_saved_stats", "features", f"""WITH s AS (SELECT avg(loudness) AS ml, stddev_pop(loudness) AS dl, avg(jitter) AS mj, stddev_pop(jitter) AS dj FROM features WHERE label = 0)
    SELECT session_id, segment_idx, {r('(loudness - ml) / dl', 'loudness')}, {r('(jitter - mj) / dj', 'jitter')} FROM features, s WHERE label = 1""")
def _(t):
    f = ["loudness", "jitter"]
    stats = series.saved_stats(t.features.where("label = 0"), f)
    return series.standardize(t.features.where("label = 1").select("session_id", "segment_idx", *f), stats, f).withColumns({c: F.round(c, 6) for c in f})
