"""The chunked scans must equal a plain loop, wherever a series is cut."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessiograph.operators import frames as fr
from sessiograph.operators import ordered, quantiles, ranking, series
from sessiograph.operators import joins

SERIES = {"hot": 97, "cold": 3, "one": 1}


def frame_table(spark, seed=1, nulls=False):
    rnd = random.Random(seed)
    rows = []
    for s, n in SERIES.items():
        for i in range(n):
            v = round(rnd.uniform(-5, 5), 3)
            rows.append((s, i, None if nulls and rnd.random() < 0.3 else v, rnd.random() < 0.5))
    return spark.createDataFrame(rows, "s string, i long, v double, f boolean"), rows


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_running_equals_loop(spark, size):
    df, rows = frame_table(spark, nulls=True)
    got = ordered.running(df, ["s"], ["i"], ordered.chunk_of("i", size), {
        "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "n": ("count", F.col("v")), "seen": ("last", F.col("v")), "before": ("last_before", F.col("v"))})
    got = {(r.s, r.i): r for r in got.collect()}
    for s, group in by_series(rows).items():
        total, low, n, last = None, None, 0, None
        for _, i, v, _ in group:
            before = last
            if v is not None:
                total, n, last = (total or 0) + v, n + 1, v
                low = v if low is None else min(low, v)
            r = got[(s, i)]
            assert (r.total is None) == (total is None) and (total is None or math.isclose(r.total, total, abs_tol=1e-9))
            assert (r.low, r.n, r.seen, r.before) == (low, n, last, before)


@pytest.mark.parametrize("size", [3, 5, 1000])
def test_neighbours_cross_chunk_edges(spark, size):
    df, rows = frame_table(spark)
    got = ordered.over_neighbours(df, ["s"], "i", lambda w: {"a": F.lag("v", 2).over(w), "b": F.lead("v").over(w), "m": F.avg("v").over(w.rowsBetween(-2, 1))}, 2, 1, size)
    got = {(r.s, r.i): r for r in got.collect()}
    assert len(got) == len(rows)
    for s, group in by_series(rows).items():
        v = [r[2] for r in group]
        for i in range(len(v)):
            r = got[(s, i)]
            assert r.a == (v[i - 2] if i >= 2 else None) and r.b == (v[i + 1] if i + 1 < len(v) else None)
            assert math.isclose(r.m, np.mean(v[max(0, i - 2):i + 2]), abs_tol=1e-12)


def test_neighbourhood_must_fit(spark):
    df, _ = frame_table(spark)
    with pytest.raises(ValueError):
        ordered.over_neighbours(df, ["s"], "i", lambda w: {}, 5, 0, 5)


def test_previous_and_runs(spark):
    df, rows = frame_table(spark)
    thin = df.where("i % 3 != 1")
    got = {(r.s, r.i): r.p for r in ordered.previous(thin, ["s"], ["i"], ordered.chunk_of("i", 4), {"p": F.col("v")}).collect()}
    runs = {(r.s, r.i): r.run for r in ordered.runs(df, ["s"], "i", "f", "run", 6).collect()}
    for s, group in by_series(rows).items():
        last, number, flag = None, 0, None
        for _, i, v, f in group:
            if f != flag:
                number, flag = number + 1, f
            assert runs[(s, i)] == number
            if i % 3 != 1:
                assert got[(s, i)] == last
                last = v


def test_attach_copies_a_row_per_chunk(spark):
    df, rows = frame_table(spark)
    stats = df.groupBy("s").agg(F.max("v").alias("m"), F.max("i").alias("_top"))
    got = ordered.attach(df, stats, ["s"], "i", size=10).collect()
    assert len(got) == len(rows)
    top = {s: max(r[2] for r in g) for s, g in by_series(rows).items()}
    assert all(r.m == top[r.s] for r in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 2)), min_size=1, max_size=60), st.integers(1, 5))
def test_quantiles_by_rank_are_exact(spark, values, copies):
    rows = [("hot", float(v)) for v in values * copies] + [("cold", 1.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], {"v": F.col("v")}, probs, [F.count(F.lit(1)).alias("n")]).collect()}
    want = np.quantile(np.array(values * copies), list(probs.values()))
    assert np.allclose([got["hot"][f"v_{p}"] for p in probs], want, rtol=1e-9, atol=1e-6)
    assert got["cold"].v_p50 == 1.0 and got["empty"].v_p50 is None and got["empty"].n == 1


def test_quantiles_of_a_hot_group_outliers_and_infinities(spark):
    rnd = random.Random(3)
    groups = {"hot": [rnd.gauss(0, 1) for _ in range(3000)], "cold": [float(i) for i in range(9)] + [float("nan")], "outliers": [1e300, -1e300, 5e-324, 0.0, -0.0, 1e-9, 2.0, 2.0, 3.0],
              "infinite": [float("inf"), float("inf"), 1.0, float("-inf")], "close": [1 + i * 2.0 ** -52 for i in range(40)], "same": [7.25] * 50, "none": [None, float("nan")]}
    df = spark.createDataFrame([(k, v, v) for k, vs in groups.items() for v in vs], "k string, v double, w double")
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "p90": 0.9, "hi": 1.0}
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], {"v": F.col("v"), "w2": F.col("w") * 2}, probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v == v)
        for s, p in probs.items():
            if not vs:
                assert got[k][f"v_{s}"] is None
                continue
            at = (len(vs) - 1) * p
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            if math.isnan(want):  # between two infinities
                assert math.isnan(got[k][f"v_{s}"])
                continue
            assert got[k][f"v_{s}"] == want or math.isclose(got[k][f"v_{s}"], want, rel_tol=1e-12), (k, s)
            assert got[k][f"w2_{s}"] == 2 * got[k][f"v_{s}"] or k in ("outliers",)


def test_quantiles_of_small_groups_are_lists_and_equal_those_of_large_ones(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([rnd.gauss(0, 50), 1.5, -0.0, float("inf"), float("nan"), None])) for g in range(40) for _ in range(rnd.randint(1, 30))]
    df, probs = spark.createDataFrame(rows, "k int, v double"), {"lo": 0.0, "q": 0.2, "m": 0.5, "hi": 1.0}

    def by(small):
        out = quantiles.group_quantiles(df, ["k"], {"v": F.col("v")}, probs, [F.count("v").alias("n"), F.max("v").alias("top")], small=small)
        got = {r.k: repr(r) for r in out.collect()}
        return got, out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    lists, plan = by(quantiles.SMALL)
    assert len(lists) == 40 and "Generate" not in plan  # no row per value
    assert lists == by(0)[0] == by(12)[0]


def test_quantiles_run_nothing_while_they_are_built(spark):
    group = "quantile-plan"
    spark.sparkContext.setJobGroup(group, group)
    df = quantiles.group_quantiles(spark.range(100).selectExpr("id % 3 as k", "double(id) as v"), ["k"], {"v": F.col("v")}, {"m": 0.5})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_smoothing_and_leaky_counter_equal_loops(spark):
    df, rows = frame_table(spark)
    smooth = {(r.s, r.i): r.y for r in fr.exponential_smoothing(df, ["s"], "i", "v", "y", 0.3).collect()}
    leaky = {(r.s, r.i): r.g for r in fr.leaky_counter(df, ["s"], "i", F.col("f"), "g").collect()}
    for s, group in by_series(rows).items():
        y, g = 0.0, 0
        for _, i, v, f in group:
            y = 0.3 * v + 0.7 * y
            g = g + 1 if f else max(0, g - 1)
            assert math.isclose(smooth[(s, i)], y, abs_tol=1e-12)
            assert math.isclose(leaky[(s, i)], g / 30, abs_tol=1e-12)


def test_turns_equal_state_machine(spark):
    rnd = random.Random(9)
    rows = [(s, i, rnd.choice([0.1, 0.3, 0.6, 0.9]) if rnd.random() < 0.4 else (0.9 if (i // 7) % 2 else 0.1)) for s, n in SERIES.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, x double")
    got = sorted((r.s, r.first_frame, r.last_frame) for r in fr.turns(df, ["s"], "i", "x", 0.5, 0.4, 3, 2).collect())
    want = []
    for s, n in SERIES.items():
        x = [r[2] for r in rows if r[0] == s]
        loud = quiet = 0
        start = None
        for i, v in enumerate(x):
            loud = loud + 1 if v > 0.5 else 0
            quiet = quiet + 1 if v < 0.4 else 0
            if loud == 3:
                start = i - 2 if start is None else start
            elif quiet == 2 and start is not None:
                want.append((s, start, i - 2))
                start = None
        if start is not None:
            want.append((s, start, len(x) - 1))
    assert got == sorted(want)


def test_nearest_point_against_all_pairs(spark):
    rnd = random.Random(5)
    pts = [(k, round(rnd.uniform(0, 50), 1), float(i), i) for k in "ab" for i in range(40)]
    tgt = [(k, round(rnd.uniform(-5, 60), 1), i) for i, k in enumerate("abc" * 12)]
    p = spark.createDataFrame(pts, "k string, x double, y double, tie long")
    t = spark.createDataFrame(tgt, "k string, x double, target_id long")
    got = {r.target_id: r.nearest_y for r in joins.nearest_point(p, t, ["k"], "x", "y", "x", 7.0).collect()}
    for k, x, i in tgt:
        mine = [(abs(px - x), px > x, tie, y) for pk, px, y, tie in pts if pk == k]
        best = min(mine)[0] if mine else None
        assert (got[i] is None) == (best is None)
        if best is not None:
            assert any(y == got[i] and math.isclose(d, best, abs_tol=1e-9) for d, _, _, y in mine)


def test_instance_numbers_follow_file_order(spark, tmp_path):
    spark.range(0, 500, 1, 7).write.parquet(str(tmp_path / "t"))
    got = joins.with_instance_number(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r.instance_id for r in got) == list(range(500))


def test_peaks_of_a_drawn_contour(spark):
    x = [0, 1, 3, 3, 1, 0.9, 1.1, 0, 4, 0]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "s string, i long, v double")
    r = series.peaks2(df, ["s"], "i", "v", 10.0, 0.1).collect()[0]
    # plateau at 2-3 and the top at 8 stand out, the bump at 6 does because it falls by 1.1 afterwards
    assert r.num_peaks == 3 and math.isclose(r.peak_mean, (3 + 1.1 + 4) / 3)
    flat = spark.createDataFrame([("s", i, 1.0) for i in range(5)] + [("t", 0, 2.0)], "s string, i long, v double")
    assert [x.num_peaks for x in series.peaks2(flat, ["s"], "i", "v", 10.0).collect()] == [0, 0]


def test_substring_match_is_exact(spark):
    known = spark.createDataFrame([("0_p12",), ("p3",), ("zz",)], "id string")
    rest = spark.createDataFrame([("p1",), ("xp3y",), ("q",)], "w string").withColumn("r", F.col("w"))
    got = {r.r: r.id for r in joins.substring_match(rest, known, "id", "r", "w").collect()}
    assert got == {"p1": "0_p12", "xp3y": "p3"}


def test_checked_union_refuses_other_types(spark):
    with pytest.raises(ValueError):
        ranking.checked_union(spark.range(1), spark.range(1).select(F.col("id").cast("int")))


@pytest.mark.parametrize("alpha", [0.3, 0.02, 0.9, 1.0])
def test_smoothing_equals_the_loop(spark, alpha):
    """An impulse of 1e30 is still there hundreds of frames later; long and short series, several groups of blocks."""
    series = {1: [1e30] + [0.0] * 400, 2: [math.sin(i) for i in range(9000)], 3: [2.5], 4: [0.0] * 300 + [1e300] + [1.0] * 5200 + [-1e12] + [0.25] * 800}
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "k long, i long, x double")
    got = {(r.k, r.i): r.y for r in fr.exponential_smoothing(df, ["k"], "i", "x", "y", alpha).collect()}
    assert len(got) == sum(map(len, series.values()))
    for k, xs in series.items():
        y, size = 0.0, 0.0
        for i, x in enumerate(xs):
            y = alpha * x + (1 - alpha) * y
            size = max(abs(alpha * x), (1 - alpha) * size)
            assert math.isclose(got[k, i], y, rel_tol=1e-9, abs_tol=1e-12 * size), (k, i)
