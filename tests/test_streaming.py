"""A stream in several batches gives what the batch operator gives on the same rows."""

import datetime as dt
import shutil
import time

import pytest
from pyspark.sql import functions as F

from sessiograph.operators import frames as fr
from sessiograph.sources.versioned import BucketedTable
from sessiograph.streaming import jobs, state

SCHEMA = "s long, i long, v double, f boolean, at timestamp"


def files(spark, folder, n_files=3, rows=40):
    """Frames of two series in time order, a few consecutive ones per file."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(s, i, ((i * 7 + s * 3) % 10) / 10, (i // 5 + s) % 2 == 0, start + dt.timedelta(seconds=i)) for i in range(rows) for s in (1, 2)]
    size = -(-len(data) // n_files)
    for k in range(n_files):
        spark.createDataFrame(data[k * size:(k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.schema(SCHEMA).parquet(str(folder))


def stream(spark, folder):
    # one byte per batch: every file is a batch of its own
    return jobs.file_stream(spark, str(folder), SCHEMA, 1)


def test_state_equals_batch(spark, tmp_path):
    batch = files(spark, tmp_path / "in")
    got = state.frame_state(stream(spark, tmp_path / "in"), "s", "at", ["i"], "v", "f", delay="1 minute").select("s", "frame_idx", "blink_count", F.round("gaze_away_time", 9).alias("g"), F.round("smoothed", 9).alias("y"))
    want = fr.falling_edge_count(batch, ["s"], "i", "v", 0.21)
    want = fr.leaky_counter(want, ["s"], "i", F.col("f"), "g")
    want = fr.exponential_smoothing(want, ["s"], "i", "v", "y").select("s", "i", "blink_count", F.round("g", 9), F.round("y", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def backwards(spark, folder, n_files=4, rows=40):
    """Files that arrive newest first, and rows of the same seconds spread over two files."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(s, i, ((i * 7 + s * 3) % 10) / 10, (i // 5 + s) % 2 == 0, start + dt.timedelta(seconds=i, milliseconds=s)) for i in range(rows) for s in (1, 2)]
    size = -(-len(data) // n_files)
    for k in reversed(range(n_files)):
        for part in (data[k * size:(k + 1) * size][::2], data[k * size:(k + 1) * size][1::2]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in order of their time
    return spark.read.schema(SCHEMA).parquet(str(folder))


def test_files_newest_first_give_the_batch_rows(spark, tmp_path):
    batch = backwards(spark, tmp_path / "in")
    counts = {}
    got = state.frame_state(stream(spark, tmp_path / "in"), "s", "at", ["i"], "v", "f", delay=jobs.span(batch, "at"), slot=5.0, counts=counts)
    want = fr.exponential_smoothing(fr.leaky_counter(batch, ["s"], "i", F.col("f"), "g"), ["s"], "i", "v", "y")
    assert sorted(map(tuple, got.select("s", "frame_idx", F.round("gaze_away_time", 9), F.round("smoothed", 9)).collect())) == \
        sorted(map(tuple, want.select("s", "i", F.round("g", 9), F.round("y", 9)).collect()))
    assert counts == {"input_rows": 80, "late_rows": 0, "state_rows": 0}
    got = state.episodes(stream(spark, tmp_path / "in"), "s", "at", ["i"], "f", "v", delay=jobs.span(batch, "at")).select("s", "first_frame")
    want = fr.episodes(batch.withColumn("t", F.col("i") / 1.0), ["s"], "i", "t", F.col("f"), "e", F.col("v")).select("s", F.col("start_time").cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_episodes_and_turns_over_batches(spark, tmp_path):
    batch = files(spark, tmp_path / "in")
    got = state.episodes(stream(spark, tmp_path / "in"), "s", "at", ["i"], "f", "v", delay="1 minute").select("s", "first_frame")
    want = fr.episodes(batch.withColumn("t", F.col("i") / 1.0), ["s"], "i", "t", F.col("f"), "e", F.col("v")).select("s", F.col("start_time").cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    turns = state.turns(stream(spark, tmp_path / "in"), "s", "at", ["i"], "v", 0.4, 0.4, 2, 2, delay="1 minute").select("s", "first_frame", "last_frame")
    whole = fr.turns(batch, ["s"], "i", "v", 0.4, 0.4, 2, 2).select("s", "first_frame", "last_frame")
    assert sorted(map(tuple, turns.collect())) == sorted(map(tuple, whole.collect()))


def test_silence_ends_a_turn(spark, tmp_path):
    rows = [(1, i, 0.9, True, dt.datetime(2024, 1, 1, 0, 0, i if i < 4 else i + 10, tzinfo=dt.timezone.utc)) for i in range(8)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = state.turns(stream(spark, tmp_path / "in"), "s", "at", ["i"], "v", 0.5, 0.5, 2, 2, timeout=2.0, delay="1 minute")
    assert sorted((r.first_frame, r.last_frame) for r in got.collect()) == [(0, 3), (4, 7)]


def test_a_quiet_series_ends(spark, tmp_path):
    """After ``idle`` seconds a series begins anew, whether its rows are released together or a timer ends it in between."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for seconds in ((0, 1, 2, 30, 31), (500, 501), (3000,)):
        spark.createDataFrame([(1, n, 0.9, True, start + dt.timedelta(seconds=n)) for n in seconds], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    counts = {}
    got = state.frame_state(stream(spark, tmp_path / "in"), "s", "at", ["i"], "v", "f", delay="5 seconds", slot=100.0, idle=10.0, counts=counts)
    assert sorted(r.frame_idx for r in got.collect()) == [0, 0, 0, 0, 1, 1, 1, 2]
    assert counts["state_rows"] == 0


def test_a_query_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    """Stopped after a batch was written but not committed, started again, more files: no row twice, none lost."""
    files(spark, tmp_path / "in", n_files=4)
    home, seen = jobs.home_of(spark, f"resume-{tmp_path.name}"), []

    def stop(batch, number):
        if number == 2 and not seen:
            batch.write.parquet(f"{home}/out/batch=2")
            seen.append(number)
            raise RuntimeError("stopped")
        return batch

    flat = stream(spark, tmp_path / "in").select("s", "i", "v")
    with pytest.raises(Exception, match="stopped"):
        jobs.run(flat, "append", each=stop, home=home)
    again = jobs.run(stream(spark, tmp_path / "in").select("s", "i", "v"), "append", each=stop, home=home)
    want = sorted((s, i) for s in (1, 2) for i in range(40))
    assert sorted((r.s, r.i) for r in again.collect()) == want
    spark.createDataFrame([(9, 0, 0.5, True, dt.datetime(2024, 1, 1))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = jobs.run(stream(spark, tmp_path / "in").select("s", "i", "v"), "append", home=home)
    assert sorted((r.s, r.i) for r in more.collect()) == [*want, (9, 0)]


def test_state_survives_a_restart(spark, tmp_path):
    home = jobs.home_of(spark, f"state-{tmp_path.name}")
    batch = files(spark, tmp_path / "all", n_files=4)
    parts = sorted((tmp_path / "all").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    (tmp_path / "in").mkdir()
    opened = stream(spark, tmp_path / "in")
    for p in parts[:2]:
        shutil.copy(p, tmp_path / "in" / p.name)

    def smoothed(s):
        return s.withWatermark("at", "1 minute").groupBy("s").agg(F.count("*").alias("n"), F.sum("v").alias("v"))

    jobs.run(opened, "update", home=home, stateful=smoothed)
    for p in parts[2:]:
        shutil.copy(p, tmp_path / "in" / p.name)
    got = jobs.latest(jobs.run(stream(spark, tmp_path / "in"), "update", home=home, stateful=smoothed), ["s"])
    assert {r.s: r.n for r in got.collect()} == {r.s: r.n for r in batch.groupBy("s").agg(F.count("*").alias("n")).collect()}


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("s"), (F.col("id") * 0.5).alias("v"))
    table = BucketedTable(spark, str(tmp_path / "t"), "s", rows.schema, buckets=16)
    table.create(rows)
    table.upsert(spark.createDataFrame([(3, 9.0), (3, 10.0), (500, 1.0)], "s long, v double"), 0)
    assert len(list((tmp_path / "t" / "v=0").glob("bucket=*"))) <= 2
    got = {(r.s, r.v) for r in table.read().collect()}
    assert got == {(i, i * 0.5) for i in range(200) if i != 3} | {(3, 9.0), (3, 10.0), (500, 1.0)}
    assert {(r.s, r.v) for r in table.read(-1).collect()} == {(i, i * 0.5) for i in range(200)}
    table.upsert(spark.createDataFrame([(7, 1.5)], "s long, v double"), 1)
    table.upsert(spark.createDataFrame([(7, 2.5)], "s long, v double"), 1)  # the same batch again
    table.upsert(spark.createDataFrame([], "s long, v double"), 2)
    now = {(r.s, r.v) for r in table.read().collect()}
    assert now == (got - {(7, 3.5)}) | {(7, 2.5)}
    table.vacuum()
    assert table.versions() == [2] and {(r.s, r.v) for r in table.read().collect()} == now


def test_windows_and_latest(spark, tmp_path):
    batch = files(spark, tmp_path / "in")
    got = jobs.windowed_functionals(stream(spark, tmp_path / "in"), ["s"], "at", "v", "4 seconds", watermark="1 minute").select("s", "n", F.round("mean", 9))
    want = batch.groupBy("s", F.window("at", "4 seconds")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 9)).drop("window")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = jobs.session_scores(stream(spark, tmp_path / "in"), "s", ["i"], "v").collect()
    assert sorted((r.s, r.uploads) for r in last) == [(1, 40), (2, 40)]


def test_upsert_per_batch(spark, tmp_path):
    files(spark, tmp_path / "in")
    initial = spark.createDataFrame([(1, 99, 0.0), (7, 99, 0.5)], "s long, i long, v double")
    out = jobs.upsert_features(stream(spark, tmp_path / "in").select("s", "i", "v"), initial, "s").collect()
    assert {r.s for r in out} == {1, 2, 7} and not any(r.s == 1 and r.i == 99 for r in out)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    def put(*seconds):
        rows = [(1, n, 1.0, True, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)) for n in seconds]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    put(0, 1)
    put(7200, 7201)
    put(7202)  # the watermark that judges late rows is the one of the batch before
    put(2, 7203)
    counts = {}
    got = jobs.windowed_functionals(stream(spark, tmp_path / "in"), ["s"], "at", "v", "10 seconds", watermark="1 minute", counts=counts).collect()
    assert (counts["input_rows"], counts["late_rows"]) == (7, 1) and sorted(r.n for r in got) == [2, 4]


def test_series_of_a_bucket_wait_together(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(s, i, (i * s % 10) / 10, (i + s) % 3 > 0, start + dt.timedelta(seconds=i)) for s in (*range(-3, 5000), 2 ** 62 + 1) for i in range(2)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts, batches = {}, stream(spark, tmp_path / "in")
    got = state.episodes(batches, "s", "at", ["i"], "f", "i", delay="1 minute", slot=60.0, counts=counts, home=str(tmp_path / "home"))
    want = []
    for s in sorted({r[0] for r in data}):
        flags = [(i + s) % 3 > 0 for i in range(2)]
        if any(flags):
            first = flags.index(True)
            closed = flags[0] and not flags[1]
            want.append((s, first, 1, str(0 if closed else 1), closed))
    assert sorted(map(tuple, got.collect())) == want and counts["state_rows"] == 0
    assert state.BUCKETS < 5000  # the keys of state do not follow the number of series
