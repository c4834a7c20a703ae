"""Streaming jobs. Results are written per batch to the shared folder; a batch that is repeated after a
failure overwrites its own output, so every row counts once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..session import shared_dir
from ..sources.versioned import BucketedTable

#: Event time of the row that ends a stream (2262, the last year pandas knows), and the last moment a timer waits for (2200), in
#: microseconds; a watermark delay has to be shorter than the time between.
END, END_TIMER = 9_214_646_400_000_000, 7_258_118_400_000_000


def home_of(spark: SparkSession, name: str) -> str:
    """The folder of the query ``name`` under the shared folder: its checkpoint and output, so that a new start goes on where the last ended."""
    return f"{shared_dir(spark, 'streams').rsplit('/', 1)[0]}/streams/{name}"


def span(table: DataFrame, ts: str) -> str:
    """The time between a stored table's first and last row as a watermark delay: whatever the order of its files, no row is late."""
    first, last = table.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    return f"{(last - first) // 1000 + 1 if first is not None else 0} milliseconds"


def file_stream(spark: SparkSession, path: str, schema, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A parquet table, one file or a folder of part files, as a stream; files already seen are not read again.

    The size of a batch is bounded, and with it what a stateful operator sees of one series at a time.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    # a pattern that fits the name alone: a plain path would have to be a folder
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def event_time(ts: str) -> Column:
    """Wall-clock time as an instant, the same in every session time zone."""
    minutes = (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return F.timestamp_micros(minutes * 60_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long"))


class _Progress(StreamingQueryListener):
    """Input and late rows of every batch of the queries started meanwhile; the progress a query keeps itself ends at its last hundred batches."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.ended = counts, threading.Event()
        counts.update(input_rows=0, late_rows=0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.counts["input_rows"] += event.progress.numInputRows
        self.counts["late_rows"] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.counts["state_rows"] = sum(o.numRowsTotal for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def _ended(stream: DataFrame, home: str, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with the row that ends it, and a function that lets that row appear.

    The row comes from a folder of its own and lies so far in the future that every window, slot and timer is due.
    """
    spark, folder = stream.sparkSession, f"{home}/end"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    marks = spark.readStream.schema(stream.schema).parquet(folder)

    def end() -> None:
        if not fs.listStatus(where):
            last = [F.timestamp_micros(F.lit(END)).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
            spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(folder)

    return stream.unionByName(marks), end


def run(stream: DataFrame, mode: str = "update", each: Callable[[DataFrame, int], DataFrame] | None = None, counts: dict[str, int] | None = None,
        home: str | None = None, closing: str | None = None, stateful: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there and return all output rows with their batch number.

    ``stateful`` makes the query of the stream. With ``closing`` (the event-time column) the stream ends after its last row:
    everything still open is put out and its state removed. ``home`` is the query's folder (``home_of``); started again there,
    it goes on behind the last finished batch, and a batch cut short overwrites its own output, so every row counts once.
    Without a folder every call replays the stream. ``counts`` receives the rows read, those dropped as later than the
    watermark (of an aggregation: partial sums) and the rows of state left.
    """
    spark = stream.sparkSession
    home = home or shared_dir(spark, "stream")
    out = f"{home}/out"
    source, end = _ended(stream, home, closing) if closing else (stream, None)
    query = stateful(source) if stateful else source

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def go() -> None:
        held = dict(counts or {})
        listener = _Progress(counts) if counts is not None else None
        if listener:
            spark.streams.addListener(listener)
        query.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
        if listener:
            listener.ended.wait(60)
            spark.streams.removeListener(listener)
            for k in ("input_rows", "late_rows"):
                counts[k] += held.get(k, 0)

    go()
    if end:
        end()
        go()
        if counts is not None:
            counts["input_rows"] -= 1
    schema = (each(spark.createDataFrame([], query.schema), -1) if each else query).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", out).parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of each key over the batches."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def windowed_functionals(stream: DataFrame, keys: list[str], ts: str, value: str, size: str, step: str | None = None, *, watermark: str,
                         counts: dict[str, int] | None = None, home: str | None = None) -> DataFrame:
    """Mean, deviation, extremes and count on event-time windows (start in milliseconds), each once when no row can change it any more."""
    w = F.window(ts, size, step) if step else F.window(ts, size)

    def windows(rows: DataFrame) -> DataFrame:
        agg = rows.withWatermark(ts, watermark).groupBy(*keys, w).agg(
            F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
        return agg.select(*keys, F.unix_millis("window.start").alias("window_start"), "n", "mean", "std", "min", "max")

    return run(stream, "append", counts=counts, home=home, closing=ts, stateful=windows).drop("batch")


def chunk_scores(stream: DataFrame, session: str, ts: str, score: str, size: str = "15 seconds", *, watermark: str, home: str | None = None) -> DataFrame:
    """Mean score per chunk, then the mean of the chunks per session."""
    def chunks(rows: DataFrame) -> DataFrame:
        agg = rows.withWatermark(ts, watermark).groupBy(session, F.window(ts, size)).agg(F.avg(score).alias("p"))
        return agg.select(session, F.unix_millis("window.start").alias("chunk_start"), "p")

    done = run(stream, "append", home=home, closing=ts, stateful=chunks)
    return done.groupBy(session).agg(F.count(F.lit(1)).alias("chunks_used"), F.avg("p").alias("probability"))


def session_scores(stream: DataFrame, session: str, order: list[str], score: str, home: str | None = None) -> DataFrame:
    """The latest score of each session and the number of uploads so far; one row of state a session, as the result is one row a session."""
    agg = stream.groupBy(session).agg(F.count(F.lit(1)).alias("uploads"), F.max_by(score, F.struct(*order)).alias("latest_score"), F.max(score).alias("highest_score"))
    return latest(run(agg, "update", home=home), [session])


def dedup(stream: DataFrame, keys: list[str], ts: str, *, watermark: str, home: str | None = None) -> DataFrame:
    """First occurrence of each key while its repetitions lie within the watermark."""
    def first(rows: DataFrame) -> DataFrame:
        return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)

    return run(stream, "append", home=home, closing=ts, stateful=first).where(F.unix_micros(ts) < END).drop("batch")


def new_media(stream: DataFrame, done: DataFrame, key: str, home: str | None = None) -> DataFrame:
    """Rows whose session is not done yet; the finished sessions are a static table."""
    return run(stream.join(done.select(key).distinct(), key, "left_anti"), "append", home=home).drop("batch")


def upsert_features(stream: DataFrame, initial: DataFrame, key: str, home: str | None = None) -> DataFrame:
    """Replace the rows of the sessions in each batch, keep the rest; a batch rewrites the hash buckets of its sessions alone."""
    spark = stream.sparkSession
    home = home or shared_dir(spark, "upsert")
    table = BucketedTable(spark, f"{home}/table", key, initial.schema)
    if not table.versions():
        table.create(initial)
    stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()
