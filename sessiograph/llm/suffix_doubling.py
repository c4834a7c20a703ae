"""Repeated strings by prefix doubling: Spark sorts (rank, rank further on) of every position at growing offsets.

The first rank of a position is its FIRST bytes packed into an integer, so ranks order the strings and equal ranks mean equal bytes; no
hash decides. A round joins the rank of a position with the rank H further on, sorts the pairs by range and numbers them anew.
A pair that occurs once can be part of no repeated string and leaves; so does a position whose partner has left.
The last round overlaps: ranks of the greatest doubled length below LENGTH, LENGTH minus that apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, narrow, stored
from .suffix_dedup import LENGTH, SEGMENT, _result

#: Bytes of the first rank.
FIRST = 8
RANKS = "rid long, pos long, rank long"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + len(texts)), pa.int64()), batch.column(0), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=["rid", "doc_id", "body", "sha"])
        row += len(texts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIRST bytes of every position as a signed integer in byte order."""
    for batch in batches:
        for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for lo in range(0, len(body) - FIRST + 1, SEGMENT):
                data = np.frombuffer(body, np.uint8)[lo : lo + SEGMENT + FIRST - 1].astype(np.uint64)
                n = len(data) - FIRST + 1
                code = np.zeros(n, np.uint64)
                for i in range(FIRST):
                    code = (code << np.uint64(8)) | data[i : i + n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rid)), pa.array(np.arange(lo, lo + n)), pa.array((code ^ np.uint64(1 << 63)).view(np.int64))], names=["rid", "pos", "rank"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New ranks of sorted rows (rid, pos, a, b): one number for equal (a, b), in order; pairs that occur once are left out."""
    number = TaskContext.get().partitionId() << 40
    held = [np.zeros(0, np.int64)] * 4  # the last row, whose successor is not known yet
    again = False  # it equals the one before it
    for batch in batches:
        rid, pos, a, b = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        if not len(rid):
            continue
        as_before = np.concatenate([[again], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        rank = number + np.cumsum(~as_before)
        out = np.flatnonzero(as_before[:-1] | as_before[1:])
        yield pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(pos[out]), pa.array(rank[out])], names=["rid", "pos", "rank"])
        held, again = [x[-1:] for x in (rid, pos, a, b)], bool(as_before[-1])
        number = int(rank[-1]) - (not again)  # the held row counts again with the next batch
    if again:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array([number], pa.int64())], names=["rid", "pos", "rank"])


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    return stored(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(_number, RANKS), name)


def repeated_positions(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, pos, rank of every position of ``bodies`` (rid, body) whose ``length`` bytes occur again anywhere; ranks follow byte order.

    A text shorter than ``length`` has no position, nor has a null or empty body. ``length`` is at least FIRST.
    """
    if length < FIRST:
        raise ValueError(f"length must be at least {FIRST}")
    first = bodies.where(F.length("body") >= length).select("rid", "body").mapInArrow(_packed, RANKS)
    open_, have = _ranked(first.select("rid", "pos", F.col("rank").alias("a"), F.lit(0).cast("long").alias("b")), "ranks"), FIRST
    while have < length:
        step = min(have, length - have)
        ahead = open_.select("rid", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = open_.withColumnRenamed("rank", "a").join(ahead, ["rid", "pos"]).select("rid", "pos", "a", "b")
        done, open_, have = open_, _ranked(pairs, "ranks"), have + step
        discard(done)
    return open_


def doubled_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``suffix_dedup.repeated_spans`` by rank doubling, without any hash between a string and its rank.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every input row. A null text counts as empty; repeated rows are copies like
    any others; an empty table gives an empty result; other columns are ignored. The rows of one rank stream through one task, in
    constant memory, however many they are. Every round shuffles about 50 bytes for each byte of text that is still open.
    """
    bodies = stored(narrow(docs, id_col, text_col).mapInArrow(_bodies, "rid long, doc_id long, body binary, sha binary"), "bodies")
    open_ = repeated_positions(bodies)
    starts = open_.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("starts"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    cut = (bodies.join(starts, "rid").select("rid", "body", none.alias("runs"), "starts")
           .mapInArrow(_result, "rid long, n_removed long, n_spans long, kept binary").withColumnRenamed("rid", "of"))
    found = bodies.join(cut, F.col("rid") == F.col("of"), "left")
    return found.select("doc_id", F.length("body").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"))
