"""Exact duplicates: Golomb-coded fingerprints travel, texts only of suspects.

Each input partition (a block) sends every owner the sorted distinct fingerprints of the owner's hash range as Golomb-Rice
code, and gets back one bit per fingerprint: seen by another block or not. Rows whose fingerprint repeats inside the
block or carries a bit are suspects; their texts are shuffled once and compared byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import addressed, discard, keep_marked, parts_for, stored

#: Fingerprints one owner holds on average (8 bytes each while it decodes).
PER_OWNER = 4_000_000
PRINTS = "message boolean, block int, row long, owner int, doc_id long, raw long, print long, sha binary, code binary"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb-Rice code of their gaps.

    Header: count, parameter, first value; then all quotients in unary, then all remainders.
    """
    n = len(values)
    if not n:
        return struct.pack("<IBQ", 0, 0, 0)
    gaps = np.diff(values)
    mean = (int(values[-1]) - int(values[0])) // max(1, n - 1)
    k = max(0, min(57, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return struct.pack("<IBQ", n, k, int(values[0])) + struct.pack("<I", len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    n, k, first = struct.unpack_from("<IBQ", code)
    if not n:
        return np.zeros(0, np.uint64)
    (bits,) = struct.unpack_from("<I", code, 13)
    at = 17 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, (bits + 7) // 8, 17), count=bits))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=at), count=(n - 1) * k).reshape(n - 1, k)
        gaps += rest.astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return np.concatenate([np.array([first], np.uint64), np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def _fingerprint(owners: int):
    """Rows of one partition, and behind them its messages to the owners."""
    width = -(-(1 << 64) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, seen = TaskContext.get().partitionId(), 0, [np.zeros(0, np.uint64)]
        for batch in batches:
            shas = [hashlib.sha256((t or "").encode().lower()).digest() for t in batch.column(1).to_pylist()]
            prints = np.frombuffer(b"".join(x[:8] for x in shas), "<u8")
            seen.append(np.unique(prints))
            n = len(shas)
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * n), pa.array([block] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()),
                 pa.array([int(p) // width for p in prints.tolist()], pa.int32()), batch.column(0), batch.column(2), pa.array(prints.view("<i8")),
                 pa.array(shas, pa.binary()), pa.nulls(n, pa.binary())],
                names=["message", "block", "row", "owner", "doc_id", "raw", "print", "sha", "code"])
            row += n
            if len(seen) > 64:
                seen = [np.unique(np.concatenate(seen))]
        mine = np.unique(np.concatenate(seen))
        of = np.array([v // width for v in mine.tolist()], np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for part in np.split(mine, cuts) if len(mine) else []:
            yield pa.RecordBatch.from_arrays(
                [pa.array([True]), pa.array([block], pa.int32()), pa.nulls(1, pa.int64()), pa.array([int(part[0]) // width], pa.int32()),
                 pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([golomb_encode(part)], pa.binary())],
                names=["message", "block", "row", "owner", "doc_id", "raw", "print", "sha", "code"])

    return run


def _mark(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner: for every block a bitmap over its fingerprints, set where another block has the same one."""
    sent = [golomb_decode(c) for c in messages["code"]]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    twice = values[counts > 1]
    return pd.DataFrame({"block": messages["block"], "owner": messages["owner"],
                         "bitmap": [np.packbits(np.isin(s, twice, assume_unique=True)).tobytes() for s in sent]})


def _suspect(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """One block: flags from its own repeats and from the owners' bitmaps, which follow the sorted distinct fingerprints."""
    prints = rows["print"].to_numpy().view(np.uint64)
    values, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
    owner = np.zeros(len(values), np.int64)
    owner[inverse] = rows["owner"].to_numpy()
    flags = counts > 1
    bits = dict(zip(bitmaps["owner"].to_pylist(), bitmaps["bitmap"].to_pylist(), strict=True))
    for o in np.unique(owner).tolist():
        where = np.flatnonzero(owner == o)
        flags[where] |= np.unpackbits(np.frombuffer(bits[o], np.uint8), count=len(where)).astype(bool)
    return rows.select(["block", "row", "doc_id", "raw", "sha"]).append_column("suspect", pa.array(flags[inverse]))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and bytes of the normalised text; only rows whose text is the suspect one (two texts of one id may share a 64-bit hash)."""
    for batch in batches:
        texts = [(t or "").encode().lower() for t in batch.column(0).to_pylist()]
        shas = [hashlib.sha256(t).digest() for t in texts]
        kept = [i for i, s in enumerate(batch.column(1).to_pylist()) if s == shas[i]]
        yield pa.RecordBatch.from_arrays([pa.array([shas[i] for i in kept], pa.binary()), pa.array([texts[i] for i in kept], pa.binary())], names=["sha", "body"])


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, keep_id, size, kept, sha of every input row."""
    rows = addressed(docs, id_col, text_col)
    owners = parts_for(rows.count(), PER_OWNER, 8)
    both = stored(rows.mapInArrow(_fingerprint(owners), PRINTS), "prints", "message")
    prints = both.where(~F.col("message")).select("block", "row", "owner", "doc_id", "raw", "print", "sha")
    bitmaps = (both.where(F.col("message")).select("block", "owner", "code").groupBy("owner")
               .applyInPandas(_mark, "block int, owner int, bitmap binary"))
    flagged = stored(prints.groupBy("block").cogroup(bitmaps.groupBy("block"))
                     .applyInArrow(_suspect, "block int, row long, doc_id long, raw long, sha binary, suspect boolean"), "suspects")
    discard(both)
    suspects = flagged.where("suspect")
    asked = suspects.select(F.col("doc_id").alias("id"), F.col("raw").alias("of"), "sha").distinct()
    bodies = rows.join(asked, rows["doc_id"].eqNullSafe(asked["id"]) & (rows["raw"] == asked["of"])).select("text", "sha").mapInArrow(_normalise, "sha binary, body binary")
    checked = (bodies.groupBy("sha", "body").agg(F.count("*").alias("n")).groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("size")))
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "block", "row")).alias("top"))
    verified = stored(groups.join(checked, "sha").select(
        F.col("sha").alias("of"), "top", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).cast("long").alias("size")), "groups")
    found = suspects.join(verified, suspects["sha"] == verified["of"])
    return found.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "size", ((F.col("block") == F.col("top.block")) & (F.col("row") == F.col("top.row"))).alias("kept"), "sha",
    ).unionByName(flagged.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha",
    ))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the largest id
    stays (a null id is the smallest); of repeated rows with that id exactly one has ``kept``. An empty table gives an
    empty result. Other columns of ``docs`` are ignored.
    """
    return _groups(docs, id_col, text_col).select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    flags = _groups(docs, id_col, text_col).select("doc_id", F.col("sha").alias("digest"), "kept")
    return keep_marked(docs, flags, id_col, text_col, lambda texts: [hashlib.sha256(t.encode().lower()).digest() for t in texts])
