"""Repeated strings by grouping hashes at sampled anchors; rank doubling over every position is in ``suffix_doubling``.

Of every window of LENGTH bytes the least SEED-byte gram (by hash) is its anchor, which equal windows choose alike. Anchors are
grouped by the hash of their SEED bytes; unique ones are done. An anchor whose whole neighbourhood (all windows it stands for) has
an equal is done too, and one member of equal neighbourhoods stands for the others. What is left is grouped by hashes at growing
lengths: first COARSE bytes at every STEP-th offset, then LENGTH bytes at every offset, and what becomes unique goes at
each step. Texts that repeat as a whole need no fetching: one of them stands for all, and all of their bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import addressed, discard, slices, stored
from ._hashing import joined, mix, prefix, spans

LENGTH, SEED, STEP = 200, 50, 25
COARSE = LENGTH - STEP
#: Texts are read in segments of this many window starts.
SEGMENT = 500_000
FIRST = "anchor boolean, rid long, doc_id long, raw long, n_bytes long, sha binary, seed long, whole long, place long"


def _place(p1: np.ndarray, anchor: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """First window, distance to the anchor and number of further windows in one integer."""
    return (p1 << 20) | ((anchor - p1) << 10) | (p2 - p1)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p1 = place >> 20
    return p1, p1 + ((place >> 10) & 1023), p1 + (place & 1023)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, seed hash, neighbourhood hash and place (``_place``, in the text) of every anchor of short texts."""
    data, at = joined(texts)
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    p = prefix(data)
    grams = spans(p, np.arange(len(data) - SEED + 1), np.arange(SEED, len(data) + 1))
    least = (grams & np.uint64(~((1 << 28) - 1) & ((1 << 64) - 1))) | np.arange(len(grams), dtype=np.uint64)
    width, have = LENGTH - SEED + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    starts = [np.arange(lo, hi - LENGTH + 1) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if hi - lo >= LENGTH]
    if not starts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    window = np.concatenate(starts)
    anchor = (least[window] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    p1, p2, a = window[new], window[np.append(new[1:], len(window)) - 1], anchor[new]
    whole = mix(spans(p, p1, p2 + LENGTH) ^ ((a - p1) * 1024 + p2 - p1).astype(np.uint64))
    text = np.searchsorted(at, p1, side="right") - 1
    base = at[text]
    return text, grams[a], whole, _place(p1 - base, a - base, p2 - base)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every text, then rows for its anchors."""
    row = TaskContext.get().partitionId() << 33
    names = ["anchor", "rid", "doc_id", "raw", "n_bytes", "sha", "seed", "whole", "place"]
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * n), pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), *[pa.nulls(n, pa.int64())] * 3], names=names)
        parts = [(i, s, t[s : s + SEGMENT + LENGTH - 1]) for i, t in enumerate(texts) if len(t) >= LENGTH for s in range(0, len(t) - LENGTH + 1, SEGMENT)]
        for lo, hi in slices([t for _, _, t in parts], SEGMENT):
            text, seed, whole, place = anchors([t for _, _, t in parts[lo:hi]])
            m = len(text)
            of = np.array([i for i, _, _ in parts[lo:hi]], np.int64)[text]
            begin = np.array([s for _, s, _ in parts[lo:hi]], np.int64)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, bool)), pa.array(of + row), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                 pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(place + (begin << 20))], names=names)
        row += n


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the rows asked for, told apart by SHA-256 too. Repeated rows with one id follow each other: one of them is enough."""
    before = None
    for batch in batches:
        texts, rids = [(t or "").encode() for t in batch.column(0).to_pylist()], batch.column(2).to_pylist()
        found = [i for i, s in enumerate(batch.column(1).to_pylist()) if rids[i] != (rids[i - 1] if i else before) and hashlib.sha256(texts[i]).digest() == s]
        before = rids[-1] if rids else before
        yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(found, pa.int64())), pa.array([texts[i] for i in found], pa.binary())], names=["rid", "body"])


def _hashes(body: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of body[start, start + length); start ascends. The text is walked in ranges, so memory stays bounded."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(start, lo + SEGMENT, side="right"))
        p = prefix(body[lo : int(start[j - 1]) + length])
        out[i:j] = spans(p, start[i:j] - lo, start[i:j] - lo + length)
        i = j
    return out


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every anchor the COARSE bytes at each STEP-th offset before it that one of its windows must contain."""
    for batch in batches:
        for rid, body, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(body, np.uint8)
            place = np.sort(np.array([r["place"] for r in rows], np.int64))
            seed = {r["place"]: r["seed"] for r in rows}
            p1, a, p2 = _unplace(place)
            # a window at distance o before its anchor holds the bytes from the anchor minus o rounded down to STEP
            steps = np.arange(LENGTH // STEP)
            at = a[:, None] - STEP * steps
            used = (at >= p1[:, None]) & (at - STEP < p2[:, None] + 0) & (at + COARSE <= len(data))
            used &= np.maximum(p1[:, None], at - STEP + 1) <= np.minimum(p2[:, None], at)
            row, k = np.nonzero(used)
            start = at[row, k]
            order = np.argsort(start, kind="stable")
            code = np.zeros(len(start), np.uint64)
            code[order] = _hashes(data, start[order], COARSE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rid] * len(row), pa.int64()), pa.array([seed[x] for x in place[row].tolist()], pa.int64()), pa.array(place[row]),
                 pa.array(k.astype(np.int32)), pa.array(code.view(np.int64))], names=["rid", "seed", "place", "k", "code"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the offsets that are left, with the hash of its LENGTH bytes."""
    for batch in batches:
        for rid, body, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(body, np.uint8)
            place, k = (np.array([r[c] for r in rows], np.int64) for c in ("place", "k"))
            seeds = np.array([r["seed"] for r in rows], np.int64)
            p1, a, p2 = _unplace(place)
            lo, hi = np.maximum(p1, a - STEP * k - STEP + 1), np.minimum(p2, a - STEP * k)
            n = hi - lo + 1
            start = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            order = np.argsort(start, kind="stable")
            start, seed = start[order], np.repeat(seeds, n)[order]
            yield pa.RecordBatch.from_arrays([pa.array([rid] * len(start), pa.int64()), pa.array(seed), pa.array(start), pa.array(_hashes(data, start, LENGTH).view(np.int64))],
                                             names=["rid", "seed", "start", "code"])


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed bytes of each text from the first and last windows of its repeated runs."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for rid, body, runs, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            at = np.array(starts, np.int64)
            ends = np.flatnonzero(np.diff(at, append=-1) != 1)  # consecutive windows are one run
            firsts = np.append(0, ends[:-1] + 1) if len(at) else ends
            spans_ = sorted([*((r["lo"], r["hi"] + LENGTH) for r in runs), *zip(at[firsts].tolist(), (at[ends] + LENGTH).tolist(), strict=True)])
            kept, removed, n_spans, end = hashlib.sha256(), 0, 0, 0
            lo_now, hi_now = spans_[0]
            for lo, hi in [*spans_[1:], (len(body) + 1, len(body) + 1)]:
                if lo <= hi_now:
                    hi_now = max(hi_now, hi)
                    continue
                kept.update(body[end:lo_now])
                removed, n_spans, end = removed + hi_now - lo_now, n_spans + 1, hi_now
                lo_now, hi_now = lo, hi
            kept.update(body[end:])
            for column, x in zip(out, (rid, removed, n_spans, kept.digest()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["rid", "n_removed", "n_spans", "kept"])


def _again(rows: DataFrame, *key: str) -> DataFrame:
    """Rerank: the rows whose key is not unique. The keys are written first, so that both sides of the join are plain
    exchanges and a key with a large part of all rows can be split."""
    same = stored(rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "keys")
    return rows.join(same, list(key))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a LENGTH-byte string over it also starts anywhere else in the table; judged on UTF-8 bytes of the
    input, never across texts. Keys are two 64-bit polynomial hashes of strings of at most 350 bytes. A null text counts as empty; a repeated row is a copy like any other;
    null ids and ids with several texts are kept apart. All bytes of a text of LENGTH bytes or more that repeats as a whole go. An empty table gives an empty result; other columns are ignored.
    """
    rows = addressed(docs, id_col, text_col)
    both = stored(rows.mapInArrow(_first, FIRST), "first", "anchor")
    texts = both.where(~F.col("anchor")).select("rid", "doc_id", "raw", "n_bytes", "sha")
    # texts that repeat as a whole: the first stands for all
    copies = stored(texts.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1").select("sha", "first"), "copies")
    spare = texts.join(copies, "sha").where("rid != first").select("rid")
    # length SEED
    left = stored(_again(both.where("anchor").select("rid", "seed", "whole", "place"), "seed").join(spare, "rid", "left_anti"), "seeds")
    discard(both, "anchor=true")
    # equal neighbourhoods are past the threshold; one member stands for them among the other neighbourhoods of its seed
    wholes = stored(left.groupBy("seed", "whole").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one")), "wholes")
    several = wholes.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    open_ = wholes.join(several, "seed").select("seed", "one.rid", "one.place").groupBy("rid").agg(F.collect_list(F.struct("place", "seed")).alias("rows"))
    done = stored(left.join(wholes.where("n > 1").select("seed", "whole"), ["seed", "whole"]).select(
        "rid", F.expr("shiftright(place, 20)").alias("lo"), F.expr("shiftright(place, 20) + (place & 1023)").alias("hi")), "done")
    wanted = left.select("rid").distinct().join(texts, "rid").select("rid", F.col("doc_id").alias("id"), F.col("raw").alias("of"), "sha")
    bodies = stored(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["raw"] == wanted["of"])).select("text", "sha", "rid").mapInArrow(_asked, "rid long, body binary"), "bodies")
    discard(left)
    # length COARSE, then LENGTH; lists are the anchors of one text
    tests = stored(bodies.join(open_, "rid").select("rid", "body", "rows").mapInArrow(_tests, "rid long, seed long, place long, k int, code long"), "tests")
    discard(wholes)
    coarse = stored(_again(tests, "seed", "k", "code").groupBy("rid").agg(F.collect_list(F.struct("place", "k", "seed")).alias("rows")), "coarse")
    discard(tests)
    windows = stored(bodies.join(coarse, "rid").select("rid", "body", "rows").mapInArrow(_windows, "rid long, seed long, start long, code long"), "windows")
    discard(coarse)
    same = stored(_again(windows, "seed", "code").groupBy("rid").agg(F.sort_array(F.collect_list("start")).alias("starts")), "same")
    discard(windows)
    runs = done.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    both_runs = runs.join(same, "rid", "full").select("rid", F.coalesce("runs", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("runs"),
                                                      F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts"))
    cut = stored(bodies.join(both_runs, "rid").select("rid", "body", "runs", "starts").mapInArrow(_result, "rid long, n_removed long, n_spans long, kept binary")
                 .groupBy("rid").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept"))), "cut")
    for x in (done, same, bodies):
        discard(x)
    found = texts.join(cut, "rid", "left").join(copies, "sha", "left")
    whole = F.col("first").isNotNull()
    return found.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"))
