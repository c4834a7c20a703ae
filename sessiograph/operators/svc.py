"""The linear SVC of Spark ML, several fits over the same rows at a time.

Spark's learner runs a job per fit and evaluation and goes through the rows as scaled vectors. Here the rows are stored once as blocks of
non-zero values. Small tables are kept by one task a fit; of larger ones a pass sums loss and gradient of all fits that still run, and the driver gets one vector a task and fit. Loss, scaling, step
rule and limits are those of the learner (orthant-wise L-BFGS without an L1 term, as Breeze has it), and so is the model returned.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Non-zero values of one block at most, unless a row has more, and of all blocks that one task keeps (16 bytes each).
BLOCK, TOGETHER = 300_000, 16_000_000

Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blocks(rows: DataFrame, features: str, part: str) -> DataFrame:
    """Rows as blocks of one ``part`` each: its number, labels and weights, how many values a row has, their places and the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, places, values = batch.column(0), batch.column(1), batch.column(2)
            many = values.value_lengths().to_numpy()
            value, row = values.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), many)
            whole = dense.to_numpy() == 1
            place = np.empty(len(value), np.int32)
            place[~whole[row]] = places.flatten().to_numpy()
            place[whole[row]] = (np.arange(len(value)) - np.repeat(np.cumsum(many) - many, many))[whole[row]]
            there = value != 0
            value, place, row = value[there], place[there], row[there]
            label, weight, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            out = []
            for p in np.unique(number):
                mine = np.flatnonzero(number == p)
                size = np.bincount(row, minlength=batch.num_rows)[mine]
                own = number[row] == p
                v, at, ends = value[own], place[own], np.cumsum(size)
                lo = 0
                while lo < len(mine):
                    before = ends[lo] - size[lo]
                    hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                    a, b = before, ends[hi - 1]
                    head = np.array([p, hi - lo, b - a], np.int64)
                    out.append(b"".join(x.tobytes() for x in (head, label[mine[lo:hi]], weight[mine[lo:hi]], v[a:b], size[lo:hi].astype(np.int32), at[a:b].astype(np.int32))))
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary()).cast(pa.binary())], names=["block"])

    v = F.unwrap_udt(features)
    shown = rows.select(v["type"].cast("int").alias("type"), F.coalesce(v["indices"], F.array().cast("array<int>")).alias("indices"), v["values"].alias("values"),
                        F.when(F.col("label").isin(0, 1), F.col("label").cast("double")).otherwise(F.raise_error(F.lit("labels are 0 or 1"))).alias("label"), F.col("weight").cast("double").alias("weight"), F.col(part).cast("int").alias("part"))
    return shown.mapInArrow(run, "block binary")


def opened(block: bytes) -> Block:
    """Part, labels, weights, values, lengths and places of a stored block."""
    part, rows, n = np.frombuffer(block, np.int64, 3)
    at, out = 24, []
    for kind, size in ((np.float64, rows), (np.float64, rows), (np.float64, n), (np.int32, rows), (np.int32, n)):
        out.append(np.frombuffer(block, kind, size, at))
        at += out[-1].nbytes
    return int(part), *out[:-1], out[-1].astype(np.intp)


def moments(every: Iterable[Block], parts: int, width: int) -> np.ndarray:
    """Per part: the number of values, the sums of weights and of their squares, then of values and of their squares, weighted."""
    out = np.zeros((parts, 3 + 2 * width))
    for part, _, weight, value, size, place in every:
        heavy = np.repeat(weight, size) * value
        out[part, :3] += len(value), weight.sum(), weight @ weight
        out[part, 3 : 3 + width] += np.bincount(place, heavy, width)
        out[part, 3 + width :] += np.bincount(place, heavy * value, width)
    return out


def hinge(every: Iterable[Block], asked: dict[int, tuple[np.ndarray, float]], width: int) -> dict[int, np.ndarray]:
    """Sums over the blocks outside of part i, for every fit i asked for by its weights and offset: hinge loss, its slope by the offset, its gradient."""
    out = {i: np.zeros(2 + width) for i in asked}
    for part, label, weight, value, size, place in every:
        some = size > 0
        start, sign = (np.cumsum(size) - size)[some], 2 * label - 1
        for i, (w, offset) in asked.items():
            if i == part:
                continue
            margin = np.full(len(label), offset)
            if len(start):
                margin[some] += np.add.reduceat(value * w.take(place), start)
            loss = 1 - sign * margin
            slope = np.where(loss > 0, -sign * weight, 0.0)
            out[i][0] += np.maximum(loss, 0) @ weight
            out[i][1] += slope.sum()
            out[i][2:] += np.bincount(place, np.repeat(slope, size) * value, width)
    return out


class Fit:
    """One fit: columns have mean 0 and deviation 1 (unbiased, weighted) over its rows; the mean loss and an L2 term on all but the offset."""

    def __init__(self, sums: np.ndarray, reg: float, iterations: int, tolerance: float):
        width = (len(sums) - 3) // 2
        self.reg, self.weight, self.mean = reg, sums[1], sums[3 : 3 + width] / sums[1]
        apart = sums[3 + width :] - self.weight * self.mean * self.mean
        spread = np.sqrt(np.maximum(apart, 0) / (self.weight - sums[2] / self.weight))
        # what is left of a column of one value is rounding
        self.scale = np.divide(1.0, spread, out=np.zeros(width), where=apart > 1e-10 * sums[3 + width :])
        self.run = search(np.zeros(width + 1), iterations, tolerance)
        self.x = next(self.run)

    def point(self) -> tuple[np.ndarray, float]:
        """Weights and offset of unscaled rows at the point that is asked for."""
        w = self.x[:-1] * self.scale
        return w, float(self.x[-1] - w @ self.mean)

    def step(self, found: np.ndarray) -> bool:
        """Take the sums at the point; whether another one is asked for."""
        w = self.x[:-1]
        value = float(found[0] / self.weight + self.reg / 2 * (w @ w))
        gradient = np.append(self.scale * (found[2:] - found[1] * self.mean) / self.weight + self.reg * w, found[1] / self.weight)
        try:
            self.x = self.run.send((value, gradient))
        except StopIteration as end:
            self.x = end.value
            return False
        return True


def search(at: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimize a function step by step: yields a point, is sent its value and gradient, returns the last point.

    Orthant-wise L-BFGS as Spark's learner uses it: a coordinate stops at zero before it changes sign; the line search halves its first step, and on until the value has
    fallen enough, and then asks that the slope along the direction be flat enough. Ends when 20 values or the gradient no longer move, or after ``iterations``.
    """
    value, slope = yield at
    first, past, pairs, failed, done = value, deque([np.inf], maxlen=20), deque(maxlen=memory), False, 0
    while done < iterations and np.linalg.norm(slope) > max(tolerance * abs(value), 1e-8) and not (len(past) > 1 and abs(value - max(past)) <= tolerance * first):
        step = way = None
        if not pairs or pairs[0][0] @ pairs[0][1] >= 0:
            way, kept = slope.copy(), []
            with np.errstate(all="ignore"):
                for s, y in pairs:
                    kept.append(s @ way / (s @ y))
                    way -= kept[-1] * y
                if pairs:
                    s, y = pairs[0]
                    way *= s @ y / (y @ y)
                for (s, y), a in zip(reversed(pairs), reversed(kept), strict=True):
                    way += (a - y @ way / (s @ y)) * s
            way = np.where(-way * slope < 0, -way, 0.0)
            if not np.isnan(kept).any():
                side = np.where(at != 0, np.sign(at), np.sign(-slope))

                def there(alpha: float) -> np.ndarray:
                    x = at + alpha * way
                    return np.where(np.sign(x) == side, x, 0.0)
                shrink, step, down = (0.5, 1.0, slope @ way) if done else (0.1, 0.5 / np.linalg.norm(slope), slope @ way)
                # the first step is judged by the value at its start, so it is shortened wherever the direction leads down: it needs no pass
                x, v, g = there(step), value, slope
                if not value > value + 1e-4 * step * down:
                    v, g = yield x
                for trial in range(20):
                    steep = g @ way
                    by = shrink if (v if trial else value) > value + 1e-4 * step * down else 2.1 if steep < 0.9 * down else shrink if steep > -0.9 * down else 1.0
                    if by == 1:
                        break
                    if not 1e-10 <= step * by <= 1e10:
                        step = None
                        break
                    tried = there(step * by)
                    seen = yield tried
                    if trial < 19:
                        step, x, (v, g) = step * by, tried, seen
        if step is None:  # start anew from the gradient, once
            if failed:
                break
            failed = True
            pairs.clear()
            continue
        pairs.appendleft((x - at, g - slope))
        at, value, slope, failed, done = x, v, g, False, done + 1
        past.append(value)
    return at


def fit_svcs(rows: DataFrame, learner: LinearSVC, part: str, parts: int) -> list[LinearSVCModel]:
    """One model without the rows of each of the ``parts`` (a column that numbers them), then one of all rows; ``rows``: label, weight, features.

    Values that fit into one task are kept there, and every fit runs in a task of its own; otherwise a pass is a job over all blocks.
    """
    spark, features = rows.sparkSession, learner.getFeaturesCol()
    width = len(rows.select(features).first()[0])
    stored = durable(blocks(rows, features, part), "blocks").rdd.map(lambda r: bytes(r[0]))
    sums = np.sum(stored.mapPartitions(lambda every: [moments(map(opened, every), parts, width)]).collect(), axis=0)
    settings = learner.getRegParam(), learner.getMaxIter(), learner.getTol()

    def fit_of(i: int, sums: np.ndarray) -> Fit:
        return Fit(sums[[k for k in range(parts) if k != i]].sum(axis=0), *settings)

    if sums[:, 0].sum() <= TOGETHER:
        def alone(every: Iterator[bytes], i: int) -> Iterator[tuple[np.ndarray, float]]:
            own = [b for b in map(opened, every) if b[0] != i]
            fit = fit_of(i, moments(own, parts, width))
            while fit.step(hinge(own, {i: fit.point()}, width)[i]):
                pass
            yield fit.point()

        one = stored.coalesce(1)
        found = spark.sparkContext.union([one.mapPartitions(lambda every, i=i: alone(every, i)) for i in range(parts + 1)]).collect()
    else:
        stored.persist(StorageLevel.MEMORY_AND_DISK)
        fits = {i: fit_of(i, sums) for i in range(parts + 1)}
        going = dict(fits)
        while going:
            asked = {i: fit.point() for i, fit in going.items()}
            seen = stored.mapPartitions(lambda every, asked=asked: [hinge(map(opened, every), asked, width)]).collect()
            going = {i: fit for i, fit in going.items() if fit.step(np.sum([x[i] for x in seen], axis=0))}
        stored.unpersist()
        found = [fits[i].point() for i in range(parts + 1)]
    made = spark._jvm.org.apache.spark.ml.classification.LinearSVCModel
    return [learner._copyValues(LinearSVCModel(made(learner.uid, _py2java(spark.sparkContext, Vectors.dense(w)), offset))) for w, offset in found]
