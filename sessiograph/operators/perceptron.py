"""The multilayer perceptron of Spark ML, fitted over blocks of weighted rows.

Spark's learner has no row weights and is slow in each pass over the rows. This one gives rows of equal values their number as
weight, keeps them as matrices, and sums loss and gradient per task; the driver gets one vector a task and takes the steps. Network, first weights, loss, step rule and limits are those of the learner, and so is the model returned.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import feature as ft
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, packed
from .models import assemble

#: Rows of one matrix, and of one stored file: a pass reads as many files in a task as leave work for all cores.
BLOCK, PER_FILE = 512, 10_000


def layers_of(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of each layer, as views."""
    out, at = [], 0
    for i, o in zip(layers, layers[1:]):
        out.append((weights[at : at + i * o].reshape(i, o), weights[at + i * o : at + i * o + o]))
        at += (i + 1) * o
    return out


def loss_and_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the rows' cross entropies, each ``n`` times, then of its gradient: logistic hidden layers, softmax at the end."""
    net, seen = layers_of(weights, layers), [x]
    for w, b in net[:-1]:
        a = seen[-1] @ w
        a += b
        np.clip(a, -700, None, out=a)
        np.negative(a, out=a)
        np.exp(a, out=a)
        a += 1
        seen.append(np.reciprocal(a, out=a))
    p = seen[-1] @ net[-1][0] + net[-1][1]
    p -= p.max(axis=1, keepdims=True)
    rows, own = np.arange(len(p)), label.astype(int)
    logits = p[rows, own]
    np.exp(p, out=p)
    total = p.sum(axis=1)
    out = np.empty(len(weights) + 1)
    out[0] = n @ (np.log(total) - logits)
    p /= total[:, None]
    p[rows, own] -= 1
    delta = p * n[:, None]
    slots = layers_of(out[1:], layers)
    for i in range(len(net) - 1, -1, -1):
        np.matmul(seen[i].T, delta, out=slots[i][0])
        slots[i][1][:] = delta.sum(axis=0)
        if i:
            delta = delta @ net[i][0].T
            delta *= seen[i]
            delta *= 1 - seen[i]
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """``x`` (array), ``label`` and ``n`` as stored matrices of at most ``BLOCK`` rows; the last two columns are label and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            all_ = np.column_stack([x, batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array([all_[i : i + BLOCK].tobytes() for i in range(0, len(all_), BLOCK)], pa.binary())], names=["block"])

    return rows.select("x", F.col("label").cast("double"), F.col("n").cast("double")).mapInArrow(run, "block binary")


def total_over(stored: RDD, layers: list[int], weights: np.ndarray) -> np.ndarray:
    """``loss_and_gradient`` summed over all blocks: one vector per task comes to the driver."""

    def run(parts: Iterator[bytes]) -> Iterator[np.ndarray]:
        out = np.zeros(len(weights) + 1)
        for part in parts:
            m = np.frombuffer(part).reshape(-1, layers[0] + 2)
            out += loss_and_gradient(weights, layers, np.ascontiguousarray(m[:, :-2]), m[:, -2], m[:, -1])
        yield out

    return np.sum(stored.mapPartitions(run).collect(), axis=0)


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with a Wolfe line search. Ends as Spark's does: when 20 values or the gradient no longer move, or after ``iterations``."""
    value, slope = f(at)
    first, past, pairs = abs(value), deque([np.inf], maxlen=20), deque(maxlen=memory)
    for _ in range(iterations):
        if np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8):
            break
        way, kept = -slope, []
        for s, y in reversed(pairs):
            kept.append(s @ way / (s @ y))
            way = way - kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            way = way + (a - y @ way / (s @ y)) * s
        down, low, high, step = slope @ way, 0.0, np.inf, 1.0 if pairs else 1 / max(1e-12, np.linalg.norm(slope))
        for _ in range(20):
            there, (v, g) = at + step * way, f(at + step * way)
            if not v <= value + 1e-4 * step * down:
                high = step
            elif g @ way < 0.9 * down:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        else:
            break
        pairs.append((there - at, g - slope))
        at, value, slope = there, v, g
        past.append(value)
        if max(past) - value <= tolerance * first:
            break
    return at


def fit_perceptron(train: DataFrame, features: list[str], learner: MultilayerPerceptronClassifier) -> PipelineModel:
    """The pipeline ``models.numeric_pipeline`` gives for ``learner``; ``train`` has the feature columns, without nulls, and ``label``."""
    layers, spark = learner.getLayers(), train.sparkSession
    scaled = Pipeline(stages=[assemble(features, "raw"), ft.StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
    merged = scaled.transform(train.groupBy(*features, "label").agg(F.count(F.lit(1)).alias("n")))
    rows = durable(merged.select(vector_to_array("features").alias("x"), "label", "n"), "merged")
    stored = durable(blocks(packed(rows, rows.count(), PER_FILE)), "blocks").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.agg(F.sum("n")).first()[0]
    # no iteration: the learner's own first weights, or a model of given ones
    still = learner.copy({learner.maxIter: 0})
    two = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(c)) for c in range(layers[-1])], ["features", "label"])

    def mean(w: np.ndarray) -> tuple[float, np.ndarray]:
        out = total_over(stored, layers, w) / n
        return float(out[0]), out[1:]

    found = minimize(mean, still.fit(two).weights.toArray(), learner.getMaxIter(), learner.getTol())
    stored.unpersist()
    return PipelineModel([*scaled.stages, still.copy({still.initialWeights: Vectors.dense(found)}).setProbabilityCol("p").fit(two)])
