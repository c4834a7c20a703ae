"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Hashed n-grams of the lower-cased text (letters as they are, everything else one boundary mark), inverse document
frequencies over all training rows, weights by follow-the-regularised-leader with elastic-net penalties, and one
temperature fitted on rows the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, narrow, slices, stored
from ._hashing import mix

#: Hash buckets, n-gram lengths, and the documented bound on rows per language that the weights are fitted on.
BUCKETS, LENGTHS, ROWS_PER_LANGUAGE = 1 << 14, (1, 2, 3), 2000
ALPHA, BETA, L1, L2, EPOCHS, SHARDS = 0.5, 1.0, 0.02, 0.05, 3, 8
SAMPLE = "lang string, held boolean, buckets array<int>, weights array<float>"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often; n-grams without a letter do not count."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # runs of other characters become one boundary
    marks = np.concatenate([[0], np.where(letter, points, 0)[kept], [0]]).astype(np.uint64)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, acc = [], np.zeros(len(marks), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        acc = acc[: len(marks) - n + 1] * np.uint64(0x100000001B3) + marks[n - 1 :] + np.uint64(n)
        if n in LENGTHS:
            code = acc[marks[: len(acc)] > 0] if n == 1 else acc
            codes.append((mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64))
    counts = np.bincount(np.concatenate(codes), minlength=BUCKETS)
    there = np.flatnonzero(counts)
    return there, counts[there]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there, counts = ngram_counts(text)
    values = (1 + np.log(counts)) * idf[there]
    norm = np.sqrt((values * values).sum())
    return there, values / norm if norm else values


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df[ngram_counts(text or "")[0]] += 1
            n += 1
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1).astype(np.int32)), pa.array(np.append(df[there], n))], names=["bucket", "n"])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Languages, inverse document frequencies, weights (the last row is the bias) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, there: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[there] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        there, values = _vector(text or "", self.idf)
        if not len(there) or not self.langs:
            return "und", 0.0
        p = _softmax(self.logits(there, values) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _shard_step(langs: list[str], z: np.ndarray, n: np.ndarray, seed: int):
    """One pass of a shard's rows, from the common state; returns the state it ends with."""
    index = {x: i for i, x in enumerate(langs)}

    def run(rows: pa.Table) -> pa.Table:
        zs, ns = z.copy(), n.copy()
        data = [r for r in rows.select(["lang", "held", "buckets", "weights"]).to_pylist() if not r["held"]]
        data.sort(key=lambda r: (r["lang"], len(r["buckets"]), r["buckets"][:8]))
        for i in np.random.default_rng(seed).permutation(len(data)):
            r = data[i]
            at, x = np.array([*r["buckets"], len(z) - 1]), np.array([*r["weights"], 1.0])
            w = _weights(zs[at], ns[at])
            p = _softmax(x @ w)
            p[index[r["lang"]]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns[at] + g * g) - np.sqrt(ns[at])) / ALPHA
            zs[at] += g - sigma * w
            ns[at] += g * g
        return pa.table({"rows": pa.array([len(data)], pa.int64()), "z": pa.array([zs.tobytes()], pa.binary()), "n": pa.array([ns.tobytes()], pa.binary())})

    return run


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Least log loss over 1/64 to 64, by golden section on the logarithm."""
    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-300)).sum())

    lo, hi, g = np.log(1 / 64), np.log(64), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(rows: DataFrame) -> Model:
    """``rows``: doc_id, text, lang (not null). Weights are fitted on at most about ROWS_PER_LANGUAGE rows of each
    language, chosen by hash of the id, a fifth of them for the temperature; document frequencies cover all rows."""
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a class of the model
    langs = sorted(per)
    if not langs:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    df = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequency, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(b, 0) for b in range(BUCKETS)]))) + 1
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, ROWS_PER_LANGUAGE / per[lang])))])
    spread = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
    sample = rows.where(spread < 1_000_000 * F.element_at(share, F.col("lang"))).select("text", "lang", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_vector(t or "", idf) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
                                              pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["lang", "held", "buckets", "weights"])

    data = stored(sample.mapInArrow(features, SAMPLE).where(F.size("buckets") > 0).withColumn("shard", F.pmod(F.xxhash64("buckets"), F.lit(SHARDS)).cast("int")), "sample")
    shape = (BUCKETS + 1, len(langs))
    z, n = np.zeros(shape), np.zeros(shape)
    for epoch in range(EPOCHS):
        parts = data.groupBy("shard").applyInArrow(_shard_step(langs, z, n, epoch), "rows long, z binary, n binary").collect()  # SHARDS rows
        used = [p for p in parts if p["rows"]]
        if not used:
            break
        z, n = (sum(np.frombuffer(p[c]).reshape(shape) * p["rows"] for p in used) / sum(p["rows"] for p in used) for c in ("z", "n"))
    model = Model(langs, idf, _weights(z, n), 1.0)

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [r for r in batch.to_pylist() if r["held"]]
            yield pa.RecordBatch.from_arrays([pa.array([langs.index(r["lang"]) for r in rows_], pa.int32()), pa.array(
                [model.logits(np.array(r["buckets"]), np.array(r["weights"])).tolist() for r in rows_], pa.list_(pa.float64()))], names=["truth", "logits"])

    held = data.select("lang", "held", "buckets", "weights").mapInArrow(outcome, "truth int, logits array<double>").collect()  # bounded with the sample
    if held:
        model.temperature = _temperature(np.array([h["logits"] for h in held]), np.array([h["truth"] for h in held]))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score. ``und`` with score 0 for a null text or one without a letter, and
    for every row where nothing was learned. Repeated rows and null ids keep their rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([t or "" for t in texts], 4_000_000):
                found = [model.predict(t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from rows whose crc32(id as text) mod 3 is not 1 and that have a language.
    Rows with a null id are held out."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    model = fit(rows.where(F.col("lang").isNotNull() & ~held))
    return identify(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score")
