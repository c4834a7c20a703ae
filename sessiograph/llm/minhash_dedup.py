"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct runs of ``width`` words; the sketch is the K least of them. Equal sets are one class,
and only classes are compared. The inverted lists are kept by runs of three neighbouring sketch values: two sets with a
Jaccard similarity of 0.8 agree on at least four of five values in hash order, so they share many such runs, while
texts that merely share a passage share few. Every class leaves its most common runs aside (as many as a linked pair is sure to
have to spare); short lists give all their pairs, long ones the pairs with one leader. The union sketch of a pair estimates its similarity,
the full sets decide. Rows that a long list leaves outside its largest component are compared with the rest in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import addressed, discard, keep_marked, slices, stored
from ._hashing import joined, mix, word_hashes, word_spans
from .components import connected

#: Words of a shingle, where nothing else is asked for.
WIDTH = 2
#: Sketch size. At similarity 0.8 the chance that two sketches share no run of three is below 1e-19.
K = 128
#: Runs a class of full sketch size leaves aside at most: a pair at 0.8 shares fewer than this with a chance below 1e-8.
SPARE = 16
#: Lists up to this length give all pairs.
SHORT = 8
#: Estimates below this are no candidates; at a similarity of 0.8 or more the chance is below 1e-12.
LEAST_ESTIMATE = 0.5
#: Set values that one block of askers, and one of sets asked, holds.
ASKING, ASKED = 500_000, 2_000_000
SKETCH = "rid long, doc_id long, raw long, n long, set_hash binary, sketch array<long>"


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of each text (of the whole word sequence if it is shorter)."""
    data, at = joined(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    start, end, before = word_spans(data, at)
    words = word_hashes(data, start, end)
    runs = _runs(words, width)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        out.append(np.unique(runs[lo : hi - width + 1]) if hi - lo >= width else _runs(words[lo:hi], hi - lo))
    return out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring word hashes."""
    n = len(words) - width + 1
    if n < 1 or not width:
        return words[:0]
    out = words[:n]
    for i in range(1, width):
        out = out * np.uint64(0x9FB21C651E98DF25) + (words[i : n + i] ^ np.uint64(0xA0761D6478BD642F))
    return mix(out)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode().lower() for t in column.to_pylist()]


def _hash(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = _bytes(batch.column(1))
        for lo, hi in slices(texts, 1_000_000):
            sets = shingle_sets(texts[lo:hi], width)
            low = [s[:K].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + hi - lo), pa.int64()), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_hash(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))],
                names=["rid", "doc_id", "raw", "n", "set_hash", "sketch"])
            row += hi - lo


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets of the classes asked for; a row whose set is another one (two texts of one id and 64-bit hash) is passed over."""
    for batch in batches:
        texts, wanted, cid = _bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in slices(texts, 1_000_000):
            found = [(c, s.view(np.int64)) for c, w, s in zip(cid[lo:hi], wanted[lo:hi], shingle_sets(texts[lo:hi], width), strict=True) if _hash(s) == w]
            ends = np.cumsum([0, *(len(s) for _, s in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])))],
                names=["cid", "members"])


def _lists(classes: DataFrame) -> DataFrame:
    """key, cid, n, length: inverted lists of two or more, without the most common runs of each class.

    Sets of up to 8 values use runs of two: a pair at 0.8 with fewer than 7 values is only sure to share one of those.
    Full sets share at least 0.4 n - 2 runs of three at 0.8, whatever their order, so they can spare that many but one;
    sets whose partner may be cut by its sketch spare SPARE.
    """

    def runs(width: int, low: int, high: int | None) -> Column:
        there = F.col("n") >= low if high is None else F.col("n").between(low, high)
        values = F.slice("sketch", 1, F.when(there, F.greatest(F.size("sketch") - (width - 1), F.lit(0))).otherwise(F.lit(0)))
        return F.transform(values, lambda v, i: F.xxhash64(F.lit(width), v, *(F.get("sketch", i + j) for j in range(1, width))))

    keys = classes.select("cid", "n", F.explode(F.concat(runs(3, 7, None), runs(2, 4, 8))).alias("key"))
    counted = keys.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    shared = keys.join(counted, "key")
    spare = F.when(F.col("n") > 0.8 * K, F.lit(SPARE)).when(F.col("n") >= 9, F.greatest(F.floor(0.4 * F.col("n")) - 3, F.lit(0))).otherwise(F.lit(0))
    ranked = shared.groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("length", "key")), asc=False).alias("runs"))  # at most K runs a class
    return ranked.select("cid", "n", F.explode(F.slice("runs", F.least(spare.cast("int"), F.size("runs")) + 1, F.lit(K))).alias("r")).select("r.key", "cid", "n", "r.length")


def _close(a: Column, b: Column) -> Column:
    """Set sizes that allow a similarity of 0.8."""
    return (100 * F.least(a, b) >= 80 * F.greatest(a, b)) & (a > 0)


class _Verifier:
    """Links among candidate pairs: estimated on union sketches, decided on full sets."""

    def __init__(self, sketches: DataFrame, sets: DataFrame):
        self.sketches, self.sets = sketches, sets

    def links(self, pairs: DataFrame) -> DataFrame:
        a, b = (self.sketches.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        likely = both.where(shared >= LEAST_ESTIMATE * F.size(union)).select("a", "b", "na", "nb")
        x, y = (self.sets.select(F.col("cid").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
        full = likely.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ma", "mb")))
        return full.where(100 * F.col("common") >= 80 * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ordered pairs of two sides of the lists, sizes and components permitting."""
    met = left.alias("l").join(right.alias("r"), F.col("l.key") == F.col("r.key")).where((F.col("l.cid") != F.col("r.cid")) & _close(F.col("l.n"), F.col("r.n")))
    return met.select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b")).distinct()


def class_components(rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, comp of the classes that similarity 0.8 connects with others."""
    lists = stored(_lists(classes), "lists")
    listed = lists.select("cid").distinct()
    known = classes.join(listed, "cid", "left_semi")
    asked = known.select(F.col("doc_id").alias("id"), F.col("raw").alias("of"), "set_hash", "cid")
    sets = stored(rows.join(asked, rows["doc_id"].eqNullSafe(asked["id"]) & (rows["raw"] == asked["of"])).select("text", "set_hash", "cid").mapInArrow(lambda batches: _full_sets(batches, width), "cid long, members array<long>")
                  .groupBy("cid").agg(F.first("members").alias("members")), "sets")
    verify = _Verifier(known, sets)
    short, long = lists.where(F.col("length") <= SHORT), lists.where(F.col("length") > SHORT)
    leaders = long.groupBy("key").agg(F.min_by(F.struct("cid", "n"), F.xxhash64("cid")).alias("x")).select("key", "x.*")
    links = stored(verify.links(_pairs(short, short).unionByName(_pairs(leaders, long)).distinct()), "links")
    labels = connected(links)
    more = stored(_open_links(long, labels, sets), "links")
    if not more.isEmpty():
        labels = connected(links.unionByName(more))
    for x in (lists, sets, links):
        discard(x)
    return labels


def _open_links(long: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside long lists that the leaders left open.

    A list of one component is done. In any other every row outside the list's largest component asks that component
    and the rows that ask with it. Asking happens in blocks: the askers' sets and the others', of bounded size, meet
    in one task, which counts shared values without making a row per pair.
    """
    labelled = stored(long.select("key", "cid", "n").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "labelled")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("most"))
    asking = stored(labelled.join(tops, "key").where("comp != most").select("most", "cid", "n", "comp").distinct(), "asking")
    wanted = asking.select("most").distinct()
    members = labelled.select("cid", "n", "comp").distinct().join(wanted, F.col("comp") == F.col("most")).select("most", "cid", "n", "comp")
    asked = stored(members.unionByName(asking), "asked")

    def blocks(rows: DataFrame, per: int, name: str) -> DataFrame:
        return rows.groupBy("most").agg(F.ceil(F.sum("n") / per).cast("int").alias(name))

    shape = stored(blocks(asking, ASKING, "xs").join(blocks(asked, ASKED, "ys"), "most"), "shape")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return rows.join(shape, "most").select("most", "cid", "n", "comp", F.pmod(F.xxhash64("cid"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).join(
            sets, "cid").select(*(F.col(c).alias(c) for c in ("most", "xs", "ys", "cid", "n", "comp", "members")))

    left, right = dealt(asking, "xs", "ys"), dealt(asked, "ys", "xs")
    keys = ("most", "xs", "ys")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_ask, "a long, b long").distinct()


def _ask(asking: pa.Table, asked: pa.Table) -> pa.Table:
    """Links between two blocks of sets, across components."""
    a, b = [], []
    if asking.num_rows and asked.num_rows:
        lists = asked["members"].combine_chunks()
        values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        cid, n, comp = (asked[c].to_numpy() for c in ("cid", "n", "comp"))
        mine = asking["members"].combine_chunks()
        flat, at = mine.flatten().to_numpy(), mine.offsets.to_numpy() - mine.offsets[0].as_py()
        for i, (x, nx, cx) in enumerate(zip(*(asking[c].to_pylist() for c in ("cid", "n", "comp")), strict=True)):
            part = flat[at[i] : at[i + 1]]
            lo, hi = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
            k = hi - lo
            met = owner[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())]
            shared = np.bincount(met, minlength=len(cid))
            hit = np.flatnonzero((100 * shared >= 80 * (nx + n - shared)) & (comp != cx))
            a.extend(np.minimum(cid[hit], x).tolist())
            b.extend(np.maximum(cid[hit], x).tolist())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _components(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, set_hash, n_shingles, component_id, kept, stays of every input row."""
    rows = addressed(docs, id_col, text_col)
    sketches = stored(rows.mapInArrow(lambda batches: _sketches(batches, width), SKETCH), "sketches")
    nowhere = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    full = sketches.where("n > 0")
    classes = stored(full.groupBy("set_hash").agg(
        F.min(F.struct("rid", "doc_id", "raw")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.struct(nowhere.alias("order"), "rid", "doc_id")).alias("low"),
    ).select("set_hash", F.col("one.rid").alias("cid"), F.col("one.doc_id").alias("doc_id"), F.col("one.raw").alias("raw"), "n", "sketch", "low"), "classes")
    labels = class_components(rows, classes, width)
    whole = classes.select("set_hash", "cid", "low").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    tops = whole.groupBy("comp").agg(F.min("low").alias("top"))
    of_class = stored(whole.join(tops, "comp").select("set_hash", F.col("top.doc_id").alias("component_id"), F.col("top.rid").alias("kept_rid")), "of_class")
    out = full.select("rid", "doc_id", "n", "set_hash").join(of_class, "set_hash").select(
        "doc_id", "set_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("rid") == F.col("kept_rid")).alias("stays"))
    empty = sketches.where("n = 0").select("doc_id", "set_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return out.unionByName(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, stays.

    Sets are the distinct runs of ``width`` words after lower-casing A-Z (a shorter text is its own set), by 64-bit hash. Texts without
    words, null or empty, have an empty set, are linked with nothing and kept. ``component_id`` is the least id
    reachable (null ids count as largest; null only where a component has no other). ``kept`` holds for the rows that bear it, so for
    all rows of a repeated id; ``stays`` for exactly one row of each component. An empty table gives an empty result; other columns are ignored.
    """
    return _components(docs, id_col, text_col, width).drop("set_hash")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns. Of rows with one id and equal sets one stays."""
    flags = _components(docs, id_col, text_col, width).select("doc_id", F.col("set_hash").alias("digest"), F.col("stays").alias("kept"))
    return keep_marked(docs, flags, id_col, text_col, lambda texts: [_hash(s) for s in shingle_sets([t.encode().lower() for t in texts], width)])
