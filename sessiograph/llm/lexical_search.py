"""Ranked lexical search over an inverted index that Spark builds in blocks of documents.

``build_index`` writes the postings of every term of every document, block by block. ``search`` joins the terms of the
queries to it, and each block answers each group of queries by itself: the postings of short lists are summed into
accumulators (term at a time), which then stand beside the long lists as one more list with a bound per range of
documents; all of them advance together (document at a time), and ranges and documents whose bounds stay below the
tenth best score are skipped without being scored. The ten best of all blocks are the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, narrow, parts_for, stored

#: Text bytes that a block of documents gathers before it is written, and items that are answered together.
BLOCK_BYTES, GROUP_ITEMS = 12_000_000, 512
#: Lists of at most SHORT postings are summed ahead; longer ones carry the highest count of every RANGE documents.
SHORT, RANGE = 128, 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = ("block long, term string, n_docs long, docs array<int>, counts array<int>, ranges array<int>, starts array<int>, tops array<int>, "
         "ids array<bigint>, sizes array<bigint>, n_terms long")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of all terms: one row per (block, term), and one per block (term null) with its documents' ids and sizes.

    Documents without a term (null, empty, only separators) are not in it. A block holds about BLOCK_BYTES of text of one
    input split, or one longer text; its documents are numbered by ascending size, so the first of a range is the smallest.
    """
    return stored(narrow(docs, id_col, text_col).mapInArrow(_index, INDEX), "postings")


def _index(batches):
    from pyspark import TaskContext

    part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            body = text.encode()
            ids.append(doc)
            texts.append(body)
            size += len(body)
            if size >= BLOCK_BYTES:
                yield from _block((part << 32) + made, ids, texts)
                made, ids, texts, size = made + 1, [], [], 0
    if texts:
        yield from _block((part << 32) + made, ids, texts)


def _block(block: int, ids: list, texts: list[bytes]):
    import numpy as np
    import pyarrow as pa

    from ._terms import coded

    codes, terms, before = coded(texts)
    sizes = np.diff(before)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return
    number = np.zeros(len(sizes), np.int64)
    number[order] = np.arange(len(order))
    wide = len(order)
    pairs, counts = np.unique(codes * wide + np.repeat(number, sizes), return_counts=True)
    of, docs = pairs // wide, (pairs % wide).astype(np.int32)
    lists = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms)))])
    far = np.flatnonzero(np.diff(lists)[of] > SHORT)
    spot = of[far] * (wide // RANGE + 1) + docs[far] // RANGE
    heads = np.flatnonzero(np.diff(spot, prepend=-1))
    tops = np.maximum.reduceat(counts[far], heads) if len(heads) else np.zeros(0, np.int64)
    owner = of[far[heads]] if len(heads) else np.zeros(0, np.int64)
    skips = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(terms)))])
    first = far[heads] if len(heads) else np.zeros(0, np.int64)

    def as_list(offsets, values):
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))

    n = len(terms)
    empty = pa.nulls(n, pa.list_(pa.int64()))
    table = pa.Table.from_arrays(
        [pa.array(np.full(n, block)), terms.cast(pa.large_string()).cast(pa.string()), pa.array(np.diff(lists)), as_list(lists, docs), as_list(lists, counts),
         as_list(skips, docs[first] // RANGE), as_list(skips, first - lists[owner]), as_list(skips, tops), empty, empty, pa.nulls(n, pa.int64())],
        names=[f.split()[0] for f in INDEX.split(", ")])
    whole = pa.Table.from_pylist([{"block": block, "n_docs": wide, "ids": [ids[i] for i in order], "sizes": sizes[order].tolist(), "n_terms": int(sizes.sum())}], table.schema)
    for part in (whole, table):
        yield from part.combine_chunks().to_batches(max_chunksize=20_000)


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """qid (one per row of ``items``), item_id, term and how often it stands there."""
    rows = stored(items.select(F.monotonically_increasing_id().alias("qid"), items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")), "items")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("qid", "item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("qid", "item_id", "term").agg(F.count("*").alias("times"))


def search(docs: DataFrame, items: DataFrame, top: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` best documents of every row of ``items``.

    Null and empty texts have no terms: such documents are never found and such items give no rows. Repeated rows are
    documents (items) of their own; equal scores go by ascending doc_id, null last. Very long texts are blocks of their own.
    Empty tables give an empty result. Other columns are ignored.
    """
    index = build_index(docs, id_col, text_col)
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = stored(_asked(items, item_col, item_text), "asked")
    groups = parts_for(asked.select("qid").distinct().count(), GROUP_ITEMS)
    # the lists of a term's askers are bounded by the items of a group
    asks = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("grp"), "term").agg(F.collect_list(F.struct("qid", "item_id", "times")).alias("asks"))
    held = index.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    wanted = asks.join(held.select("term", weight.alias("weight")), "term")
    lists = index.join(wanted, "term").select("block", "grp", "term", "weight", "asks", "docs", "counts", "ranges", "starts", "tops", "ids", "sizes")
    whole = index.where("term is null").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), "term", F.lit(None).cast("long").alias("weight"),
        F.lit(None).cast(asks.schema["asks"].dataType).alias("asks"), "docs", "counts", "ranges", "starts", "tops", "ids", "sizes")

    def run(table):
        return _answer(table, n_docs, n_terms, top)

    found = lists.unionByName(whole).groupBy("block", "grp").applyInArrow(run, "qid long, item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    out = stored(found.withColumn("rank", place.cast("int")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(index)
    discard(asked)
    return out


def _answer(table, n_docs: int, n_terms: int, top: int):
    """The ``top`` best documents of one block for every item of a group."""
    import numpy as np
    import pyarrow as pa

    rows = table.to_batches()
    ids = sizes = None
    lists, items = [], {}
    for batch in rows:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            if not col["term"][i].is_valid:
                ids, sizes = col["ids"][i].values, col["sizes"][i].values.to_numpy()
                continue
            lists.append((col["weight"][i].as_py(), *(col[c][i].values.to_numpy().astype(np.int64) for c in ("docs", "counts", "ranges", "starts", "tops"))))
            for ask in col["asks"][i].as_py():
                items.setdefault((ask["qid"], ask["item_id"]), []).append((len(lists) - 1, ask["times"]))
    damp = 8 * (25 + 75 * sizes * n_docs // max(n_terms, 1)).astype(np.int64)
    postings = [_List(*x, damp) for x in lists]
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy()
    out = ([], [], [], [])
    for (qid, item), terms in items.items():
        docs, scores = _best([(postings[t], times) for t, times in terms], numbers, missing, top)
        for target, values in zip(out, ([qid] * len(docs), [item] * len(docs), [None if missing[d] else int(numbers[d]) for d in docs], scores.tolist())):
            target.extend(values)
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["qid", "item_id", "doc_id", "score"])


class _List:
    """One term's postings in a block; scores are made range by range when first asked for."""

    def __init__(self, weight, docs, counts, ranges, starts, tops, damp):
        import numpy as np

        self.weight, self.docs, self.counts, self.damp, self.made = weight, docs, counts, damp, {}
        self.long = len(ranges) > 0
        if self.long:
            wide = len(damp) // RANGE + 1
            self.first, self.last, self.bound = (np.zeros(wide, np.int64) for _ in range(3))
            self.first[ranges], self.last[ranges] = starts, np.append(starts[1:], len(docs))
            self.bound[ranges] = self._score(tops, docs[starts])
        else:
            self.scores = self._score(counts, docs)

    def _score(self, counts, docs):
        return self.weight * (1_000_000_000 * counts // (1000 * counts + self.damp[docs]))

    def part(self, r: int):
        """Documents and scores of one range."""
        if r not in self.made:
            docs = self.docs[self.first[r] : self.last[r]]
            self.made[r] = docs, self._score(self.counts[self.first[r] : self.last[r]], docs)
        return self.made[r]


def _best(terms, ids, missing, top: int):
    """Numbers and scores of the best documents, best first."""
    import numpy as np

    short = [(x, times) for x, times in terms if not x.long]
    far = [(x, times) for x, times in terms if x.long]
    # term at a time: short lists become one list of sums
    at, where = np.unique(np.concatenate([x.docs for x, _ in short]), return_inverse=True) if short else (np.zeros(0, np.int64),) * 2
    sums = np.zeros(len(at), np.int64)
    if short:
        np.add.at(sums, where, np.concatenate([times * x.scores for x, times in short]))
    wide = len(ids) // RANGE + 1
    cuts = np.searchsorted(at, np.arange(wide + 1) * RANGE)
    bound = np.zeros(wide, np.int64)
    np.maximum.at(bound, at // RANGE, sums)
    for x, times in far:
        bound += times * x.bound
    # a partial sum is a lower bound of its document's score
    least = max(1, int(np.partition(sums, -top)[-top])) if len(sums) >= top else 1
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # document at a time: all lists advance over the ranges whose bound can still reach the best
    for r in np.flatnonzero(bound >= least).tolist():
        if bound[r] < least:
            continue
        base, lo, hi = r * RANGE, cuts[r], cuts[r + 1]
        standing = np.zeros(RANGE, np.int64)
        standing[at[lo:hi] - base] = sums[lo:hi]
        here = [(x, times) for x, times in far if x.bound[r]]
        for x, times in here:
            standing[x.docs[x.first[r] : x.last[r]] - base] += times * x.bound[r]
        pivots = standing >= least
        if not pivots.any():
            continue
        exact = np.zeros(RANGE, np.int64)
        exact[at[lo:hi] - base] = sums[lo:hi]
        for x, times in here:
            mine, values = x.part(r)
            exact[mine - base] += times * values
        new = np.flatnonzero(pivots & (exact >= least))
        docs, scores = np.concatenate([docs, new + base]), np.concatenate([scores, exact[new]])
        best = np.lexsort((ids[docs], missing[docs], -scores))[:top]
        docs, scores = docs[best], scores[best]
        if len(docs) == top:
            least = max(least, int(scores[-1]))
    return docs, scores
