"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The class softmax sums hashed rows for the last word, a skip
feature (the word before it), the pair of both, and the ending groups of the last four words. Frequent words sit in classes of
WIDTH with a softmax of their own (its rows hash class and last word); the other classes hold rarer words by ending group
and spread their mass by training counts, with one unknown event each. Ending groups come from which endings follow which.

Every partition runs gradient updates over its training texts from the common start; the results are averaged by tokens.
Words are 64-bit hashes; texts are scored whole in numpy batches, and counts of rare words come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, slices, stored
from ._hashing import joined, mix, word_hashes, word_spans

#: Words whose counts every task holds, words with a softmax of their own, class width, ending groups and buckets.
HEAD, FREQUENT, WIDTH, GROUPS, ENDINGS, CONTEXTS = 65_536, 1024, 64, 8, 512, 64
#: Hashed rows of the class softmax: last word, skip, pair, groups; and of the inner softmax.
ROWS = (1 << 13, 1 << 13, 1 << 14, 1 << 13)
INNER = 1 << 13
BATCH, RATE = 4096, 0.15
END = np.uint64(0x5BD1E9955BD1E995)
BLOCK = 1_000_000
COUNTS = "pair boolean, word long, ending int, n long"


def _start_and_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token behind every text, their ending buckets, and each text's first token (the total last)."""
    data, at = joined(texts)
    if not len(data):
        n = len(texts)
        return np.full(n, END), np.zeros(n, np.int64), np.arange(n + 1)
    start, end, before = word_spans(data, at)
    words = word_hashes(data, start, end)
    last = end - 1
    mark = (data[last] < 128) & ~((data[last] >= 97) & (data[last] <= 122)) & (last > start)
    last = last - mark
    ending = (data[last].astype(np.int64) * 31 + np.where(last > start, data[np.maximum(last - 1, 0)], 0)) % (ENDINGS - 1) + 1
    place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(before))
    firsts = before + np.arange(len(texts) + 1)
    all_words, all_endings = np.full(firsts[-1], END), np.zeros(firsts[-1], np.int64)
    all_words[place], all_endings[place] = words, ending
    return all_words, all_endings, firsts


def _blocks(texts: list) -> Iterator[tuple[int, int, list[bytes]]]:
    done = [(t or "").encode().lower() for t in texts]
    for lo, hi in slices(done, BLOCK):
        yield lo, hi, done[lo:hi]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of one partition, and of an ending after the ending before it."""
    def rows(words: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), bool)), pa.array(words.view(np.int64)), pa.array(endings.astype(np.int32)), pa.array(counts)],
                                          names=["pair", "word", "ending", "n"])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, e, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        u, first, inverse = np.unique(w, return_index=True, return_inverse=True)
        return u, e[first], np.bincount(inverse, weights=n).astype(np.int64)

    seen, held = [], 0
    pairs = np.zeros(ENDINGS * CONTEXTS, np.int64)
    for batch in batches:
        for _, _, texts in _blocks(batch.column(0).to_pylist()):
            words, endings, _ = _start_and_ends(texts)
            u, first, n = np.unique(words, return_index=True, return_counts=True)
            seen.append((u, endings[first], n))
            pairs += np.bincount(endings[1:] * CONTEXTS + endings[:-1] % CONTEXTS, minlength=len(pairs))
            held += len(u)
            if held > 2_000_000:
                seen = [merged(seen)]
                held = len(seen[0][0])
                if held > 1_000_000:
                    yield rows(*seen[0])
                    seen, held = [], 0
    if seen:
        yield rows(*merged(seen))
    there = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(there), bool)), pa.array(there), pa.array(np.zeros(len(there), np.int32)), pa.array(pairs[there])],
                                     names=["pair", "word", "ending", "n"])


def ending_groups(pairs: np.ndarray) -> np.ndarray:
    """Group of each ending by k-means over what it follows, weighted by frequency."""
    table = pairs.reshape(ENDINGS, CONTEXTS).astype(float)
    size = table.sum(1)
    used = np.flatnonzero(size)
    group = np.zeros(ENDINGS, np.int64)
    if len(used) <= GROUPS:
        group[used] = np.arange(len(used))
        return group
    x = np.sqrt(table[used] / size[used, None])
    order = np.argsort(-size[used], kind="stable")
    centers = [x[order[0]]]
    while len(centers) < GROUPS:  # the next start is far from all before and frequent
        far = np.min([((x - c) ** 2).sum(1) for c in centers], 0) * np.sqrt(size[used])
        centers.append(x[int(far.argmax())])
    c = np.array(centers)
    for _ in range(30):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        for g in range(GROUPS):
            if (near == g).any():
                c[g] = np.average(x[near == g], axis=0, weights=size[used][near == g])
    group[used] = near
    return group


class Model:
    """Vocabulary head, classes and weights. ``top`` and ``inner`` are the two tables of hashed rows."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, endings: np.ndarray, group: np.ndarray, tail: dict[int, tuple[int, int]], total: int, types: int):
        by_rank = np.lexsort((words, -counts))
        words, counts, endings = words[by_rank], counts[by_rank], endings[by_rank]
        self.total, self.types, self.group = total, types, group
        n_frequent = min(FREQUENT, len(words))
        groups = group[endings]
        cls, slot, n_cls = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for g in range(GROUPS):
            mine = np.flatnonzero(groups[:n_frequent] == g)
            cls[mine], slot[mine] = n_cls + np.arange(len(mine)) // WIDTH, np.arange(len(mine)) % WIDTH
            n_cls += -(-len(mine) // WIDTH)
        cls[n_frequent:] = n_cls + groups[n_frequent:]
        self.first_mid, self.first_tail, self.n_classes = n_cls, n_cls + GROUPS, n_cls + 2 * GROUPS
        mass = np.bincount(cls, weights=counts, minlength=self.n_classes)
        tails = np.array([tail.get(g, (0, 0)) for g in range(GROUPS)], float).reshape(GROUPS, 2)
        mass[self.first_tail :] = tails[:, 0]
        self.tail_log = np.log10(tails.sum(1) + 1)  # counts and types of the group and one unknown
        self.bias = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
        self.inner_bias = np.full((max(1, n_cls), WIDTH), -30, np.float32)
        self.inner_bias[cls[:n_frequent], slot[:n_frequent]] = np.log(counts[:n_frequent] / mass[cls[:n_frequent]])
        self.within = np.log10(counts / np.maximum(mass[cls], 1))  # of the middle classes
        self.known = np.log10(counts + 1.0)
        order = np.argsort(words)
        self.sorted, self.rank, self.cls, self.slot, self.n_frequent = words[order], order, cls, slot, n_frequent
        self.top = np.zeros((sum(ROWS), self.n_classes), np.float32)
        self.inner = np.zeros((INNER, WIDTH), np.float32)

    def tokens(self, words: np.ndarray, endings: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rank (-1 outside the head), class, four rows of the class softmax and one of the inner softmax, of every token."""
        at = np.minimum(np.searchsorted(self.sorted, words), max(0, len(self.sorted) - 1))
        hit = self.sorted[at] == words if len(self.sorted) else np.zeros(len(words), bool)
        rank = np.where(hit, self.rank[at], -1) if len(self.sorted) else np.full(len(words), -1)
        group = self.group[endings]
        cls = np.where(hit, self.cls[rank], self.first_tail + group) if len(self.sorted) else self.first_tail + group
        word = np.where(hit, rank, HEAD + group) + 1
        begins = np.zeros(len(words), bool)
        begins[firsts[:-1]] = True
        since = np.arange(len(words)) - np.repeat(firsts[:-1], np.diff(firsts))

        def back(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(x), np.uint64)
            out[k:] = x[: len(x) - k] if k < len(x) else x[:0]
            out[since < k] = 0
            return out

        one, two = back(word, 1), back(word, 2)
        history = sum(back(group + 1, k + 1) * np.uint64((GROUPS + 1) ** k) for k in range(4))
        salted = (one * np.uint64(4) + np.uint64(1), two * np.uint64(4) + np.uint64(2), (one * np.uint64(1 << 20) + two) * np.uint64(4) + np.uint64(3), history * np.uint64(4))
        rows, base = [], 0
        for code, size in zip(salted, ROWS, strict=True):
            rows.append((base + (mix(code) & np.uint64(size - 1)).astype(np.int64)).astype(np.uint16))
            base += size
        inner = (mix(one * np.uint64(1 << 10) + cls.astype(np.uint64) + np.uint64(5)) & np.uint64(INNER - 1)).astype(np.uint16)
        return rank, cls, rows, inner

    def _class_scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Unnormalised logarithms of the classes, the largest of each token 0."""
        x = self.top.take(rows[0], 0)
        for r in rows[1:]:
            x += self.top.take(r, 0)
        x += self.bias
        x -= x.max(1, keepdims=True)
        return x

    def _inner_scores(self, cls: np.ndarray, inner: np.ndarray) -> np.ndarray:
        x = self.inner_bias.take(cls, 0)
        x += self.inner.take(inner, 0)
        x -= x.max(1, keepdims=True)
        return x

    def class_log(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the class probabilities."""
        x = self._class_scores(rows)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def inner_log(self, cls: np.ndarray, inner: np.ndarray) -> np.ndarray:
        x = self._inner_scores(cls, inner)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def train(self, words: np.ndarray, endings: np.ndarray, firsts: np.ndarray, top_sum: np.ndarray, inner_sum: np.ndarray) -> None:
        """Adagrad steps over the tokens of some texts, one per BATCH."""
        rank, cls, rows, inner = self.tokens(words, endings, firsts)
        for lo in range(0, len(words), BATCH):
            part = slice(lo, lo + BATCH)
            mine = [r[part] for r in rows]
            g = _softmax(self._class_scores(mine))
            g[np.arange(len(g)), cls[part]] -= 1
            for r in mine:
                _step(self.top, top_sum, r, g)
            often = np.flatnonzero((rank[part] >= 0) & (rank[part] < self.n_frequent)) + lo
            if len(often):
                g = _softmax(self._inner_scores(cls[often], inner[often]))
                g[np.arange(len(g)), self.slot[rank[often]]] -= 1
                _step(self.inner, inner_sum, inner[often], g)

    def score(self, words: np.ndarray, endings: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: log10 probability, sum of log10(c + 1) and number of tokens of the head; and which tokens lie outside it.
        Of those the class and its total are in the score, their counts are not."""
        rank, cls, rows, inner = self.tokens(words, endings, firsts)
        out = np.zeros(len(words))
        for lo in range(0, len(words), BATCH):
            part = slice(lo, lo + BATCH)
            logs = self.class_log([r[part] for r in rows])
            out[part] = logs[np.arange(len(logs)), cls[part]] / np.log(10)
            often = np.flatnonzero((rank[part] >= 0) & (rank[part] < self.n_frequent)) + lo
            if len(often):
                logs = self.inner_log(cls[often], inner[often])
                out[often] += logs[np.arange(len(often)), self.slot[rank[often]]] / np.log(10)
        middle = rank >= self.n_frequent
        if len(self.within):
            out += np.where(middle, self.within[rank], 0)
        tail = rank < 0
        out[tail] -= self.tail_log[cls[tail] - self.first_tail]
        known = np.where(tail, 0, self.known[rank]) if len(self.known) else np.zeros(len(words))
        return np.add.reduceat(out, firsts[:-1]), np.add.reduceat(known, firsts[:-1]), np.add.reduceat((~tail).astype(np.int64), firsts[:-1]), tail


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Add each row's gradients up and move the rows once."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ np.uint16(1)))
    total = np.add.reduceat(g.take(order, 0), starts, axis=0)
    at = ordered[starts]
    size = squares.take(at, 0)
    size += total * total
    squares[at] = size
    size += 1e-6
    np.sqrt(size, out=size)
    total *= RATE
    total /= size
    moved = table.take(at, 0)
    moved -= total
    table[at] = moved


def _chunks(table: np.ndarray) -> list[np.ndarray]:
    return [table[i : i + 1024] for i in range(0, len(table), 1024)]


def _updates(start) -> object:
    """One partition's tables after its own updates, in pieces, with its token count as weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = start.value, 0
        model.top, model.inner = np.zeros_like(model.top), np.zeros_like(model.inner)
        squares = np.zeros_like(model.top), np.zeros_like(model.inner)
        for batch in batches:
            for _, _, texts in _blocks(batch.column(0).to_pylist()):
                words, endings, firsts = _start_and_ends(texts)
                model.train(words, endings, firsts, *squares)
                tokens += len(words)
        if tokens:
            pieces = [*_chunks(model.top), *_chunks(model.inner)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([tokens] * len(pieces), pa.int64()),
                                              pa.array([p.astype(np.float16).tobytes() for p in pieces], pa.binary())], names=["piece", "tokens", "weights"])

    return run


def _average(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted means of the pieces met; sums add up over tasks."""
    sums: dict[int, list] = {}
    for batch in rows:
        for piece, tokens, weights in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            value = np.frombuffer(weights, np.float16).astype(np.float64) * tokens
            if piece in sums:
                sums[piece][0] += tokens
                sums[piece][1] += value
            else:
                sums[piece] = [tokens, value]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()),
                                      pa.array([(v / t).astype(np.float32).tobytes() for t, v in sums.values()], pa.binary())], names=["piece", "tokens", "weights"])


def _level() -> Column:
    """Counts in a few thousand ascending steps, exact below 1024."""
    n = F.col("n")
    return F.when(n < 1024, n).otherwise(F.floor(64 * (F.log2(n) - 10)) + 1024).cast("long")


def _head_level(vocabulary: DataFrame) -> int:
    """The least step from which on there are HEAD words at most."""
    steps = {r["step"]: r["k"] for r in vocabulary.groupBy(_level().alias("step")).agg(F.count("*").alias("k")).collect()}
    least, total = 1 << 62, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > HEAD:
            break
        least = step
    return least


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of a table of texts (one column, all rows), and the counts of its words (word, ending, n)."""
    counted = stored(texts.mapInArrow(_count, COUNTS).groupBy("pair", "word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "words", "pair")
    vocabulary = counted.where(~F.col("pair")).select("word", "ending", "n")
    pairs = np.zeros(ENDINGS * CONTEXTS, np.int64)
    for r in counted.where("pair").select("word", "n").collect():  # ENDINGS * CONTEXTS rows at most
        pairs[r["word"]] = r["n"]
    group = ending_groups(pairs)
    head = vocabulary.where(_level() >= _head_level(vocabulary)).collect()  # HEAD rows at most
    words = np.array([r["word"] for r in head], np.int64).view(np.uint64)
    counts, endings = np.array([r["n"] for r in head], np.int64), np.array([r["ending"] for r in head], np.int64)
    of_group = F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.col("ending") + 1)
    every = {r["g"]: (r["n"], r["k"]) for r in vocabulary.groupBy(of_group.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    mine = group[endings]
    tail = {g: (n - int(counts[mine == g].sum()), k - int((mine == g).sum())) for g, (n, k) in every.items()}
    model = Model(words, counts, endings, group, tail, sum(n for n, _ in every.values()), sum(k for _, k in every.values()))
    spark = texts.sparkSession
    start = spark.sparkContext.broadcast(model)
    updated = texts.mapInArrow(_updates(start), "piece int, tokens long, weights binary")
    pieces = updated.repartition("piece").mapInArrow(_average, "piece int, tokens long, weights binary").collect()  # the size of the two tables
    n_top = len(_chunks(model.top))
    for p in pieces:
        table, at = (model.top, p["piece"]) if p["piece"] < n_top else (model.inner, p["piece"] - n_top)
        block = table[1024 * at : 1024 * (at + 1)]
        block[:] = np.frombuffer(p["weights"], np.float32).reshape(block.shape)
    return model, vocabulary


def _score(model) -> object:
    """A row for every text, and one for each of its different words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = model.value, TaskContext.get().partitionId() << 33
        names = ["rid", "doc_id", "held_out", "word", "n", "tokens", "known", "base", "score"]
        for batch in batches:
            for lo, hi, texts in _blocks(batch.column(2).to_pylist()):
                words, endings, firsts = _start_and_ends(texts)
                score, base, known, tail = m.score(words, endings, firsts)
                k = hi - lo
                rid = np.arange(row, row + k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), batch.column(0).slice(lo, k), batch.column(1).slice(lo, k), pa.array(rid), pa.nulls(k, pa.int64()), pa.array(np.diff(firsts)),
                     pa.array(known), pa.array(base), pa.array(score)], names=names)
                row += k
                of = np.repeat(rid, np.diff(firsts))[tail]
                outside = words[tail]
                order = np.lexsort((outside, of))
                of, outside = of[order], outside[order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (outside[1:] != outside[:-1]))) if len(of) else np.zeros(0, np.int64)
                j = len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[new]), pa.nulls(j, pa.int64()), pa.nulls(j, pa.bool_()), pa.array(outside[new].view(np.int64)), pa.array(np.diff(np.append(new, len(of)))),
                     *[pa.nulls(j, pa.int64())] * 2, *[pa.nulls(j, pa.float64())] * 2], names=names)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows whose crc32(id as text) mod 7 is not 2 (rows with a null id are held out). Tokens are the words after
    lower-casing A-Z and one end; a null text counts as empty and has the end alone. Repeated rows count as often as they
    stand there. An empty table gives an empty result, one without training rows scores of a model that knows no word.
    """
    held = F.coalesce(crc_mod(docs[id_col].cast("long"), 7) == 2, F.lit(True))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held.alias("held_out"), docs[text_col].cast("string").alias("text"))
    model, vocabulary = fit(rows.where(~F.col("held_out")).select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = rows.mapInArrow(_score(shared), "rid long, doc_id long, held_out boolean, word long, n long, tokens long, known long, base double, score double")
    # a text's own row carries its number as word and no n: it finds no count and needs none
    counts = vocabulary.select(F.col("word").alias("w"), F.col("n").alias("c"))
    found = parts.join(counts, F.col("word") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    gain = F.col("n") * F.log10(c + F.lit(1.0))
    summed = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(c > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(gain), F.lit(0.0))).alias("base"), (F.sum("score") + F.coalesce(F.sum(gain), F.lit(0.0))).alias("score"))
    unit = float(np.log10(model.total + model.types + 1))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                         (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")
