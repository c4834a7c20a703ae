"""Spelling variants: words one edit apart, found through pivotal grams.

Bigrams are ordered by rarity over the vocabulary. A word's gram prefix is its three rarest bigrams (with all places of the
third); two disjoint ones of least frequency, its pivots, are chosen by dynamic programming. One edit spoils at most one
pivot, so of two words one edit apart, the one whose prefix ends rarer has a pivot that stands in the other's prefix. The
edit lies on one side of it: on the other side the letters agree to the word's end, which limits the position, and on the
edit's own side half of the letters agree. Pivots and prefixes meet under that key; Spark's bounded edit distance verifies.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, narrow, stored

#: Shortest word, fewest occurrences, how much more frequent a word's form is, and one in how many occurrences loses a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILED = 7, 2, 10, 31
#: Grams a prefix holds at least and pivots chosen from it, for one edit of bigrams.
PREFIX, PIVOTS = 3, 2
#: Distinct words that a task counts before it passes them on.
HELD = 300_000


def _letters() -> bytes:
    """Latin-1 bytes: A-Z lower-cased, a-z and U+00C0 to U+00FF kept, all others a space."""
    from ._terms import byte_table

    return byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoiled: int = SPOILED) -> DataFrame:
    """word and n: runs of letters of at least LEAST_LENGTH code points, A-Z lower-cased; an occurrence whose crc32 of
    ``<doc_id>:<run>`` ``spoiled`` divides is counted without one letter. A null id is the empty text there."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        table, held = _letters(), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                words = Counter(w for w in text.encode("latin-1", "replace").translate(table).split(b" ") if len(w) >= LEAST_LENGTH)
                for w, n in words.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % spoiled == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < LEAST_LENGTH:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return narrow(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_pivots(grams: list[tuple[int, int, int]], count: int = PIVOTS) -> list[int]:
    """Places of ``count`` disjoint bigrams of least total frequency, by dynamic programming over (place, frequency, rank) in order of place."""
    best: list[list[tuple]] = [[(0, (), ())] * (len(grams) + 1)] + [[None] * (len(grams) + 1) for _ in range(count)]
    for taken in range(1, count + 1):
        free = 0  # grams that end before the current one begins
        for i, (place, cost, rank) in enumerate(grams):
            while grams[free][0] + 2 <= place:
                free += 1
            skip, before = best[taken][i], best[taken - 1][free]
            take = before and (before[0] + cost, (*before[1], rank), (*before[2], place))
            best[taken][i + 1] = min((x for x in (skip, take) if x), default=None)
    return list(best[count][-1][2])


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """Rank at which the gram prefix ends, its places in order, and the pivots among them. ``ranks``: gram -> (rank, frequency)."""
    grams = [(i, *reversed(ranks[word[i : i + 2]])) for i in range(len(word) - 1)]
    last = sorted(r for _, _, r in grams)[PREFIX - 1]
    prefix = [g for g in grams if g[2] <= last]
    return last, [g[0] for g in prefix], choose_pivots(prefix)


def side_keys(word: str, place: int):
    """Keys under which a bigram of ``word`` meets the same bigram of a word one edit away.

    The edit is right of the bigram (all letters up to it agree) or left of it. Of the other side, at least the first or the
    last half of the letters agree; the half is taken of the shorter word, so an even length also gives the next lower half.
    """
    head, tail = word[: place + 2], word[place + 2 :]
    for h in {len(tail) // 2, max(len(tail) - 1, 0) // 2}:
        yield f"{place}>{head}{tail[:h]}|{h}"
        if h:
            yield f"{place}>{head}|{tail[-h:]}"
    head, tail = word[:place], word[place:]
    for h in {len(head) // 2, max(len(head) - 1, 0) // 2}:
        yield f"{len(tail)}<{h}|{head[len(head) - h:]}{tail}"
        if h:
            yield f"{len(tail)}<{head[:h]}|{tail}"


def near_words(words: DataFrame) -> DataFrame:
    """Pairs a < b of rows of ``words`` (word, n; distinct words of LEAST_LENGTH code points) one edit apart, with n_a and n_b, each once."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("gram"))
    # at most 90 letters: no more than 8100 bigrams
    counts = sorted((r.n, r.gram) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect())
    ranks = {g: (i, n) for i, (n, g) in enumerate(counts)}

    def posted(batches):
        import pyarrow as pa

        for batch in batches:
            keys, places, last, pivot = [], [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                end, prefix, chosen = prefix_and_pivots(word, ranks)
                for place in prefix:
                    before = len(keys)
                    keys.extend(side_keys(word, place))
                    new = len(keys) - before
                    places.extend([row] * new)
                    last.extend([end] * new)
                    pivot.extend([place in chosen] * new)
            at = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(last, pa.int16()), pa.array(pivot)],
                                             names=["key", "word", "n", "last", "pivot"])

    posts = words.select("word", "n").mapInArrow(posted, "key string, word string, n long, last short, pivot boolean")
    posts = stored(posts.select(F.xxhash64("key").alias("key"), "word", "n", "last", "pivot"), "grams")
    p, q = posts.where("pivot").drop("pivot").alias("p"), posts.drop("pivot").alias("q")
    near = ((F.col("p.key") == F.col("q.key")) & (F.col("p.last") <= F.col("q.last")) & (F.abs(F.length("p.word") - F.length("q.word")) <= 1)
            & (F.col("p.word") != F.col("q.word")) & (F.levenshtein("p.word", "q.word", 1) == 1))
    low = F.col("p.word") < F.col("q.word")
    pairs = p.join(q, near).select(F.least("p.word", "q.word").alias("a"), F.greatest("p.word", "q.word").alias("b"),
                                   F.when(low, F.col("p.n")).otherwise(F.col("q.n")).alias("n_a"), F.when(low, F.col("q.n")).otherwise(F.col("p.n")).alias("n_b"))
    out = stored(pairs.distinct(), "near")
    discard(posts)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoiled: int = SPOILED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts that occurs LEAST_COUNT times or more.

    ``form`` is the most frequent word one edit away (equal counts: first in code-point order) if it is RATIO times as
    frequent, else null; ``root`` is the end of the chain of forms. Null and empty texts have no words; repeated rows count
    each time; texts of any length are read whole; an empty table gives no rows. Other columns are ignored.
    """
    words = stored(word_counts(docs, id_col, text_col, spoiled).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = near_words(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b"), F.col("a"), F.col("n_a")).toDF("word", "other", "m"))
    found = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    big = -F.col("best.m") >= RATIO * F.col("n")
    rows = stored(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(big, F.col("best.other")).alias("form"),
                                                           F.when(big, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("up")))
    out = stored(rows.join(roots, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n"), "spellings")
    for table in (words, pairs, rows, roots):
        discard(table)
    return out


def _roots(steps: DataFrame) -> DataFrame:
    """word and the end of its chain (``up``): chains halve in every round, and a form is RATIO times as frequent as its word, so they are short."""
    steps = stored(steps, "steps")
    while True:
        above = steps.select(F.col("word").alias("up"), F.col("up").alias("higher"))
        after = stored(steps.join(above, "up", "left").select("word", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "steps")
        discard(steps)
        moved = not after.where("moved").isEmpty()
        steps = after.drop("moved")
        steps._stored_at = after._stored_at
        if not moved:
            return steps
