"""Word sequences with alternatives and noise words between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

Phrase = list[list[str]]


def _chain(ahead: Column, phrase: Phrase, max_gap: int) -> Column:
    """Offset of the last word of a greedy match that starts at offset 0 of ``ahead``, or null."""
    at: Column = F.when(F.get(ahead, F.lit(0)).isin(*phrase[0]), F.lit(0))
    for tokens in phrase[1:]:
        offsets = F.sequence(at + 1, at + 1 + max_gap)
        at = F.array_min(F.filter(offsets, lambda j: F.get(ahead, j).isin(*tokens)))
    return at


def match(words: DataFrame, subject: str, index: str, text: str, phrases: dict[str, Phrase], max_gap: int = 3) -> DataFrame:
    """First place of each phrase in each subject: phrase, first and last word number.

    Each word of a phrase is the first match within ``max_gap`` noise words of the one before, so a match
    spans at most (n - 1)(max_gap + 1) + 1 words: the words ahead are read by a window of that length and
    no subject is ever collected. All phrases are looked up in one pass.
    """
    reach = max((len(p) - 1) * (max_gap + 1) for p in phrases.values())
    wide = ordered.over_neighbours(words.select(subject, index, text), [subject], index,
                                   lambda w: {"_ahead": F.collect_list(text).over(w.rowsBetween(0, reach))}, 0, max(reach, 1))
    starts = sorted({t for p in phrases.values() for t in p[0]})
    hits = wide.where(F.col(text).isin(*starts)).select(subject, index, F.explode(F.array(*[
        F.struct(F.lit(n).alias("phrase"), _chain(F.col("_ahead"), p, max_gap).alias("_off")) for n, p in phrases.items()])).alias("h"))
    found = hits.where(F.col("h._off").isNotNull()).select(subject, F.col("h.phrase").alias("phrase"), F.col(index).alias("_f"), (F.col(index) + F.col("h._off")).alias("_l"))
    return found.groupBy(subject, "phrase").agg(F.min("_f").alias("first_pos"), F.min_by("_l", "_f").alias("last_pos"))


def passage_bounds(words: DataFrame, subject: str, index: str, text: str, start: str, end: str,
                   alternatives: list[tuple[Phrase, Phrase]], max_gap: int = 3) -> DataFrame:
    """Times of the first alternative whose start phrase and end phrase both occur, the end not before the start."""
    named = {f"{kind}{i}": p for i, pair in enumerate(alternatives) for kind, p in zip("se", pair, strict=True)}
    m = match(words, subject, index, text, named, max_gap)
    per = m.groupBy(subject, F.substring("phrase", 2, 9).cast("int").alias("alt")).agg(
        F.max(F.when(F.col("phrase").startswith("s"), F.col("first_pos"))).alias("_a"),
        F.max(F.when(F.col("phrase").startswith("e"), F.col("last_pos"))).alias("_z"))
    best = per.where(F.col("_z") >= F.col("_a")).groupBy(subject).agg(F.min_by(F.struct("alt", "_a", "_z"), "alt").alias("b")).select(subject, "b.*")
    place = words.select(subject, index, start, end)
    a = best.join(place.select(subject, F.col(index).alias("_a"), F.col(start).alias("start_time")), [subject, "_a"])
    return a.join(place.select(subject, F.col(index).alias("_z"), F.col(end).alias("end_time")), [subject, "_z"])
