"""Quality rules with host verdicts, in DataFrame expressions only.

Per document the usual counts are taken over the whole text. A host's failure rate over the softer rules is shrunk by a beta
prior fitted to all hosts, so small hosts are not judged on a few pages; a host whose shrunk rate is too high loses the
documents that fail a soft rule themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, stored

#: Soft rules: share of symbols per word, share of repeated lines, mean word length, share of repeated words.
SYMBOLS_PER_WORD, REPEATED_LINES, WORD_LENGTH, REPEATED_WORDS = 0.1, 0.3, (2.0, 12.0), 0.3
#: A host is rejected from this shrunk failure rate on.
HOST_RATE = 0.5
#: Least weight of the prior, in documents.
PRIOR = 4.0
#: Rejected hosts up to this counted number are broadcast; more are joined by shuffle.
SMALL_HOSTS = 10_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda variable stands for it, where an expression would be repeated."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(codes: Column) -> Column:
    """Words covered by windows of three that occur twice or more; ``codes`` holds one hash per window, in order."""
    ordered = F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        same = F.filter(F.transform(pairs, lambda p, k: F.when(
            (p["c"] == F.get(pairs, k - 1)["c"]) | (p["c"] == F.get(pairs, k + 1)["c"]), p["i"])), lambda i: i.isNotNull())
        return F.sort_array(same)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    some = _once(ordered, lambda pairs: _once(starts(pairs), covered))
    return F.when(F.size(F.array_distinct(codes)) == F.size(codes), F.lit(0)).otherwise(some).cast("long")


def _measured(words: Column) -> Column:
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    codes = F.when(F.size(words) > 3, windows).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _once(codes, _repeated).alias("n_repeat_words"))


def text_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str | None, carry: bool = False) -> DataFrame:
    """doc_id, host, the counts and verdicts of each row, with ``carry`` also the row itself; a null text has no words."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    host = docs[host_col] if host_col else F.lit(None)
    row = F.struct(*[docs[c] for c in docs.columns]) if carry else F.lit(None).cast("int")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    measured = docs.select(
        row.alias("row"), docs[id_col].cast("long").alias("doc_id"), host.cast("string").alias("host"),
        _once(words_of(text), _measured).alias("w"),
        _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.monotonically_increasing_id().alias("n"))
    # a row number keeps filters above the measuring; below it they would measure once per use
    counts = measured.select("row", "doc_id", "host", "n", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words").where("n >= 0").drop("n")
    judged = counts.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())
    return judged if carry else judged.drop("row")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    words = F.col("n_words")
    return ((F.col("n_symbols") > SYMBOLS_PER_WORD * words) | (F.col("n_dup_lines") > REPEATED_LINES * F.col("n_lines"))
            | (F.col("word_chars") < WORD_LENGTH[0] * words) | (F.col("word_chars") > WORD_LENGTH[1] * words) | (F.col("n_repeat_words") > REPEATED_WORDS * words))


def host_verdicts(counts: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected. The prior's mean and weight follow from the hosts' rates (moments);
    its weight is that of PRIOR documents at least, also where all hosts agree and leave no variance to fit."""
    hosts = counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("soft_failed").cast("long")).alias("failed"))
    share = F.col("failed") / F.col("n")
    one = hosts.agg(F.avg(share).alias("mean"), F.var_pop(share).alias("var"), F.count("*").alias("k")).first()
    mean, var = one["mean"] or 0.0, one["var"] or 0.0
    weight = max(PRIOR, mean * (1 - mean) / var - 1) if var > 0 else PRIOR
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > HOST_RATE).alias("rejected"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    A null or empty text has no words and fails. A null host, or no host column, is judged by the document's own rules
    alone (``host_rate`` null). Repeated rows each get their row, null ids too; an empty table gives an empty result.
    """
    counts = stored(text_counts(docs, id_col, text_col, host_col), "counts")
    verdicts = host_verdicts(counts).select(F.col("host").alias("of"), "rate", "rejected")
    judged = counts.join(verdicts, F.col("host") == F.col("of"), "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & ~(F.coalesce("rejected", F.lit(False)) & F.col("soft_failed"))).alias("kept"))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: the host verdicts come first, then one pass over the texts decides."""
    counts = stored(text_counts(docs, id_col, text_col, host_col), "counts")
    bad = stored(host_verdicts(counts).where("rejected").select(F.col("host").alias("of")), "hosts")
    n_bad = bad.count()
    rows = text_counts(docs, id_col, text_col, host_col, carry=True).where(~F.col("base_failed"))
    if n_bad:
        # a document that passes the soft rules has no host to ask about; its key is its own, so no key is hot
        asked = F.when(F.col("soft_failed"), F.concat(F.lit("h"), "host")).otherwise(F.concat(F.lit("d"), F.xxhash64("row").cast("string")))
        hosts = bad.select(F.concat(F.lit("h"), "of").alias("of"))
        rows = rows.withColumn("asked", asked).join(F.broadcast(hosts) if n_bad <= SMALL_HOSTS else hosts, F.col("asked") == F.col("of"), "left_anti")
    return rows.select("row.*")
