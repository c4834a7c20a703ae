"""Column selection, filling, filtering, sampling. Nothing here shuffles unless its docstring says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (ACOUSTIC_NAME_PARTS, NON_FEATURE_COLUMNS, TEXT_FEATURE_NAMES, UPLOAD_EXTENSIONS,
                         UPLOAD_MIME_TYPES, ACOUSTIC_COLUMNS)
from ..functions import scalars as sc
from ..functions import text as tx
from . import ordered


def feature_names(columns: list[str]) -> tuple[list[str], list[str]]:
    """Acoustic columns by name part and text columns by exact name; identifiers never count."""
    left = [c for c in columns if c not in NON_FEATURE_COLUMNS]
    acoustic = [c for c in left if any(p in c for p in ACOUSTIC_NAME_PARTS)]
    return acoustic, [c for c in left if c in TEXT_FEATURE_NAMES and c not in acoustic]


def select_features_by_pattern(df: DataFrame, ids: list[str]) -> DataFrame:
    acoustic, text = feature_names(df.columns)
    return df.select(*ids, *acoustic, *text)


def select_features_by_prefix(df: DataFrame, prefixes: tuple[str, ...], ids: list[str], not_in: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*ids, *[c for c in df.columns if c.startswith(prefixes) and c not in not_in and c not in ids])


def select_numeric(df: DataFrame, ids: list[str], not_in: tuple[str, ...] = ()) -> DataFrame:
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*ids, *not_in)]
    return df.select(*ids, *keep)


def loudness_columns(df: DataFrame, parts: tuple[str, ...] = ("loudness", "equivalentSoundLevel")) -> list[str]:
    return [c for c in df.columns if any(p in c for p in parts)]


def standard_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Global z-score with sample deviation; a column without spread stays as it is. One aggregate, one broadcast row."""
    stats = df.agg(*[f(sc.skip_nan(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = ordered.with_scalars(df, stats)
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def treat_loudness(df: DataFrame, mode: str = "exclude") -> DataFrame:
    """exclude, normalize or keep the loudness-type columns."""
    names = loudness_columns(df)
    if mode == "exclude":
        return df.drop(*names)
    return standard_score(df, names) if mode == "normalize" else df


def project_audio_schema(df: DataFrame) -> DataFrame:
    """Identifiers and the acoustic columns that exist, lexical columns, defaults, word count."""
    ids = ["file_id", "segment_id", "start", "end", "duration", "label"]
    lexical = ["speech_rate", "articulation_rate", "type_token_ratio", "pronoun_count", "negation_count", "avg_word_length"]
    have = set(df.columns)
    known = [F.col(f"`{c}`") for c in [*ids, *ACOUSTIC_COLUMNS, *lexical] if c in have]
    default = {"segment_path": F.lit(""), "asr_conf_mean": F.lit(0.0), "asr_conf_std": F.lit(0.0), "word_count": tx.word_count("text")}
    return df.select(*known, *[F.col(n) if n in have else c.alias(n) for n, c in default.items()])


def project_text_schema(df: DataFrame, start_gap: Column, language_lists: dict | None = None, stopwords: list[str] | None = None) -> DataFrame:
    """The 25 columns of the text feature table. ``start_gap`` is the step from the previous start."""
    t = tx.Split("text")
    n = tx.word_count(t)
    stop, hard = tx.stopword_count(t, stopwords), tx.complex_word_count(t)
    return t.add_to(df).select(
        "start_time", "end_time", F.lit(None).cast("string").alias("speaker"), "text", "session_id", "label", "duration",
        start_gap.alias("pause_prev"), n.alias("num_tokens"), tx.unique_tokens(t).alias("num_unique_tokens"),
        tx.char_count(t).alias("num_chars"), n.alias("word_count"), tx.sentence_count(t).alias("sent_count"),
        tx.speech_rate(t, "duration").alias("words_per_sec"), tx.type_token_ratio(t).alias("type_token_ratio"),
        tx.avg_word_length(t).alias("avg_word_len"), hard.alias("num_complex_words"),
        tx.ratio_of_tokens(hard, t).alias("complex_word_ratio"), stop.alias("num_stopwords"),
        tx.ratio_of_tokens(stop, t).alias("stopword_ratio"), tx.marks(t, r"\?").alias("qmark_count"),
        tx.marks(t, "!").alias("excl_count"),
        *[c.alias(k) for k, c in tx.person_pronouns(t, language_lists).items()])


def sync_columns(df: DataFrame, reference: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``reference`` in its order."""
    missing = [c for c in reference.columns if c not in df.columns and c not in drop]
    if missing:
        raise ValueError(f"columns absent: {missing}")
    return df.select(*[c for c in reference.columns if c not in drop])


def select_and_rename(df: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    return df.select(*[F.col(f).alias(n) for f, n in zip(fields, names, strict=True)])


def fill_missing_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Absent columns become 0, and so do null, NaN and infinite values."""
    have = set(df.columns)
    filled = {f: F.coalesce(sc.finite(f), F.lit(0.0)) if f in have else F.lit(0.0) for f in features}
    return df.select(*[c for c in df.columns if c not in filled], *[c.alias(f) for f, c in filled.items()])


def missing_feature_gate(df: DataFrame, session: str, features: list[str], limit: float = 0.25) -> DataFrame:
    """Sessions that may be scored: at most ``limit`` of the features have no value in any segment.

    One aggregate with map-side combine.
    """
    have = [f for f in features if f in df.columns]
    present = [F.max(sc.finite(f).isNotNull().cast("int")) for f in have]
    n_present = sum(present[1:], present[0]) if present else F.lit(0)
    out = df.groupBy(session).agg((F.lit(len(features)) - n_present).alias("n_missing"))
    out = out.withColumn("missing_ratio", F.col("n_missing") / F.lit(float(len(features))))
    return out.where(F.col("missing_ratio") <= limit)


def keep_ids(df: DataFrame, ids: DataFrame | list[str], key: str) -> DataFrame:
    """Rows whose id is listed; an empty list keeps all. A table of ids is joined, AQE broadcasts it if small."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.trim(key).alias(key)).where(F.col(key) != "").distinct(), key, "left_semi")
    wanted = [i.strip() for i in ids if i.strip()]
    return df.where(F.col(key).isin(*wanted)) if wanted else df


def missing_ids(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return ids.select(F.trim(key).alias(key)).where(F.col(key) != "").distinct().join(df.select(key), key, "left_anti")


def duration_window(df: DataFrame, session: str, index: str, low: float = 3.0, high: float = 13.0) -> DataFrame:
    """Scored segments of low..high seconds; a session without any keeps all its scored segments.

    The per-session flag is an aggregate joined back, so a session of any size is spread over tasks.
    """
    scored = df.where(F.col("score").isNotNull()).withColumn("_in", F.col("duration").between(low, high))
    flags = scored.groupBy(session).agg(F.max("_in").alias("_any"), F.max(index).alias("_top"))
    return ordered.attach(scored, flags, [session], index).where(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def resolve_label(df: DataFrame, own: Column, path: Column, key: str, media: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Own label, else the 0/1 part of the path, else the media listing, else the transcripts, else 0.

    ``media`` and ``transcripts`` are (key, label) lookups with one row per key.
    """
    looked = (df.join(media.select(key, F.col("label").alias("_media")), key, "left")
              .join(transcripts.select(key, F.col("label").alias("_script")), key, "left"))
    number = sc.to_number(own).cast("int")
    return looked.withColumn("label", F.coalesce(number, sc.path_label(path), "_media", "_script", F.lit(0))).drop("_media", "_script")


def gate_by_value(df: DataFrame, gate: Column, fields: list[str], threshold: float, *, invert: bool = False,
                  zero: bool = False, output: float = 0.0) -> DataFrame:
    """Keep frames whose gate is at least the threshold (or below, inverted), or overwrite the others."""
    ok = F.coalesce(gate >= threshold, F.lit(False))
    ok = ~ok if invert else ok
    if not zero:
        return df.where(ok)
    return df.withColumns({f: F.when(ok, F.col(f)).otherwise(F.lit(output)) for f in fields})


def every_nth(df: DataFrame, index: str, n: Column | int, at_most: int | None = None) -> DataFrame:
    """Rows 0, n, 2n, … of each series, at most ``at_most`` of them. ``index`` is dense, so no ranking is needed."""
    n = F.lit(n) if isinstance(n, int) else n
    out = df.where(F.col(index) % n == 0)
    return out if at_most is None else out.where(F.col(index) < n * at_most)


def fps_interval(fps: Column, rate: Column | float) -> Column:
    """Frames between two samples when sampling ``rate`` frames a second."""
    return F.greatest(F.lit(1), F.floor(fps / rate)).cast("long")


def even_chunks(df: DataFrame, duration: Column, seconds: float = 15.0, at_most: int | None = None) -> DataFrame:
    """Chunk numbers of a recording with their bounds, thinned evenly to ``at_most`` if given; one input row per recording."""
    n = F.greatest(F.lit(1), F.ceil(duration / seconds)).cast("long")
    chosen = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    if at_most is not None:
        step = (F.col("_n") - 1) / F.lit(float(at_most - 1))
        thinned = F.transform(F.sequence(F.lit(0), F.lit(at_most - 1)), lambda i: F.bround(i * step).cast("long"))
        chosen = F.when(F.col("_n") > at_most, thinned).otherwise(F.when(F.col("_n") <= at_most, chosen))
    out = df.withColumn("_n", n).withColumn("_d", duration).withColumn("chunk", F.explode(chosen))
    out = out.withColumns({"chunk_start": F.col("chunk") * F.lit(seconds),
                           "chunk_end": F.least((F.col("chunk") + 1) * F.lit(seconds), F.col("_d"))})
    return out.where(F.col("chunk_end") > F.col("chunk_start")).drop("_n", "_d")


def downsample_timeline(df: DataFrame, keys: list[str], index: str, max_points: int) -> DataFrame:
    """Every k-th point and the last, k = ceil(n / max_points). The count is an aggregate joined back."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(index).alias("_top"))
    step = F.ceil(F.col("_n") / F.lit(max_points))
    keep = (F.col("_n") <= max_points) | (F.col(index) % step == 0) | (F.col(index) == F.col("_n") - 1)
    return ordered.attach(df, counts, keys, index).where(keep).drop("_n")


def valid_upload(name: Column, mime: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mime, F.lit(""))))
    return sc.file_ext(name).isin(*UPLOAD_EXTENSIONS) | m.isin(*UPLOAD_MIME_TYPES) | m.startswith("video/")
