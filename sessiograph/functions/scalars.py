"""Scalar rules shared by all operators: clamping, missing values, bands, names, time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BANDS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Null for NaN and both infinities, else the value."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def skip_nan(c: str | Column) -> Column:
    """NaN as null, so aggregates skip it."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def to_number(c: str | Column) -> Column:
    """Text to double; anything not a finite number is null."""
    return finite(col(c).try_cast("double"))


def clamp01(c: str | Column) -> Column:
    """Into [0, 1]; missing or non-finite is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(c), F.lit(0.0))))


def safe_div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def risk_level(score: str | Column, band: str = "overall") -> Column:
    medium, high = BANDS[band]
    s = col(score)
    return (F.when(s.isNull(), F.lit(None).cast("string")).when(s >= high, "high")
            .when(s >= medium, "medium").otherwise("low"))


def predict(score: str | Column, threshold: float) -> Column:
    return (col(score) >= threshold).cast("int")


def prediction_label(pred: str | Column, positive: str = "experimental", negative: str = "control") -> Column:
    p = col(pred)
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p == 1, positive).otherwise(negative)


def confidence(p: str | Column) -> Column:
    return F.greatest(col(p), 1 - col(p))


def segment_bounds(start: Column, alt_start: Column, end: Column, alt_end: Column, duration: Column) -> dict[str, Column]:
    """Start, end and duration from whichever fields exist; a zero end falls back to the start."""
    s = F.coalesce(start, alt_start, F.lit(0.0))
    raw_end = F.coalesce(end, alt_end)
    e = F.when(raw_end.isNull() | (raw_end == 0), s).otherwise(raw_end)
    return {"start_time": s, "end_time": e, "duration": F.coalesce(duration, F.greatest(F.lit(0.0), e - s))}


def format_time(seconds: str | Column) -> Column:
    s = F.floor(col(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def text_preview(text: str | Column, size: int, dots: bool = False) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    cut = F.substring(t, 1, size)
    return F.when(F.length(t) > size, F.concat(cut, F.lit("..."))).otherwise(cut) if dots else cut


def pretty_feature_name(name: str | Column) -> Column:
    spaced = F.regexp_replace(col(name), "_", " ")
    spaced = F.regexp_replace(spaced, r"(?i)\bsma3nz\b", "")
    spaced = F.regexp_replace(spaced, r"(?i)\bamean\b", "avg")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def path_label(path: str | Column) -> Column:
    """The first path part that is exactly 0 or 1."""
    found = F.regexp_extract(col(path), r"(?:^|/)([01])(?:/|$)", 1)
    return F.when(found != "", found).otherwise(F.lit(None)).cast("int")


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_ext(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1))


def base_session_id(file_id: str | Column) -> Column:
    """One id on every side: no label prefix, no copy suffix, no transcript suffix."""
    c = F.regexp_replace(col(file_id), r"^0_", "")
    c = F.regexp_replace(c, r"_transcript$", "")
    return F.regexp_replace(c, r"\s*\(\d+\)$", "")


def normalize_subject(pid: str | Column) -> Column:
    """Separators - ( ) . and blanks become one underscore, none at the ends, lower case."""
    c = F.regexp_replace(col(pid), r"[-().]", "_")
    c = F.regexp_replace(c, r"[_\s]+", "_")
    return F.lower(F.regexp_replace(c, r"^_+|_+$", ""))


def subject_candidates(pid: str | Column) -> Column:
    """The spellings under which a subject may be stored, in the order they are tried."""
    p = F.trim(col(pid))
    bare = F.trim(F.regexp_replace(p, r"\(.*?\)", ""))
    spellings = F.array(
        p, F.replace(p, F.lit("-"), F.lit("_")), F.replace(p, F.lit("-"), F.lit(".")),
        F.replace(p, F.lit("_"), F.lit(".")), F.replace(p, F.lit("."), F.lit("_")),
        bare, F.replace(bare, F.lit("-"), F.lit("_")), F.replace(bare, F.lit("."), F.lit("_")),
    )
    def collapse(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"[_.\-]{2,}", "_"), r"^[_.\- ]+|[_.\- ]+$", "")
    return F.array_distinct(F.transform(F.filter(spellings, lambda x: x != ""), collapse))


def label_to_group(label: str | Column) -> Column:
    s = F.lower(col(label))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s.rlike("control|negative"), "control").otherwise("experimental"))


def sigmoid(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def first_finite_json(json: str | Column, paths: list[str]) -> Column:
    """First of several JSON paths that holds a finite number."""
    return F.coalesce(*[to_number(F.get_json_object(col(json), p)) for p in paths])
