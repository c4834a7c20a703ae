"""Small SQL fragments shared by the oracle queries."""

from __future__ import annotations


def r(x: str, name: str, digits: int = 6) -> str:
    """Rounded (to six places if not said otherwise), never minus zero."""
    return f"round({x}, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def listed(words: list[str]) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"CAST(len(list_filter(lw, lambda x: x IN ({inside}))) AS INTEGER)"


N = "CAST(len(w) AS INTEGER)"
TTR = "CASE WHEN len(w) > 0 THEN CAST(len(list_distinct(lw)) AS DOUBLE) / len(w) ELSE 0 END"
AWL = "CASE WHEN len(w) > 0 THEN CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w) ELSE 0 END"


def count_of(pattern: str, text: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


CLAMP = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {}))"


def clamp(x: str) -> str:
    return CLAMP.format(x)


def band(x: str, medium: float, high: float) -> str:
    return f"CASE WHEN {x} >= {high} THEN 'high' WHEN {x} >= {medium} THEN 'medium' ELSE 'low' END"
