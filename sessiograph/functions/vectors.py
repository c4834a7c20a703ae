"""Arithmetic on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def fold(v: Column, start: float, step) -> Column:
    return F.aggregate(v, F.lit(start), step)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a plain reuse inside a lambda is evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: str | Column) -> Column:
    return fold(col(v), 0.0, lambda a, x: a + x)


def sum_sq(v: str | Column) -> Column:
    return fold(col(v), 0.0, lambda a, x: a + x * x)


def norm(v: str | Column) -> Column:
    return F.sqrt(sum_sq(v))


def mean_abs(v: str | Column) -> Column:
    return fold(col(v), 0.0, lambda a, x: a + F.abs(x)) / F.size(col(v))


def root_mean_sq(v: str | Column) -> Column:
    return F.sqrt(sum_sq(v) / F.size(col(v)))


def softmax(v: str | Column) -> Column:
    e = let(F.array_max(col(v)), lambda top: F.transform(col(v), lambda x: F.exp(x - top)))
    return let(e, lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)))


def positive_probability(scores: str | Column) -> Column:
    """Class-1 probability of a model output of one or two numbers, logits or probabilities."""
    s = col(scores)
    a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    is_prob = a.between(0, 1) & b.between(0, 1) & (a + b).between(0.98, 1.02)
    one = F.when(a.between(0, 1), a).otherwise(1 / (1 + F.exp(-a)))
    return F.when(F.size(s) == 2, F.when(is_prob, b).otherwise(1 / (1 + F.exp(a - b)))).when(F.size(s) == 1, one)


def scale_and_clip(v: Column, mean: Column, std: Column, bound: float = 10.0) -> Column:
    """(x - mean) / std in [-bound, bound]; a zero std leaves the difference as it is."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    scaled = F.zip_with(centred, std, lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))
    return F.transform(scaled, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def range_normalize(v: Column, low: Column, high: Column) -> Column:
    centred = F.zip_with(v, low, lambda x, a: x - a)
    width = F.zip_with(high, low, lambda b, a: b - a)
    return F.zip_with(centred, width, lambda x, w: F.when(w == 0, 0.0).otherwise(x / w))


def unary(v: str | Column, op: str, p: float = 1.0, floor: float = 1e-10) -> Column:
    """One element-wise operation by name; logarithms and roots are floored to stay finite."""
    v = col(v)
    bounded = {
        "mul": lambda x: x * p, "add": lambda x: x + p, "abs": lambda x: F.abs(x), "exp": lambda x: F.exp(x),
        "log": lambda x: F.log(F.greatest(x, F.lit(floor))),
        "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))),
        "pow": lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(p)),
        "dBp": lambda x: 10 * F.log10(F.greatest(x, F.lit(floor))),
        "dBv": lambda x: 20 * F.log10(F.greatest(x, F.lit(floor))),
    }
    if op in bounded:
        return F.transform(v, bounded[op])
    scale = {
        "norm_l2": norm(v),
        "norm_max": fold(v, 0.0, lambda a, x: F.greatest(a, F.abs(x))),
    }.get(op)
    if scale is not None:
        return let(scale, lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(0.0)))
    if op == "norm_range":
        return let(F.array_min(v), lambda low: let(F.array_max(v), lambda high: F.transform(
            v, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))))
    raise ValueError(f"unknown operation {op}")


def reduce_vector(v: str | Column, op: str) -> Column:
    v = col(v)
    return {"sum": total, "ssq": sum_sq, "l1": mean_abs, "l2": root_mean_sq}[op](v) if op in ("sum", "ssq", "l1", "l2") \
        else {"min": F.array_min, "max": F.array_max}[op](v)


def binary(a: Column, b: Column, op: str, zero: float = 0.0) -> Column:
    """Element-wise a op b; division by zero gives ``zero``."""
    ops = {
        "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y,
        "div": lambda x, y: F.when(y == 0, F.lit(zero)).otherwise(x / F.when(y == 0, 1.0).otherwise(y)),
        "pow": lambda x, y: F.pow(x, y), "min": lambda x, y: F.least(x, y), "max": lambda x, y: F.greatest(x, y),
    }
    return F.zip_with(a, b, ops[op])


def top_indices(v: str | Column, k: int) -> Column:
    """Positions of the k largest magnitudes, the lower position first on ties."""
    tagged = F.transform(col(v), lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda s: s["i"])


def hz_to(x: str | Column, scale: str, base: float = 27.5) -> Column:
    """Hertz to mel, Bark or semitones above ``base``."""
    x = col(x)
    return {
        "mel": 1127.0 * F.log(1.0 + x / 700.0),
        "bark": 26.81 / (1.0 + 1960.0 / x) - 0.53,
        "semitone": 12.0 * F.log2(x / base),
    }[scale]


def hz_from(x: str | Column, scale: str, base: float = 27.5) -> Column:
    x = col(x)
    return {
        "mel": 700.0 * (F.exp(x / 1127.0) - 1.0),
        "bark": 1960.0 / (26.81 / (x + 0.53) - 1.0),
        "semitone": base * F.pow(F.lit(2.0), x / 12.0),
    }[scale]
