"""All registered queries."""

from __future__ import annotations

from functools import cache
from importlib import import_module

from .registry import Registry

MODULES = ["scalar_functions", "projections", "sessions", "ranking", "joins", "frames", "functionals", "metrics", "models", "sources", "streams"]


@cache
def catalog() -> Registry:
    every = Registry()
    for name in MODULES:
        every.update(import_module(f"{__package__}.{name}").registry)
    return every
