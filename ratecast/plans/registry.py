"""Registry of named queries: each is a Spark plan over the driver's
tables plus (where SQL can express it) the DuckDB oracle for the same
result.  Doubles are returned unrounded on both sides and compared with a
relative tolerance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def measure(c) -> Column:
    """A result column as it is."""
    return F.col(c) if isinstance(c, str) else c
