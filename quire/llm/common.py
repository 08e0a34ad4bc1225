"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage, shared_path  # noqa: F401  (re-exported)
from quire.sources.tables import table  # noqa: F401

#: White space between words: the class [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is referenced inside a lambda is otherwise computed anew for
    every element the lambda sees. (An aggregate over no elements that starts
    with the value and finishes with the body.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def hex_digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (Spark
    resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def give_back() -> None:
    """Return freed Arrow memory to the system: Python workers stay after their task,
    beside those of the next stage."""
    pa.default_memory_pool().release_unused()
