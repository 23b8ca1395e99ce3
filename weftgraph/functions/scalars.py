"""Per-row expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(bindings: list[str], shards: int) -> Column:
    """Shard of a prefix row: its last bound vertex modulo the number of shards."""
    return F.pmod(F.col(bindings[-1]), F.lit(shards)).cast("int")


def appended(values: str, value: Column) -> Column:
    return F.array_append(values, value)


def last_of(values: str) -> Column:
    return F.element_at(values, -1)


def surviving(queries: str, allowed: str) -> Column:
    """Queries of a row that are in the allowed list; filter rows on its size."""
    return F.array_intersect(queries, allowed)


def sink_line(columns: list[str], queries: str | None = None) -> Column:
    """A text sink's line: values joined by blanks, a query list as `--Query: a b --`."""
    parts = [F.concat(F.lit("--Query: "), F.array_join(F.col(c).cast("array<string>"), " "), F.lit(" --")) if c == queries else F.col(c).cast("string") for c in columns]
    return F.concat_ws(" ", *parts)
