"""Events as they are delivered: repeated, late, and at times without an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identified(events: DataFrame, name: str = "event_id") -> DataFrame:
    """``events`` with an id on every row: one without is known by its content, as a negative
    hash of all its columns."""
    rest = [F.col(f"`{c}`") for c in events.columns if c != name]
    content = F.xxhash64(*rest).bitwiseAND(F.lit((1 << 63) - 1))
    return events.withColumn(name, F.coalesce(F.col(name).cast("bigint"), -content - 1))


def once(events: DataFrame, name: str = "event_id") -> DataFrame:
    """One row per event: of rows that share an id, the one smallest in its columns. Rows without
    an id count once where all their columns are equal, and every one for itself otherwise."""
    known = identified(events, name)
    rest = [c for c in known.columns if c != name]
    one = known.groupBy(name).agg(F.min(F.struct(*[f"`{c}`" for c in rest])).alias("_one"))
    return one.select(name, "_one.*").select(*[f"`{c}`" for c in events.columns])
