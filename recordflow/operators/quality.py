"""Validation rules, duplicate and reference audits, in-batch uniqueness."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import clean, slug_text
from recordflow.operators.join import left_unique
from recordflow.schemas import Edge

# Fixed value: a plain address shape, one '@' between dot-separated parts.
EMAIL_SHAPE = r"^[A-Za-z0-9_+\-]+(\.[A-Za-z0-9_+\-]+)*@([A-Za-z0-9\-]+\.)+[A-Za-z]{2,}\z"


class Rule(NamedTuple):
    """``broken`` is true for a bad value; ``message`` is what the error map says."""

    field: str
    broken: Column
    message: str


def required(field: str) -> Rule:
    return Rule(field, F.length(clean(field)) == 0, "required")


def one_of(field: str, vocabulary: list) -> Rule:
    return Rule(field, ~F.coalesce(F.col(field).isin(vocabulary), F.lit(False)), "not_allowed")


def int_range(field: str, low: int, high: int) -> Rule:
    """Whole number in the half-open range [low, high)."""
    return Rule(field, ~F.coalesce(F.col(field).between(low, high - 1), F.lit(False)), "invalid")


def float_range(field: str, low: float, high: float) -> Rule:
    """Number in [low, high]; NaN is out."""
    good = F.col(field).between(low, high) & ~F.isnan(field)
    return Rule(field, ~F.coalesce(good, F.lit(False)), "invalid")


def email_shape(field: str) -> Rule:
    return Rule(field, ~F.coalesce(F.col(field).rlike(EMAIL_SHAPE), F.lit(False)), "invalid")


def slug_shape(field: str) -> Rule:
    """A slug is its own slug text, and not empty."""
    good = (F.col(field) == slug_text(field)) & (F.length(field) > 0)
    return Rule(field, ~F.coalesce(good, F.lit(False)), "invalid")


def max_length(field: str, n: int) -> Rule:
    """At most ``n`` characters; NULL passes."""
    return Rule(field, F.coalesce(F.length(field) > n, F.lit(False)), "too_long")


def unique(field: str, flag: str) -> Rule:
    """Reads the flag column that :func:`flag_doubled` made."""
    return Rule(field, F.col(flag), "duplicate")


def validate(df: DataFrame, rules: list[Rule], mode: str = "all") -> DataFrame:
    """Adds ``errors``, a map field -> message. A field reports its first broken rule; mode
    'first' stops at the first bad field."""
    first_of_field: dict[str, list[Rule]] = {}
    for rule in rules:
        first_of_field.setdefault(rule.field, []).append(rule)
    entries = []
    for field, own in first_of_field.items():
        message = reduce(lambda rest, r: F.when(r.broken, F.lit(r.message)).otherwise(rest),
                         reversed(own), F.lit(None).cast("string"))
        entries.append(F.struct(F.lit(field).alias("key"), message.alias("value")))
    bad = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    if mode == "first":
        bad = F.slice(bad, 1, 1)
    elif mode != "all":
        raise ValueError("mode must be 'all' or 'first'")
    return df.withColumn("errors", F.map_from_entries(bad))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with errors) of a validated table."""
    clean_rows = F.size("errors") == 0
    return df.filter(clean_rows).drop("errors"), df.filter(~clean_rows)


def violation_counts(df: DataFrame) -> DataFrame:
    """Number of rows per (field, message)."""
    return (df.select(F.explode("errors").alias("field", "message"))
            .groupBy("field", "message").agg(F.count(F.lit(1)).alias("n")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their count; keys with a NULL part are not compared."""
    return (_keyed(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def flag_doubled(df: DataFrame, keys: list[str], name: str = "is_doubled") -> DataFrame:
    """Marks each row whose key another row has too; NULL keys pass.

    Keys are counted first and only the doubled ones come back, so that a hot key is split by
    the join instead of sitting in one window.
    """
    doubled = duplicates(df, keys).select(*keys, F.lit(True).alias(name))
    return left_unique(df, doubled, [(k, k) for k in keys], [name]).withColumn(
        name, F.coalesce(name, F.lit(False)))


def accept_unique(new: DataFrame, existing: DataFrame, keys: list[str],
                  order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a new row is taken if no existing row has its key and it is the
    first of the batch that does; rows with a NULL key part are always taken.

    ``order`` must be unique per row.
    """
    first = _keyed(new, keys).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    taken = existing.select(*keys).distinct().withColumn("_taken", F.lit(True))
    verdicts = first.join(taken, keys, "left")
    marked = left_unique(new, verdicts, [(k, k) for k in keys], ["_first", "_taken"])
    is_first = F.struct(*order) == F.col("_first")
    good = F.col("_first").isNull() | (is_first & F.col("_taken").isNull())
    extra = ["_first", "_taken", "_good"]
    marked = marked.withColumn("_good", good)
    return (marked.filter("_good").drop(*extra).select(*new.columns),
            marked.filter("not _good").drop(*extra).select(*new.columns))


def fk_audit(tables: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """Per declared key: rows pointing nowhere and rows with a NULL key."""
    reports = []
    for edge in edges:
        child = tables[edge.child].select(F.col(edge.fk).alias("_fk"))
        parents = tables[edge.parent].select(F.col(edge.key).alias("_fk")).distinct()
        # Count per key value before the join: one row per distinct key is shuffled.
        used = child.groupBy("_fk").agg(F.count(F.lit(1)).alias("_n"))
        nulls = F.coalesce(F.sum(F.when(F.col("_fk").isNull(), F.col("_n"))), F.lit(0))
        lost = F.coalesce(
            F.sum(F.when(F.col("_fk").isNotNull() & F.col("_ok").isNull(), F.col("_n"))), F.lit(0))
        name = f"{edge.child}.{edge.fk}->{edge.parent}.{edge.key}"
        reports.append(used.join(parents.withColumn("_ok", F.lit(True)), "_fk", "left")
                       .agg(lost.alias("orphans"), nulls.alias("nulls"))
                       .select(F.lit(name).alias("edge"), "orphans", "nulls"))
    return reduce(DataFrame.unionByName, reports)


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
