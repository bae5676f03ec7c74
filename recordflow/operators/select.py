"""Filters, projections, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.session import materialize


class NotFound(LookupError):
    """No row has the requested key."""


def where_all(df: DataFrame, values: dict) -> DataFrame:
    """Rows where every named column equals its value; None asks for NULL."""
    tests = [F.col(c).isNull() if v is None else F.col(c) == v for c, v in values.items()]
    return df.filter(reduce(Column.__and__, tests, F.lit(True)))


def active(df: DataFrame, flag: str = "is_active", include_inactive: bool = False) -> DataFrame:
    """Rows whose flag is true. NULL is inactive; a table without the column is all active."""
    return df if include_inactive or flag not in df.columns else df.filter(F.col(flag))


def where_expr(df: DataFrame, predicate: str) -> DataFrame:
    """Any AND / OR / NOT predicate as a Spark SQL expression; NULL drops the row."""
    return df.filter(F.expr(predicate))


def keyed_rows(df: DataFrame, key: str) -> DataFrame:
    """The whole table: ``key > 0``, or ``key != ''`` for a text key."""
    text = isinstance(df.schema[key].dataType, T.StringType)
    return df.filter(F.col(key) != "" if text else F.col(key) > 0)


def exclude(df: DataFrame, key: str, value, null_safe: bool = False) -> DataFrame:
    """All rows but the one with this key; NULL keys stay only when ``null_safe``."""
    return df.filter(~F.col(key).eqNullSafe(value) if null_safe else F.col(key) != value)


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def visible(df: DataFrame, hidden: list[str]) -> DataFrame:
    """Without the columns readers never see."""
    return df.drop(*hidden)


def lookup(df: DataFrame, key: str, value):
    """The row with this key, else :class:`NotFound`."""
    row = df.filter(F.col(key) == value).first()
    if row is None:
        raise NotFound(f"{key} = {value!r}")
    return row


def lookup_all(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Batch lookup: every wanted key with its row's columns and a ``found`` flag."""
    return wanted.join(df.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def order_columns(cols: list[str]) -> list[Column]:
    """'c' ascending, '-c' descending; NULLs last either way."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in cols]


def ordered(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*order_columns(cols))


def first_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """First row in this order; end the order with a key so that it is always the same one."""
    return df.orderBy(*order_columns(cols)).limit(1)


def page(df: DataFrame, cols: list[str], start: int = 0, step: int = 100) -> DataFrame:
    """Rows [start, start + step) in this order. Deep pages are read through
    :class:`Paged`, or by key with :func:`page_after`."""
    return df.orderBy(*order_columns(cols)).offset(start).limit(step)


class Paged:
    """A table written once in some order, of which any page can be read.

    The rows are dealt out by ranges of the order, one folder to a range, and counted per range. A
    page reads the ranges it lies in and nothing else, however deep; all that reaches the driver
    is one number per range. End the order with a key so that equal rows have a fixed place.
    """

    def __init__(self, df: DataFrame, cols: list[str]):
        self.cols, self.names = order_columns(cols), df.columns
        dealt = df.repartitionByRange(*self.cols).withColumn("_range", F.spark_partition_id())
        self.rows = materialize(dealt, "paged", by=["_range"])
        counts = dict(self.rows.groupBy("_range").count().collect())
        self.counts = sorted(counts.items())
        self.total = sum(counts.values())

    def page(self, start: int = 0, step: int = 100) -> DataFrame:
        """Rows [start, start + step)."""
        before, wanted, skipped = 0, [], 0
        for number, n in self.counts:
            if before < start + step and before + n > start:
                skipped = skipped if wanted else before
                wanted.append(number)
            before += n
        held = self.rows.filter(F.col("_range").isin(wanted)).select(*self.names)
        return held.orderBy(*self.cols).offset(max(start - skipped, 0)).limit(step)

    def info(self, start: int = 0, step: int = 100) -> dict:
        return {"total": self.total, "has_previous": start > 0, "has_next": self.total > start + step}


def page_after(df: DataFrame, key: str, last=None, step: int = 100) -> DataFrame:
    """Next page by key: reads only what lies behind ``last``, however deep."""
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(F.asc_nulls_last(key)).limit(step)


def page_info(df: DataFrame, start: int = 0, step: int = 100) -> DataFrame:
    """One row: total, has_previous, has_next."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.lit(start > 0).alias("has_previous"),
                  (total > start + step).alias("has_next"))
