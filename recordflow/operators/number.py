"""Positions and look-ahead within a key, safe for keys that hold much of the table.

A window over a hot key would run in one task. Here each key is cut into blocks by the value
of the order column, windows run per (key, block), and the blocks of a key are cut into blocks of
blocks in turn, so no window sees more rows than a block is wide, whatever the values. Blocks depend
on values alone, so a retried task cuts the same way. Keys must not be NULL: callers set such rows
aside first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.session import materialize

BLOCK = 1 << 20
#: Blocks of blocks: with blocks of 2^20, 64-bit values leave at most 16 rows per key in the end.
LEVELS = 2


def _block_of(value: Column, block: int) -> Column:
    """``value`` divided by ``block``, rounded down; exact for all 64-bit values."""
    return F.floor((value - F.pmod(value, F.lit(block))) / block).cast("bigint")


def _offsets(blocks: DataFrame, keys: list[str], block: int, levels: int = LEVELS) -> DataFrame:
    """(keys, _block, _offset): the sum of ``_total`` over the earlier blocks of the key."""
    if not levels:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
            Window.unboundedPreceding, -1)
        return blocks.select(*keys, "_block",
                             F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    cut = blocks.withColumn("_upper", _block_of(F.col("_block"), block))
    before = Window.partitionBy(*keys, "_upper").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    upper = cut.groupBy(*keys, F.col("_upper").alias("_block")).agg(F.sum("_total").alias("_total"))
    far = (_offsets(upper, keys, block, levels - 1).where("_offset != 0")
           .select(*keys, F.col("_block").alias("_upper"), F.col("_offset").alias("_far")))
    return (near.join(far, [*keys, "_upper"], "left")
            .select(*keys, "_block", (F.col("_near") + F.coalesce("_far", F.lit(0))).alias("_offset")))


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "position",
             block: int = BLOCK) -> DataFrame:
    """1, 2, 3, … per key in order of ``order``, a unique non-null integer column of any values.

    A block spans ``block`` order values, hence at most that many rows per task group.
    """
    cut = df.withColumn("_block", _block_of(F.col(order), block))
    group = [*keys, "_block"]
    local = cut.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    offsets = _offsets(cut.groupBy(*group).agg(F.count(F.lit(1)).alias("_total")), keys, block)
    return (local.join(offsets.where("_offset > 0"), group, "left")
            .withColumn(name, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
            .drop("_block", "_local", "_offset"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the rows up to this one, per key, in order of ``order`` (unique
    within the key up to a small factor, of any values)."""
    cut = df.withColumn("_block", _block_of(F.col(order), block)).withColumn("_value", value)
    group = [*keys, "_block"]
    upto = Window.partitionBy(*group).orderBy(order).rangeBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(upto), F.lit(0)))
    offsets = _offsets(cut.groupBy(*group).agg(F.coalesce(F.sum("_value"), F.lit(0))
                                               .alias("_total")), keys, block)
    return (local.join(offsets.where("_offset != 0"), group, "left")
            .withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0)))
            .drop("_block", "_value", "_local", "_offset"))


def placed_by_range(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``df`` with ``_order`` and ``_part``: dealt out by ranges of (keys, order) and written, so
    that a part holds a bounded stretch of rows and a retried task sees the same parts."""
    cut = df.withColumn("_order", order).repartitionByRange(*keys, "_order")
    return materialize(cut.withColumn("_part", F.spark_partition_id()), "placed")


def next_match(placed: DataFrame, keys: list[str], hit: Column, name: str) -> DataFrame:
    """The smallest ``order`` after this row's, within the key, whose row is a ``hit``.

    ``placed`` comes from :func:`placed_by_range`, by these keys or the first of them. Windows run
    per key and part; what crosses the parts of a key is one value of each. So a hot key, all its
    rows at one time even, is spread over as many tasks as its rows fill.
    """
    group = [*keys, "_part"]
    marked = F.when(hit, F.col("_order"))
    behind = Window.partitionBy(*group).orderBy(F.desc("_order")).rowsBetween(
        Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_low")).rowsBetween(
        Window.unboundedPreceding, -1)
    far = (placed.groupBy(*group).agg(F.min(marked).alias("_first"), F.min("_order").alias("_low"))
           .select(*group, F.min("_first").over(later).alias("_far"))
           .filter(F.col("_far").isNotNull()))
    return (placed.withColumn("_near", F.min(marked).over(behind)).join(far, group, "left")
            .withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far"))
