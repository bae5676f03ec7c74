"""Unique slugs: the first free of s, s-2, s-3, … in insertion order.

Numbering each slug's rows is right unless a suffixed name is also somebody's own slug
("a", "a", "a-2"). Then two rules meet: rows of "a" skip "a-2" if its owner came before the row
that would take it, and that owner loses "a-2" if the row of "a" came first.

Take the suffixes k of a parent that are somebody's own slug in order, and let h of them be held by
their owners so far. The row that would take k is number k - h of its parent, and it comes after the
owner's if fewer than that came before it. So each suffix is a step h -> h + [h < t] with a t known
beforehand, and the row-by-row result is a walk over these steps. Steps compose: any number of them
is a map h -> h + (how many of some limits exceed h). Blocks of steps are composed side by side,
one value per block crosses the cuts, and blocks are walked side by side again. Whether a parent has
its own plain name is settled one level of suffixes before.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.operators.number import BLOCK, numbered, running_sum
from recordflow.operators.select import active
from recordflow.session import materialize

_SUFFIXED = "^(.+)-([1-9][0-9]{0,17})\\z"
_ENDINGS = "((?:-[1-9][0-9]{0,17})+)\\z"
#: Steps that are composed in one piece.
FOLD = 4096
#: The limit of a step that is always taken.
ALWAYS = 1 << 62


def taken_slugs(projects: DataFrame, slug: str = "slug", taken: str = "all") -> DataFrame:
    """Slugs already in use: of every row, or of active rows only."""
    if taken not in ("all", "active"):
        raise ValueError("taken must be 'all' or 'active'")
    return active(projects, include_inactive=taken == "all").select(slug).distinct()


def dedupe_slugs(df: DataFrame, slug: str, order: str, existing: DataFrame | None = None,
                 name: str = "unique_slug", block: int = BLOCK, fold: int = FOLD) -> DataFrame:
    """Adds the unique slug of each row. ``order`` is a unique integer, the insertion order;
    ``existing`` holds one column of slugs taken beforehand. Slugs are not NULL."""
    spark = df.sparkSession
    # Number the slugs once, on their two columns, and work from that.
    rows = materialize(numbered(df.select(slug, order), [slug], order, "_n", block)
                       .toDF("own", "at", "_n"), "slug-rows")
    taken = spark.createDataFrame([], "own string") if existing is None else (
        existing.toDF("own").filter(F.col("own").isNotNull()).distinct())
    names = (rows.filter("_n = 1").select("own", F.col("at").alias("since"))
             .join(taken.withColumn("fixed", F.lit(True)), "own", "full")
             .withColumn("fixed", F.coalesce("fixed", F.lit(False))))
    rivals = (names.withColumn("parent", F.regexp_extract("own", _SUFFIXED, 1))
              .withColumn("k", F.regexp_extract("own", _SUFFIXED, 2).try_cast("bigint"))
              .filter(F.col("k") >= 2)
              .join(rows.filter("_n = 1").select(F.col("own").alias("parent")), "parent",
                    "left_semi")
              .withColumn("depth", F.size(F.split(F.regexp_extract("own", _ENDINGS, 1), "-")) - 1))
    rivals = materialize(rivals, "slug-rivals")
    rivalled = not rivals.isEmpty()
    if rivalled:
        rivals = _settle(rivals, rows, taken, block, fold)

    lost = _losers(rivals, taken) if rivalled else taken
    placed = (rows.join(lost.select("own", F.lit(1).alias("_shift")), "own", "left")
              .withColumn("_m", F.col("_n") - 1 + F.coalesce("_shift", F.lit(0)))
              .select("own", "at", "_m"))
    if rivalled:
        placed = _skip_held(placed, rivals, block)
    else:
        placed = placed.withColumn("_skipped", F.lit(0))
    number = (F.col("_m") + 1 + F.col("_skipped")).cast("string")
    given = placed.select(
        F.col("at").alias(order), F.col("own").alias(slug),
        F.when(F.col("_m") == 0, F.col("own")).otherwise(F.concat("own", F.lit("-"), number))
        .alias(name))
    if set(df.columns) == {slug, order}:
        return given.select(*df.columns, name)
    return df.join(given.select(order, name), order).select(*df.columns, name)


def _skip_held(placed: DataFrame, rivals: DataFrame, block: int) -> DataFrame:
    """Adds how many suffixes each row finds held by their owners before the one it gets."""
    # Held suffixes by the number of names the parent hands out before reaching them.
    skips = (rivals.filter("held")
             .groupBy(F.col("parent").alias("own"),
                      (F.col("k") - 1 - F.col("held_before")).alias("_m"))
             .agg(F.count(F.lit(1)).alias("_skip")))
    busy = skips.select("own").distinct()
    union = (placed.join(busy, "own", "left_semi").withColumn("_skip", F.lit(0).cast("bigint"))
             .unionByName(skips, allowMissingColumns=True))
    crowded = (running_sum(union, ["own"], "_m", F.col("_skip"), "_skipped", block=block)
               .filter(F.col("at").isNotNull()).drop("_skip"))
    free = placed.join(busy, "own", "left_anti").withColumn("_skipped", F.lit(0).cast("bigint"))
    return crowded.unionByName(free)


def _losers(rivals: DataFrame, taken: DataFrame) -> DataFrame:
    """Slugs whose first row does not get the plain name."""
    beaten = rivals.filter("not fixed and not held").select("own")
    return beaten.unionByName(taken.select("own")).distinct()


def composed(limits: list[int]) -> list[int]:
    """The steps h -> h + [h < t] one after the other as one map h -> h + (limits above h), its
    limits in ascending order."""
    out: list[int] = []
    for t in limits:
        # The smallest h that the steps so far take to t or beyond.
        low, high = t - len(out), t
        while low < high:
            mid = (low + high) // 2
            if mid + len(out) - bisect_right(out, mid) >= t:
                high = mid
            else:
                low = mid + 1
        insort(out, low)
    return out


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, block, limits) from steps sorted by parent, block and k."""
    at, limits = None, []

    def flushed() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.int64()),
                                pa.array([composed(limits)], pa.list_(pa.int64()))],
                               ["parent", "block", "limits"])

    for batch in batches:
        for parent, block, t in zip(*(c.to_pylist() for c in batch.columns)):
            if (parent, block) != at:
                if limits:
                    yield flushed()
                at, limits = (parent, block), []
            limits.append(t)
    if limits:
        yield flushed()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, held_before, held) from (own, parent, block, t, start) sorted by parent, block and k."""
    at, h = None, 0
    for batch in batches:
        before, held = [], []
        for parent, block, t, start in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if (parent, block) != at:
                at, h = (parent, block), start
            before.append(h)
            held.append(h < t)
            h += h < t
        yield pa.record_batch([batch.column(0), pa.array(before, pa.int64()),
                               pa.array(held, pa.bool_())], ["own", "held_before", "held"])


def _entries(steps: DataFrame) -> DataFrame:
    """(parent, block, start): how many suffixes are held before each block but the first."""
    last = steps.groupBy("parent").agg(F.max("block").alias("_last")).where("_last > 0")
    inner = (steps.join(last, "parent").where("block < _last").select("parent", "block", "t", "k")
             .repartition("parent", "block").sortWithinPartitions("parent", "block", "k")
             .drop("k").mapInArrow(_maps, "parent string, block bigint, limits array<bigint>"))
    # One list of limits per block; the value at each cut is read off them in turn.
    lists = F.sort_array(F.collect_list(F.struct("block", "limits")))
    start = F.aggregate(
        "lists", F.array(F.lit(0).cast("bigint")),
        lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.size(
            F.filter(b["limits"], lambda v: v > F.element_at(acc, -1)))))
    return (inner.groupBy("parent").agg(lists.alias("lists"))
            .select("parent", F.posexplode(start).alias("block", "start")).where("block > 0")
            .withColumn("block", F.col("block").cast("bigint")))


def _settle(rivals: DataFrame, rows: DataFrame, taken: DataFrame, block: int,
            fold: int) -> DataFrame:
    """Adds who holds each rival suffix, and how many smaller ones of its parent are held."""
    # How many of the parent's rows came before the owner's first one.
    order = (rows.join(rivals.select(F.col("parent").alias("own")).distinct(), "own", "left_semi")
             .select(F.col("own").alias("parent"), F.col("at").alias("pos"),
                     F.lit(1).cast("bigint").alias("_row"), F.lit(None).cast("string").alias("own"))
             .unionByName(rivals.where("not fixed").select(
                 "parent", F.col("since").alias("pos"), F.lit(0).cast("bigint").alias("_row"), "own")))
    earlier = (running_sum(order, ["parent"], "pos", F.col("_row"), "_earlier", block=block)
               .where("own is not null").select("own", "_earlier"))
    rivals = materialize(numbered(rivals.join(earlier, "own", "left"), ["parent"], "k", "_place", block)
                         .withColumn("block", F.floor((F.col("_place") - 1) / fold)), "slug-steps")
    settled = None
    lost = taken.select(F.col("own").alias("parent"))
    for depth in sorted(r[0] for r in rivals.select("depth").distinct().collect()):
        steps = (rivals.where(F.col("depth") == depth)
                 .join(lost.withColumn("_lost", F.lit(1)), "parent", "left")
                 .withColumn("t", F.when(F.col("fixed"), F.lit(ALWAYS)).otherwise(
                     F.col("k") - F.coalesce("_lost", F.lit(0)) - F.col("_earlier"))))
        walked = (steps.join(_entries(steps), ["parent", "block"], "left")
                  .withColumn("start", F.coalesce("start", F.lit(0).cast("bigint")))
                  .repartition("parent", "block").sortWithinPartitions("parent", "block", "k")
                  .select("own", "parent", "block", "t", "start")
                  .mapInArrow(_walked, "own string, held_before bigint, held boolean"))
        now = materialize(steps.select(*rivals.columns).join(walked, "own"), "slug-rivals")
        settled = now if settled is None else settled.unionByName(now)
        lost = _losers(settled, taken).select(F.col("own").alias("parent"))
    return settled
