"""Joins: equality, range, ownership, entitlement, nested children, fallback keys, labels.

Sides are never forced to broadcast: the adaptive planner picks from measured sizes and splits hot
keys.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators.number import numbered
from recordflow.operators.select import active
from recordflow.session import materialize


def inner(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on)


def theta(df: DataFrame, other: DataFrame, predicate: str,
          on: list[tuple[str, str]]) -> DataFrame:
    """Join on any predicate over both tables, among rows with equal column pairs ``on``.

    Without such a pair every two rows would be compared: write the predicate as a ``band_join``.
    """
    if not on:
        raise ValueError("theta needs equal columns in 'on'; for ranges there is band_join")
    test = F.expr(predicate)
    for left, right in on:
        test = test & (F.col(left) == F.col(right))
    return df.join(other, test)


#: The span of all bands is cut into 2 to this power cells.
CELL_BITS = 44
#: Bits of a stretch's key that hold its level.
LEVEL_BITS = 6
#: Up to so many stretches may be broadcast.
FEW_STRETCHES = 100_000


def _measure(df: DataFrame, column: str) -> Column:
    """Numbers, dates and times as doubles in their order; NULL where not finite."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.datediff(c, F.lit("1970-01-01").cast("date"))
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _pieces(first: Column, last: Column) -> Column:
    """(level, node) of the aligned stretches of 2^level cells that first..last falls into, at most
    two a level."""
    def at(level: Column) -> Column:
        size = F.expr("1L").cast("bigint")
        a = F.call_function("shiftright", first + F.call_function("shiftleft", size, level) - 1, level)
        e = F.call_function("shiftright", last + 1, level)
        left = F.when((a < e) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("node")))
        right = F.when((a < e) & (e % 2 == 1), F.struct(level.alias("level"), (e - 1).alias("node")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(CELL_BITS)), at))


def _stretch(node: Column, level: Column) -> Column:
    """Level and node as one number."""
    return F.shiftleft(node, LEVEL_BITS).bitwiseOR(level.cast("bigint"))


def band_join(df: DataFrame, point: str, bands: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of ``df`` with every band that holds their point (low <= point < high).

    The span of the bands is cut into fine cells, and a band into aligned stretches of 1, 2, 4, …
    cells, at most two of each size. A point looks up the one stretch of each size it lies in, of
    the sizes that occur. So wide and narrow bands cost alike, and one over the whole span is one
    row. Bands without a low or high end have no points, nor do those that end where they begin.

    The stretches are written and counted first. The planner takes their number for that of the
    bands, and goes by the few bytes they have in the file: it would broadcast tables of any size.
    """
    real = bands.filter(F.col(low) < F.col(high))
    ends = [_measure(bands, c) for c in (low, high)]
    least, most = real.agg(F.min(F.least(*ends)), F.max(F.greatest(*ends))).first()
    least = 0.0 if least is None else least
    unit = ((most - least) if most is not None else 0.0) / (1 << CELL_BITS) or 1.0

    def cell(side: DataFrame, column: str) -> Column:
        # Grows with the column; ends that are not finite, or out of the span, go to its edges.
        c = F.floor((_measure(side, column) - F.lit(least)) / F.lit(unit))
        edge = F.when(F.col(column) < F.lit(0).cast(side.schema[column].dataType), 0).otherwise(
            (1 << CELL_BITS) - 1) if isinstance(
            side.schema[column].dataType, (T.FloatType, T.DoubleType)) else F.lit(0)
        inside = F.greatest(F.lit(0), F.least(F.lit((1 << CELL_BITS) - 1), c))
        return F.when(c.isNull(), edge).otherwise(inside).cast("bigint")

    spread = real.withColumns({"_first": cell(real, low), "_last": cell(real, high)}).repartition(
        "_first", "_last")
    pieces = spread.withColumn("_piece", F.explode(_pieces(F.col("_first"), F.col("_last"))))
    listed = materialize(pieces.withColumn("_at", _stretch(F.col("_piece.node"), F.col("_piece.level")))
                         .drop("_first", "_last", "_piece"), "bands")
    level = F.col("_at").bitwiseAND((1 << LEVEL_BITS) - 1)
    counts = dict(listed.groupBy(level.alias("n")).agg(F.count("*")).collect())
    levels = sorted(counts)
    if sum(counts.values()) > FEW_STRETCHES:
        listed = listed.hint("merge")
    points = (df.filter(F.col(point).isNotNull()).withColumn("_cell", cell(df, point))
              .withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
              .withColumn("_at", _stretch(F.call_function("shiftright", "_cell", "_level"), F.col("_level")))
              .drop("_cell", "_level"))
    return (points.join(listed, "_at")
            .filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_at"))


class Hop(NamedTuple):
    """One step up an ownership chain: ``fk`` of the rows below points at ``table.key``."""

    table: DataFrame
    fk: str
    key: str = "id"


def owned(child: DataFrame, chain: list[Hop], owner_col: str, owner=None,
          flag: str = "is_active") -> DataFrame:
    """Child rows whose parent chain ends at an active, owned row; tables between are not asked
    whether their rows are active.

    ``owner`` is an owner value, or None for any owner. Semi-joins run from the top down, so
    only the keys that survive reach the next level.
    """
    top = chain[-1].table
    allowed = active(top, flag).filter(
        F.col(owner_col).isNotNull() if owner is None else F.col(owner_col) == owner)
    for below, hop in zip(reversed(chain[:-1]), reversed(chain[1:])):
        keys = allowed.select(F.col(hop.key).alias(hop.fk))
        allowed = below.table.join(keys, hop.fk, "left_semi")
    keys = allowed.select(F.col(chain[0].key).alias(chain[0].fk))
    return child.join(keys, chain[0].fk, "left_semi").select(*child.columns)


def without_child(df: DataFrame, key: str, child: DataFrame, fk: str, active_only: bool = True,
                  flag: str = "is_active") -> DataFrame:
    """Rows no child points at; ``active_only`` lets only active children count."""
    kids = active(child, flag, include_inactive=not active_only)
    return df.join(kids.select(F.col(fk).alias(key)), key, "left_anti").select(*df.columns)


def entitled(users: DataFrame, key: str, entitlements: DataFrame, user: str, code,
             require_active_row: bool = True, code_col: str = "code",
             status_col: str = "status") -> DataFrame:
    """Users with an active entitlement of this code."""
    held = entitlements.filter((F.col(code_col) == code) & (F.col(status_col) == "active"))
    if require_active_row:
        held = active(held)
    return users.join(held.select(F.col(user).alias(key)), key, "left_semi").select(*users.columns)


def linked(parent: DataFrame, key: str, child: DataFrame, fk: str,
           name: str = "n_children") -> DataFrame:
    """Every parent with the number of its children; the rows themselves via with_children."""
    counts = child.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parent.join(counts, key, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))


def _kids(key: str, child: DataFrame, fk: str, order: str, fields: list[str]) -> DataFrame:
    kids = child.filter(F.col(fk).isNotNull()).select(
        F.col(fk).alias(key), F.col(order).alias("_order"),
        F.struct(*fields).alias("_child"))
    return numbered(kids, [key], "_order", "_position")


def child_rows(parent: DataFrame, key: str, child: DataFrame, fk: str, order: str,
               fields: list[str], name: str = "child") -> DataFrame:
    """Every parent once per child: its columns, ``position`` 1, 2, 3, … in order of ``order``, a
    unique integer column of the child, and the child's ``fields`` as a struct. A parent without
    children has one row, with both NULL. The grain is the same however many children there are.
    """
    kids = _kids(key, child, fk, order, fields).select(
        key, F.col("_position").alias("position"), F.col("_child").alias(name))
    return parent.join(kids, key, "left")


def with_children(parent: DataFrame, key: str, child: DataFrame, fk: str, order: str,
                  fields: list[str], per_part: int, name: str = "children") -> DataFrame:
    """Every parent with its children as ordered arrays of structs, for readers that want arrays.

    An array holds at most ``per_part`` children; a parent with more gets several rows,
    ``part`` 0, 1, 2, …, so no child is dropped and no array grows with the table. For one row per
    child see :func:`child_rows`.
    """
    placed = _kids(key, child, fk, order, fields).withColumn(
        "part", F.floor((F.col("_position") - 1) / per_part))
    item = F.struct("_position", "_child")
    arrays = placed.groupBy(key, "part").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_child"]).alias(name))
    empty = F.array().cast(arrays.schema[name].dataType)
    return (parent.join(arrays, key, "left")
            .withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
            .withColumn(name, F.coalesce(F.col(name), empty)))


def _filled(df: DataFrame, key: str) -> Column:
    """The key, or where it is NULL a hash of the row, so that such rows do not meet in one task."""
    kind = df.schema[key].dataType
    atoms = [f.name for f in df.schema.fields if not isinstance(
        f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    if isinstance(kind, T.LongType):
        return F.coalesce(F.col(key), F.xxhash64(*atoms))
    if isinstance(kind, T.IntegerType):
        return F.coalesce(F.col(key), F.hash(*atoms))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(key), F.xxhash64(*atoms).cast("string"))
    return F.col(key)


def left_unique(df: DataFrame, side: DataFrame, on: list[tuple[str, str]],
                take: list[str]) -> DataFrame:
    """``df`` with the ``take`` columns of the side row whose keys match, NULL where none does.

    The side is unique by its keys. Rows with a NULL key find nothing, and are spread over all
    tasks; hot keys are left to the adaptive join, which splits them.
    """
    right = side.select(*[F.col(r).alias(f"_on{i}") for i, (_, r) in enumerate(on)], *take)
    test = reduce(Column.__and__, [_filled(df, left) == F.col(f"_on{i}")
                                   for i, (left, _) in enumerate(on)])
    whole = reduce(Column.__and__, [F.col(left).isNotNull() for left, _ in on])
    return df.join(right, test, "left").select(
        *df.columns, *[F.when(whole, F.col(c)).alias(c) for c in take])


def first_per_key(dim: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One ``value`` per non-null key: the smallest, as the first match by id would be."""
    return dim.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k_{name}")).agg(
        F.min(value).alias(name))


def match_priority(src: DataFrame, dim: DataFrame, keys: list[tuple[str, str]], value: str,
                   name: str = "matched") -> DataFrame:
    """``name``: the ``dim`` id found by the first of the key pairs (src column, dim column)
    that matches; NULL where none does. Doubled dim keys resolve to the smallest id."""
    out, found = src, []
    for i, (left, right) in enumerate(keys):
        side = first_per_key(dim, right, value, f"_m{i}")
        out = left_unique(out, side, [(left, f"_k__m{i}")], [f"_m{i}"])
        found.append(F.col(f"_m{i}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"_m{i}" for i in range(len(keys))])


def match_fallback(events: DataFrame, payments: DataFrame, capture: str = "capture_id",
                   order: str = "order_id", value: str = "id",
                   name: str = "payment_id") -> DataFrame:
    """Payment of an event: by capture id, else by order id."""
    return match_priority(events, payments, [(capture, "provider_capture_id"),
                                             (order, "provider_order_id")], value, name)


def localize(df: DataFrame, key: str, lang: str, labels: DataFrame, name: str = "label") -> DataFrame:
    """Label of ``key`` in the row's language; the key itself where none is known.

    ``labels`` has (lang, source, target), unique per (lang, source). The adaptive planner
    broadcasts it if its bytes prove few, else hot keys are split.
    """
    side = labels.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                         F.col("target").alias("_target"))
    return (df.join(side, (F.col(lang) == F.col("_lang")) & (F.col(key) == F.col("_source")),
                    "left")
            .withColumn(name, F.coalesce("_target", F.col(key)))
            .drop("_lang", "_source", "_target"))
