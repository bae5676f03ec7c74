"""Connected components of a graph given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge lists apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its
    component and has a row itself.

    Large-star and small-star steps take turns: each node's larger, then its smaller neighbours are
    tied to the smallest node it knows. Edges never become more, and a few rounds, growing with the
    logarithm of the longest path, leave one star per component. Every round is written to the
    shared folder. Loops, repeated edges and rows with a NULL end change nothing.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x.isNotNull() & y.isNotNull() & (x != y))
                 .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(),
                 "components")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        # Without a distinct here: an edge gives one row, and repeated ones go at the end.
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo != m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        after = stored(small, "components")
        was, mark = mark, _mark(after)
        if mark == was:
            break
        now = after
    return (now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
