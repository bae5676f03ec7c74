"""Counts, rollups and latest-state aggregates. All combine on the map side before shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.functions.text import safe_ratio
from recordflow.operators.select import active

# The first child status present decides the parent's status.
STATUS_LADDER = [("error", "error"), ("warning", "partial")]
STATUS_EMPTY = "partial"
STATUS_ELSE = "ready"

# Run status -> scenario status.
RUN_TO_SCENARIO = {"passed": "passed", "failed": "failed", "cancelled": "cancelled"}


def count_where(df: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """One row: the number of rows for each named predicate, in one pass."""
    return df.agg(*[F.count_if(F.expr(p)).alias(name) for name, p in predicates.items()])


def exists_by(df: DataFrame, keys: list[str], predicate: str, name: str = "found") -> DataFrame:
    """Per key, whether any row meets the predicate."""
    return df.groupBy(*keys).agg(
        F.bool_or(F.coalesce(F.expr(predicate), F.lit(False))).alias(name))


def rollup_status(parent: DataFrame, key: str, child: DataFrame, fk: str,
                  status: str = "status", child_status: str = "status", ladder=None,
                  empty: str = STATUS_EMPTY, default: str = STATUS_ELSE,
                  flag: str = "is_active", only: Column | None = None) -> DataFrame:
    """Parents with their status worked out from their active children's statuses.

    Inactive parents, and with ``only`` all others it leaves out, keep theirs.
    """
    steps = STATUS_LADDER if ladder is None else ladder
    seen = [F.bool_or(F.coalesce(F.col(child_status) == s, F.lit(False))).alias(f"_has{i}")
            for i, (s, _) in enumerate(steps)]
    kids = (active(child, flag).filter(F.col(fk).isNotNull())
            .groupBy(F.col(fk).alias(key)).agg(*seen, F.lit(True).alias("_any")))
    value = F.lit(default)
    for i, (_, result) in reversed(list(enumerate(steps))):
        value = F.when(F.col(f"_has{i}"), F.lit(result)).otherwise(value)
    value = F.when(F.col("_any").isNull(), F.lit(empty)).otherwise(value)
    touched = F.lit(True) if only is None else only
    if flag in parent.columns:
        touched = touched & F.coalesce(F.col(flag), F.lit(False))
    before = F.col(status) if status in parent.columns else F.lit(None).cast("string")
    return (parent.join(kids, key, "left")
            .withColumn(status, F.when(touched, value).otherwise(before))
            .drop("_any", *[f"_has{i}" for i in range(len(steps))]))


def distinct_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values per key, one row each."""
    return df.select(key, value).distinct()


def hit_stats(df: DataFrame, tier: str, is_hit: str, size: str, ts: str) -> DataFrame:
    """Per tier and in total: entries, hits, misses, bytes, earliest time, hit ratio.

    The total line sums the parts and works its ratio out anew.
    """
    hit = F.coalesce(F.expr(is_hit), F.lit(False))
    sums = df.rollup(tier).agg(
        F.grouping(tier).alias("_total"), F.count(F.lit(1)).alias("entries"),
        F.count_if(hit).alias("hits"), F.sum(F.expr(size)).alias("bytes"),
        F.min(ts).alias("oldest"))
    return sums.select(
        F.when(F.col("_total") == 1, "total").otherwise(F.col(tier)).alias("tier"),
        F.col("_total").cast("int").alias("is_total"), "entries", "hits",
        (F.col("entries") - F.col("hits")).alias("misses"), "bytes", "oldest",
        safe_ratio("hits", "entries").alias("ratio"))


def progress(df: DataFrame, keys: list[str], done: str, points: Column) -> DataFrame:
    """Per key: total, done, points of the done rows, percent done."""
    hit = F.coalesce(F.expr(done), F.lit(False))
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("completed"),
        F.coalesce(F.sum(F.when(hit, points)), F.lit(0)).alias("points"))
    return sums.withColumn("percent", safe_ratio("completed", "total"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, without sorting the key's history."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def latest_status(events: DataFrame, key: str, order: list[str], state: str = "state",
                  mapping: dict | None = None, default: str = "ready",
                  name: str = "status") -> DataFrame:
    """Scenario status after its last start ('running') or finish event.

    A start maps to 'running'; a finish to its own status if it is one of the known ends, else
    to the default. Other rows (mid-run updates) must be left out before.
    """
    table = {"started": "running", **RUN_TO_SCENARIO} if mapping is None else mapping
    last = events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("_state"))
    value = F.lit(default)
    for source, target in table.items():
        value = F.when(F.col("_state") == source, F.lit(target)).otherwise(value)
    return last.select(key, value.alias(name))


def transitions(events: DataFrame, key: str, ts: str, tie: str, state: str, target: str,
                extras: dict[str, Column] | None = None,
                carry: dict[str, Column] | None = None) -> DataFrame:
    """Per key: ``last_state``; ``first_at`` and ``first_state`` of its first event; and
    ``entered_on``, when ``target`` was last entered from another state by a later one.

    Whether the first event enters the target depends on the state before it, which the caller
    knows (see :func:`entered_since`). ``extras`` are columns whose largest value per key comes
    along. ``carry`` are columns of single events: ``first``, ``last`` and ``entered`` are structs
    of them, of the first event, the last one and the one that last entered the target.

    The last entry is the first target event after the last other one before the last target event:
    three aggregates that combine before their shuffles, so a key's history is never sorted, and
    events of one key at one time are spread over all tasks.
    """
    extras, carry = extras or {}, carry or {}
    cut = (events.filter(F.col(key).isNotNull())
           .select(F.col(key), F.struct(F.col(ts).alias("ts"), F.col(tie).alias("id")).alias("_at"),
                   F.coalesce(F.col(state), F.lit("")).alias("_state"),
                   F.struct(F.lit(None).cast("boolean").alias("_none"),
                            *[c.alias(name) for name, c in carry.items()]).alias("_with"),
                   *[c.alias(name) for name, c in extras.items()]))
    hit = F.col("_state") == target
    event = F.struct("_state", "_with")
    ends = cut.groupBy(key).agg(
        F.max_by(event, "_at").alias("_last"), F.min_by(event, "_at").alias("_first"),
        F.min("_at").alias("_from"), F.max(F.when(hit, F.col("_at"))).alias("_held"),
        *[F.max(name).alias(name) for name in extras])
    other = (cut.where(~hit).select(key, "_at")
             .join(ends.where("_held is not null").select(key, "_held"), key)
             .where("_at < _held").groupBy(key).agg(F.max("_at").alias("_since")))
    entry = (cut.where(hit).select(key, "_at", "_with").join(other, key).where("_at > _since")
             .groupBy(key).agg(F.min("_at").alias("_entry"),
                               F.min_by("_with", "_at").alias("_entry_with")))
    structs = [F.col("_first._with").alias("first"), F.col("_last._with").alias("last"),
               F.col("_entry_with").alias("entered")] if carry else []
    return ends.join(entry, key, "left").select(
        key, F.col("_last._state").alias("last_state"), F.col("_from.ts").alias("first_at"),
        F.col("_first._state").alias("first_state"), F.col("_entry.ts").alias("entered_on"),
        *extras, *structs)


def entered_since(before, target: str) -> Column:
    """When the target was last entered, given the state before the first event."""
    state = F.col(before) if isinstance(before, str) else before
    at_first = F.when((F.col("first_state") == target)
                      & (F.coalesce(state, F.lit("")) != target), F.col("first_at"))
    return F.greatest("entered_on", at_first)


def streak(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Per user: the number of consecutive active days up to the latest one.

    Days are made distinct first, so a user's window holds days, not events.
    """
    days = df.select(user, F.to_date(ts).alias("_day")).distinct().filter(
        F.col("_day").isNotNull())
    place = F.row_number().over(Window.partitionBy(user).orderBy("_day"))
    runs = (days.withColumn("_run", F.date_sub("_day", place))
            .groupBy(user, "_run").agg(F.count(F.lit(1)).alias("_days"),
                                       F.max("_day").alias("_until")))
    return runs.groupBy(user).agg(F.max_by("_days", "_until").alias("current_streak"),
                                  F.max("_until").alias("last_day"))
