"""Run lifecycle: per-run state from its events. Every field is an aggregate that merges in any
order, so batches that arrive late give the same state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARTED, UPDATED, FINISHED = "started", "status", "finished"
# Fixed value: the status a run starts with.
START_STATUS = "precheck"


def run_state(events: DataFrame) -> DataFrame:
    """One row per run. ``events``: run_id, scenario_id, event_id, ts, kind (started, status,
    finished), status. ``last_at`` orders states when they are merged."""
    at = F.struct("ts", "event_id")
    status = F.when(F.col("kind") == STARTED, START_STATUS).otherwise(F.col("status"))
    return events.groupBy("run_id").agg(
        F.max("scenario_id").alias("scenario_id"),
        F.max_by(status, at).alias("status"),
        F.min(F.when(F.col("kind") == STARTED, F.col("ts"))).alias("started_on"),
        F.max(F.when(F.col("kind") == FINISHED, F.col("ts"))).alias("finished_on"),
        F.max(at).alias("last_at"))


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of two sets of events of the same runs, combined."""
    return old.unionByName(new).groupBy("run_id").agg(
        F.max("scenario_id").alias("scenario_id"),
        F.max_by("status", "last_at").alias("status"),
        F.min("started_on").alias("started_on"), F.max("finished_on").alias("finished_on"),
        F.max("last_at").alias("last_at"))


def with_duration(runs: DataFrame) -> DataFrame:
    """Adds ``duration_ms`` of finished runs."""
    span = F.unix_micros(F.col("finished_on").cast("timestamp")) - F.unix_micros(
        F.col("started_on").cast("timestamp"))
    return runs.withColumn("duration_ms", F.floor(span / 1000).cast("bigint"))
