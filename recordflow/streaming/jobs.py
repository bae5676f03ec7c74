"""Streams: each micro-batch runs the batch cores on the whole histories it touches.

What was delivered is kept in a store, by the names an event can be found under. A batch looks up
the events, payments and users that hang together with its own, replays their histories with the
batch cores, and publishes all tables it changed with one marker. So the tables hold what a batch
job over all events so far would give, in whatever order and however often events are delivered;
a batch reads and writes what hangs together with it, not the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recordflow.functions.jsonx import webhook_fields
from recordflow.session import materialize
from recordflow.streaming import entitlements
from recordflow.streaming.delivery import identified, once
from recordflow.streaming.entitlements import entitlement_ledger
from recordflow.streaming.payments import (
    COMPLETED, REFUNDED, classify_actions, match_payments, payment_state)
from recordflow.streaming.runs import merge_runs, run_state
from recordflow.streaming.state import Change, StateTable, Store, Table
from recordflow.streaming.triage import with_reason


def run_stream(stream: DataFrame, step, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``step(batch, batch_id)`` on every micro-batch; with ``once`` until the input that is
    there now is used up."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    query = writer.start()
    if once:
        query.awaitTermination()
    return query


# ------------------------------------------------------------------ payments

_EVENT = ("event_id bigint, ts timestamp_ntz, event_type string, capture_id string, "
          "order_id string, payload string")
_ACTION = "event_id bigint, ok boolean, action string, reason string"


def payment_store(spark: SparkSession, path: str, payments: DataFrame,
                  full_every: int = 20) -> Store:
    """The tables of a payment job, seeded with ``payments`` as they are before all events."""
    log = T.StructType.fromDDL(f"name bigint, {_EVENT}")
    store = Store(spark, path, {
        "origins": Table(payments.schema, ["id"]),
        "payments": Table(payments.schema, ["id"]),
        "names": Table(T.StructType.fromDDL("name bigint, id bigint"), ["name"]),
        "events": Table(log, ["name", "event_id"], by=["name"]),
        "actions": Table(T.StructType.fromDDL(_ACTION), ["event_id"]),
        "ledger": Table(T.StructType.fromDDL(entitlements.SCHEMA), ["user_id"]),
    }, full_every)
    store.seed(origins=payments, payments=payments, names=_payment_names(payments).select("name", "id"))
    return store


def _named(prefix: str, column: str):
    """The name as a 64-bit hash. Two names of one hash are followed together, which brings in
    more histories than needed and changes none."""
    return F.when(F.col(column).isNotNull() & (F.col(column).cast("string") != ""),
                  F.xxhash64(F.lit(prefix), F.col(column).cast("string")))


def _exploded(df: DataFrame, *names) -> DataFrame:
    return df.withColumn("name", F.explode(F.array_compact(F.array(*names))))


def _payment_names(payments: DataFrame) -> DataFrame:
    """Payments once per name that an event or a user's other payment reaches them by."""
    return _exploded(payments, _named("C", "provider_capture_id"), _named("O", "provider_order_id"),
                     _named("U", "user_id"))


def _event_names(events: DataFrame) -> DataFrame:
    by_order = F.when(F.col("event_type") == COMPLETED, _named("O", "order_id"))
    return _exploded(events, _named("C", "capture_id"), by_order)


def _together(store: Store, batch_id: int, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, payments) of all that hangs together with these names: events and payments that
    share a capture or order id, and all payments of a user. Found name by name, in a few rounds,
    each looking up only names and payments that are new; what a round found is kept."""
    known = fresh = materialize(names.select("name").distinct(), "job-names")
    origins, events = store.empty("origins"), store.empty("events")
    while not fresh.isEmpty():
        ids = store.current("names", batch_id, fresh).select("id").distinct().join(
            origins.select("id"), "id", "left_anti")
        found = materialize(store.current("origins", batch_id, ids), "job-payments")
        past = materialize(store.current("events", batch_id, fresh), "job-history")
        met = _payment_names(found).select("name").unionByName(
            _event_names(past.drop("name")).select("name"))
        fresh = materialize(met.distinct().join(known, "name", "left_anti"), "job-names")
        known, origins = known.unionByName(fresh), origins.unionByName(found)
        events = events.unionByName(past)
    return events.drop("name").dropDuplicates(["event_id"]), origins


def payment_step(store: Store, strict: bool = False):
    """Events (event_id, ts, event_type, capture_id, order_id, and payload if there is one) into
    the payments, the ledger and the action log of a :func:`payment_store`.

    An event id counts once, whatever batch it comes in; events without one are known by their
    content. Late events are put where their time says. All tables of a batch are published
    together.
    """
    fields = T.StructType.fromDDL(_EVENT).names

    def step(batch: DataFrame, batch_id: int) -> None:
        if store.committed(batch_id):
            return
        if "payload" not in batch.columns:
            batch = batch.withColumn("payload", F.lit(None).cast("string"))
        new = once(batch.select(*fields))
        seen = store.current("actions", batch_id, new.select("event_id")).select("event_id")
        new = materialize(new.join(seen, "event_id", "left_anti").select(*fields), "job-batch")
        named = _event_names(new)
        before, origins = _together(store, batch_id, named)
        events = materialize(before, "job-history").unionByName(new)
        matched = materialize(match_payments(events, origins), "job-matched")
        after = payment_state(events, origins, strict, matched=matched)
        users = origins.select(F.col("id").alias("payment_id"), "user_id")
        moves = matched.join(users, "payment_id").select(
            "event_id", "ts", "user_id", "payment_id",
            F.when(F.col("event_type") == COMPLETED, "grant")
            .when(F.col("event_type") == REFUNDED, "revoke").alias("kind"))
        touched = users.filter("user_id is not null").select("user_id").distinct()
        store.commit(batch_id, {
            "events": named.select("name", *fields),
            "payments": after,
            "actions": classify_actions(events, origins, matched=matched),
            "ledger": Change(entitlement_ledger(moves), touched),
        })

    return step


def webhook_events(pushed: DataFrame) -> DataFrame:
    """Payment events of pushed requests (event_id, ts, body, headers) that pass the triage."""
    good = with_reason(pushed).filter("reason is null").withColumn("_w", webhook_fields("body"))
    return good.select("event_id", "ts", "_w.event_type", "_w.capture_id", "_w.order_id",
                       F.col("body").alias("payload"))


def webhook_step(store: Store, strict: bool = False):
    """Pushed requests into a payment store: triage, extraction, then :func:`payment_step`."""
    apply = payment_step(store, strict)

    def step(batch: DataFrame, batch_id: int) -> None:
        apply(webhook_events(batch), batch_id)

    return step


# -------------------------------------------------------------------- ledger

_GRANT = "event_id bigint, ts timestamp_ntz, user_id bigint, payment_id bigint, kind string"


def ledger_store(spark: SparkSession, path: str, full_every: int = 20) -> Store:
    """The tables of a ledger that is fed grants and revocations themselves."""
    return Store(spark, path, {
        "events": Table(T.StructType.fromDDL(_GRANT), ["user_id", "event_id"], by=["user_id"]),
        "ledger": Table(T.StructType.fromDDL(entitlements.SCHEMA), ["user_id"]),
    }, full_every)


def entitlement_step(store: Store):
    """Events (event_id, ts, user_id, payment_id, kind) into a :func:`ledger_store`: the histories
    of the users in a batch are replayed. Rows without a user change nothing."""
    fields = T.StructType.fromDDL(_GRANT).names

    def step(batch: DataFrame, batch_id: int) -> None:
        if store.committed(batch_id):
            return
        new = materialize(identified(batch.select(*fields)).filter("user_id is not null"),
                          "ledger-batch")
        users = new.select("user_id").distinct()
        events = materialize(
            once(store.current("events", batch_id, users).unionByName(new)), "ledger-events")
        store.commit(batch_id, {"events": events, "ledger": Change(entitlement_ledger(events), users)})

    return step


# ---------------------------------------------------------------------- runs


def run_step(runs: StateTable):
    """Run events into a table of run states, whose parts merge in any order and any number."""

    def step(batch: DataFrame, batch_id: int) -> None:
        new = materialize(run_state(batch), "run-batch")
        old = runs.current(before=batch_id, keys=new.select("run_id"))
        runs.upsert(merge_runs(old, new), batch_id)

    return step


def triage_step(good_path: str, dead_path: str):
    """Pushed events into two outputs, one folder per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        marked = with_reason(batch).persist()
        (marked.filter("reason is null").drop("reason").write.mode("overwrite")
         .parquet(f"{good_path}/batch={batch_id}"))
        (marked.filter("reason is not null").write.mode("overwrite")
         .parquet(f"{dead_path}/batch={batch_id}"))
        marked.unpersist()

    return step
