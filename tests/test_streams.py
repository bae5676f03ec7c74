"""Streams over one and many files equal the batch result; replays change nothing."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.plans import flows
from recordflow.plans.registry import Tables
from recordflow.schemas import schema_of
from recordflow.session import scratch
from recordflow.sources import event_stream
from recordflow.streaming import jobs, payments
from recordflow.streaming.entitlements import entitlement_ledger
from recordflow.streaming.runs import run_state
from recordflow.streaming.delivery import once
from recordflow.streaming.state import Change, StateTable, Store, Table

FOLDER = "/root/testdata/sf0.001"
PARTS = 3


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def split(spark, tables, tmp_path_factory):
    """The events in time order as one file per part, oldest first."""
    folder = tmp_path_factory.mktemp("events")
    total = tables.events.count()
    for part in range(PARTS):
        (tables.events.filter((F.col("event_id") * PARTS / total).cast("int") == part).coalesce(1)
         .write.mode("append").parquet(str(folder)))
    return str(folder)


def stream(spark, path):
    return event_stream(spark, path, schema_of("events"), files_per_batch=1)


def test_payment_stream(spark, tables, split, rows):
    start = flows._payments(tables)
    batch = payments.payment_state(flows._payment_events(tables.events), start)
    store = jobs.payment_store(spark, scratch(spark, "p"), start, full_every=2)
    step = jobs.payment_step(store)
    query = jobs.run_stream(flows._payment_events(stream(spark, split)), step, scratch(spark, "c"))
    assert query.lastProgress["batchId"] >= PARTS - 1
    assert rows(store.current("payments")) == rows(batch)
    assert rows(store.current("actions")) == rows(
        payments.classify_actions(flows._payment_events(tables.events), start))
    last = tables.events.filter((F.col("event_id") * PARTS / tables.events.count()).cast("int")
                                == PARTS - 1)
    step(flows._payment_events(last), PARTS - 1)  # a replayed batch changes nothing
    assert rows(store.current("payments")) == rows(batch)


def test_ledger_stream(spark, tables, split, rows):
    batch = entitlement_ledger(flows._ledger_events(tables.events))
    store = jobs.ledger_store(spark, scratch(spark, "l"), full_every=3)
    jobs.run_stream(flows._ledger_events(stream(spark, split)), jobs.entitlement_step(store),
                    scratch(spark, "c"))
    assert rows(store.current("ledger")) == rows(batch)


def test_run_stream(spark, tables, split, rows):
    batch = run_state(flows._run_events(tables.events))
    table = StateTable(spark, scratch(spark, "r"), ["run_id"], batch.schema, full_every=2)
    table.seed(batch.limit(0))
    jobs.run_stream(flows._run_events(stream(spark, split)), jobs.run_step(table),
                    scratch(spark, "c"))
    assert rows(table.current()) == rows(batch)


GRANTS = "event_id long, ts timestamp_ntz, user_id long, kind string, payment_id long"


def at(hour):
    return datetime(2024, 1, 1, hour)


def test_a_grant_delivered_again_stays_revoked(spark, rows):
    store = jobs.ledger_store(spark, scratch(spark, "l"))
    step = jobs.entitlement_step(store)
    grant, revoke = (1, at(1), 7, "grant", 70), (2, at(2), 7, "revoke", 70)
    nameless = (None, at(3), 8, "grant", 80)
    for n, events in enumerate([[grant, nameless], [revoke], [grant, nameless],
                                [(3, at(0), 9, "revoke", 90), (4, None, 9, "grant", 90)]]):
        step(spark.createDataFrame(events, GRANTS), n)
    assert rows(store.current("ledger"), "user_id", "grant_event_id", "status")[0] == (
        7, 1, "revoked")
    assert [(r[0], r[1]) for r in rows(store.current("ledger"), "user_id", "status")] == [
        (7, "revoked"), (8, "active")]


def test_a_late_grant_takes_the_place_of_a_later_one(spark, rows):
    store = jobs.ledger_store(spark, scratch(spark, "l"), full_every=2)
    step = jobs.entitlement_step(store)
    events = [(5, at(5), 7, "grant", 71), (1, at(1), 7, "grant", 70), (9, at(9), 7, "revoke", 71),
              (3, at(3), 7, "revoke", 70), (2, at(2), 7, "grant", 71)]
    for n, event in enumerate(events):
        step(spark.createDataFrame([event], GRANTS), n)
    assert rows(store.current("ledger")) == rows(
        entitlement_ledger(spark.createDataFrame(events, GRANTS)))


EVENTS = "event_id long, ts timestamp_ntz, event_type string, capture_id string, order_id string"
PAYMENTS = ("id long, user_id long, provider_order_id string, provider_capture_id string, "
            "status string, paid_on timestamp_ntz, refunded_on timestamp_ntz, "
            "provider_payload_json string, notes string")


def delivered(seed):
    """Micro-batches: events out of order, some again in later batches, some without an id."""
    rng = random.Random(seed)
    kinds = [payments.COMPLETED, payments.COMPLETED, payments.DENIED, payments.REFUNDED, "OTHER"]
    made = []
    for i in range(60):
        n = rng.randrange(8)
        kind = rng.choice(kinds)
        made.append((i if i % 7 else None, at(rng.randrange(20)), kind,
                     rng.choice([f"C{n}", f"L{n}", None, ""]),
                     f"O{n}" if kind == payments.COMPLETED and rng.random() < 0.7 else None))
    rng.shuffle(made)
    batches = [made[i::3] for i in range(3)]
    return [b + rng.sample(made, 4) for b in batches]


@pytest.mark.parametrize("seed", [1])
def test_payment_job_over_batches_gives_the_batch_answer(spark, rows, seed):
    start = spark.createDataFrame(
        [(i, i % 3, f"O{i}", f"C{i}" if i % 2 else None, "created", None, None, "{}", "")
         for i in range(8)], PAYMENTS)
    batches = delivered(seed)
    every = once(spark.createDataFrame([e for b in batches for e in b], EVENTS)
                 .withColumn("payload", F.lit(None).cast("string")))
    store = jobs.payment_store(spark, scratch(spark, "p"), start, full_every=2)
    step = jobs.payment_step(store)
    for n, events in enumerate(batches):
        step(spark.createDataFrame(events, EVENTS), n)
    want = payments.payment_state(every, start)
    assert rows(store.current("payments")) == rows(want)
    assert rows(store.current("actions")) == rows(payments.classify_actions(every, start))
    moves = payments.match_payments(every, start).join(
        start.select(F.col("id").alias("payment_id"), "user_id"), "payment_id").select(
        "event_id", "ts", "user_id", "payment_id",
        F.when(F.col("event_type") == payments.COMPLETED, "grant")
        .when(F.col("event_type") == payments.REFUNDED, "revoke").alias("kind"))
    assert rows(store.current("ledger")) == rows(entitlement_ledger(moves))


def chained_payments(spark):
    """Payments of user 1 lead to those of user 2 by an order id they share; user 3 stands apart."""
    return spark.createDataFrame(
        [(1, 1, "O1", None, "created", None, None, "{}", ""),
         (2, 1, "O2", "C2", "created", None, None, "{}", ""),
         (3, 2, "O2", None, "created", None, None, "{}", ""),
         (4, 2, "O4", "C4", "created", None, None, "{}", ""),
         (5, 3, "O5", "C5", "created", None, None, "{}", "")], PAYMENTS)


def completions(spark, *numbers):
    return spark.createDataFrame([(n, datetime(2024, 1, 1, 0, n), payments.COMPLETED, f"L{n}",
                                   f"O{n}") for n in numbers], EVENTS)


def test_a_batch_reads_each_payment_it_touches_once(spark, rows, monkeypatch):
    start = chained_payments(spark)
    store = jobs.payment_store(spark, scratch(spark, "p"), start)
    read, current = [], store.current

    def counted(name, before=None, keys=None):
        found = current(name, before, keys)
        if name == "origins":
            read.extend(r["id"] for r in found.select("id").collect())
        return found

    monkeypatch.setattr(store, "current", counted)
    jobs.payment_step(store)(completions(spark, 1), 0)
    monkeypatch.undo()
    assert sorted(read) == [1, 2, 3, 4]
    every = completions(spark, 1).withColumn("payload", F.lit(None).cast("string"))
    assert rows(store.current("payments")) == rows(payments.payment_state(every, start))


def test_names_of_one_hash_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(jobs, "_named", lambda prefix, column: F.when(
        F.col(column).isNotNull(), F.lit(7).cast("bigint")))
    start = chained_payments(spark)
    store = jobs.payment_store(spark, scratch(spark, "p"), start)
    step = jobs.payment_step(store)
    step(completions(spark, 1, 4), 0)
    step(completions(spark, 2, 5), 1)
    every = completions(spark, 1, 2, 4, 5).withColumn("payload", F.lit(None).cast("string"))
    assert rows(store.current("payments")) == rows(payments.payment_state(every, start))


def test_the_first_whole_tables_look_nothing_up(spark, rows, monkeypatch):
    store = Store(spark, scratch(spark, "s"), {"a": Table(STATE, ["k"])})
    frame = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], STATE)
    monkeypatch.setattr(store, "current", None)
    store.seed(a=frame)
    monkeypatch.undo()
    assert rows(store.current("a")) == rows(frame)


def test_notes_and_payloads_are_those_of_the_last_change(spark):
    start = spark.createDataFrame([(1, 5, "O1", "X", "created", None, None, "{}", "")], PAYMENTS)

    def after(kinds):
        got = payments.payment_state(events_of(spark, *kinds).withColumn(
            "payload", F.concat(F.lit("p"), "event_id")), start).first()
        return got["notes"], got["provider_payload_json"]

    assert after("CC") == ("Marked captured from webhook.", "p0")
    assert after("CDCC") == ("Marked captured from webhook.", "p2")
    assert after("CD") == ("Capture denied webhook received.", "p1")
    assert after("CRRC"[:3]) == ("Refund webhook received.", "p2")


STATE = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_what_was_not_published_is_not_read(spark, rows):
    store = Store(spark, scratch(spark, "s"), {"a": Table(STATE, ["k"]), "b": Table(STATE, ["k"])},
                  full_every=3)
    frame = lambda *r: spark.createDataFrame(list(r), STATE)
    store.seed(a=frame((1, "x"), (2, "y")))
    store.commit(0, {"a": frame((1, "z")), "b": frame((9, "q"))})
    store._write("a", frame((1, "lost"), (3, "lost")).withColumn("_gone", F.lit(False)), 1)
    assert rows(store.current("a")) == [(1, "z"), (2, "y")]
    store.commit(1, {"a": Change(frame((2, "w")), frame((2, ""), (1, "")).select("k"))})
    store.commit(1, {"a": frame((2, "again"))})
    assert rows(store.current("a")) == [(2, "w")]
    assert rows(store.current("a", before=1)) == [(1, "z"), (2, "y")]
    assert rows(store.current("a", keys=frame((2, ""), (5, "")).select("k"))) == [(2, "w")]
    assert rows(store.current("b")) == [(9, "q")]


def test_old_folders_are_removed(spark, rows):
    store = Store(spark, scratch(spark, "s"), {"a": Table(STATE, ["k"])}, full_every=2)
    for n in range(9):
        store.commit(n, {"a": spark.createDataFrame([(n % 2, str(n))], STATE)})
        assert rows(store.current("a"))[n % 2 if n else 0][1] == str(n)
    assert store.batches() == [6, 7, 8]
    assert len(store._names("a")) <= 4
    assert rows(store.current("a", before=8)) == [(0, "6"), (1, "7")]


def payment_row(**values):
    return {"id": 1, "user_id": 5, "provider_order_id": "O1", "provider_capture_id": None,
            "status": "created", "paid_on": None, "refunded_on": None, **values}


def events_of(spark, *kinds):
    names = {"C": payments.COMPLETED, "D": payments.DENIED, "R": payments.REFUNDED}
    return spark.createDataFrame(
        [(i, f"2024-01-01 0{i}:00:00", names[k], "X", "O1" if k == "C" else None)
         for i, k in enumerate(kinds)],
        "event_id long, ts string, event_type string, capture_id string, order_id string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("kinds, status, paid, refunded, strict_status", [
    ("C", "captured", 0, None, "captured"),
    ("CC", "captured", 0, None, "captured"),
    ("RC", "captured", 1, None, "captured"),  # no payment known by capture id yet
    ("CRC", "captured", 2, 1, "refunded"),
    ("CDC", "captured", 2, None, "captured"),
    ("CR", "refunded", 0, 1, "refunded"),
    ("CRRD", "failed", 0, 2, "refunded"),
    ("D", "created", None, None, "created"),
])
def test_payment_moves(spark, kinds, status, paid, refunded, strict_status):
    start = spark.createDataFrame([payment_row()], "id long, user_id long, provider_order_id string, "
                                  "provider_capture_id string, status string, "
                                  "paid_on timestamp_ntz, refunded_on timestamp_ntz")
    got = payments.payment_state(events_of(spark, *kinds), start).first()
    hours = [None if got[c] is None else got[c].hour for c in ("paid_on", "refunded_on")]
    assert (got["status"], *hours) == (status, paid, refunded)
    assert got["provider_capture_id"] == ("X" if "C" in kinds else None)
    strict = payments.payment_state(events_of(spark, *kinds), start, strict=True).first()
    assert strict["status"] == strict_status


def test_without_learning_a_refund_by_capture_id_finds_nothing(spark):
    start = spark.createDataFrame([payment_row()], "id long, user_id long, provider_order_id string, "
                                  "provider_capture_id string, status string, "
                                  "paid_on timestamp_ntz, refunded_on timestamp_ntz")
    got = payments.payment_state(events_of(spark, "C", "R"), start, learn=False).first()
    assert (got["status"], got["provider_capture_id"]) == ("captured", None)
