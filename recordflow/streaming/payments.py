"""Payment events: matching, state, actions, capture responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.functions.jsonx import capture_fields
from recordflow.functions.text import falsy_or
from recordflow.operators.agg import entered_since, transitions
from recordflow.operators.join import first_per_key, left_unique
from recordflow.session import materialize

# Event types and the payment status each leads to.
COMPLETED = "PAYMENT.CAPTURE.COMPLETED"
DENIED = "PAYMENT.CAPTURE.DENIED"
REFUNDED = "PAYMENT.CAPTURE.REFUNDED"
STATUS_OF = {COMPLETED: "captured", DENIED: "failed", REFUNDED: "refunded"}

# Notes left on a payment by the event that last changed it.
EVENT_NOTES = {COMPLETED: "Marked captured from webhook.",
               DENIED: "Capture denied webhook received.",
               REFUNDED: "Refund webhook received."}

# Notes left on a payment by a capture response.
CAPTURED_NOTE = "Order captured successfully."
NOT_COMPLETED_NOTE = "Capture returned non-completed status: "


def match_payments(events: DataFrame, payments: DataFrame, learn: bool = True) -> DataFrame:
    """Events with the ``payment_id`` they mean, NULL where none.

    An event finds its payment by capture id; a completion with a capture id also by order id.
    With ``learn``, such a completion gives its capture id to a payment that had none, so that
    later denials and refunds find it too (a capture id belongs to one order).

    ``events``: event_id, ts, event_type, capture_id, order_id.
    """
    named = F.nullif(F.col("capture_id"), F.lit(""))
    events = events.withColumn("capture_id", named)
    at = F.struct("ts", "event_id")
    known = (first_per_key(payments, "provider_capture_id", "id", "_pid")
             .select(F.col("_k__pid").alias("capture_id"), "_pid",
                     F.lit(None).cast(events.select(at.alias("a")).schema["a"].dataType)
                     .alias("_since")))
    orders = first_per_key(payments, "provider_order_id", "id", "_oid").withColumnRenamed(
        "_k__oid", "order_id")
    captures = known
    if learn:
        bare = payments.filter("provider_capture_id is null").select(F.col("id").alias("_oid"))
        learned = (events.filter((F.col("event_type") == COMPLETED) & named.isNotNull())
                   .join(known.select("capture_id"), "capture_id", "left_anti")
                   .join(orders.join(bare, "_oid", "left_semi"), "order_id")
                   .groupBy(F.col("_oid").alias("_pid")).agg(
                       F.min_by("capture_id", at).alias("capture_id"), F.min(at).alias("_since"))
                   .groupBy("capture_id").agg(F.min_by("_pid", "_since").alias("_pid"),
                                              F.min("_since").alias("_since")))
        captures = known.unionByName(learned)
    by_capture = F.when(F.col("_since").isNull() | (F.col("_since") < at), F.col("_pid"))
    by_order = F.when((F.col("event_type") == COMPLETED) & F.col("capture_id").isNotNull(),
                      F.col("_oid"))
    found = left_unique(events, captures, [("capture_id", "capture_id")], ["_pid", "_since"])
    found = left_unique(found, orders, [("order_id", "order_id")], ["_oid"])
    return (found.withColumn("payment_id", F.when(F.col("event_type").isin(*STATUS_OF),
                                                  F.coalesce(by_capture, by_order)))
            .drop("_pid", "_since", "_oid"))


def payment_state(events: DataFrame, payments: DataFrame, strict: bool = False,
                  learn: bool = True, matched: DataFrame | None = None) -> DataFrame:
    """Payments after all events, in (ts, event_id) order.

    A completion captures a payment that is not captured yet and sets ``paid_on``; a denial
    fails it; a refund refunds it and sets ``refunded_on``. A completion after a refund captures
    again; with ``strict`` a refunded payment takes no further events. Events without a payment
    change nothing. Where payments have ``notes``, and ``provider_payload_json`` with events that
    have ``payload``, the event that last changed a payment leaves its own. ``matched`` are events
    matched before.
    """
    hits = match_payments(events, payments, learn) if matched is None else matched
    hits = hits.filter(F.col("payment_id").isNotNull())
    at = F.struct("ts", "event_id")
    if strict:
        ends = hits.filter(F.col("event_type") == REFUNDED).groupBy("payment_id").agg(
            F.min(at).alias("_end"))
        over = payments.filter("status = 'refunded'").select(F.col("id").alias("payment_id"))
        hits = (hits.join(over, "payment_id", "left_anti").join(ends, "payment_id", "left")
                .filter(F.col("_end").isNull() | (at <= F.col("_end"))))
    kind = F.col("event_type")
    payloads = "payload" in hits.columns and "provider_payload_json" in payments.columns
    # What follows reads the events several times; they are matched once.
    hits = materialize(hits.select("payment_id", "ts", "event_id", "event_type", "capture_id",
                                   *(["payload"] if payloads else [])), "payment-events")
    state, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, status in STATUS_OF.items():
        state = F.when(kind == name, F.lit(status)).otherwise(state)
        note = F.when(kind == name, F.lit(EVENT_NOTES[name])).otherwise(note)
    # Largest refund time, and the first completion's capture id (by the least time, negated).
    moves = transitions(
        hits.withColumn("_status", state), "payment_id", "ts", "event_id", "_status", "captured",
        extras={"_refunded": F.when(kind == REFUNDED, F.col("ts")),
                "_capture": F.when(kind == COMPLETED, F.struct(
                    (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"),
                    (-F.col("event_id")).alias("i"), "capture_id"))},
        carry={"note": note, **({"payload": F.col("payload")} if payloads else {})})
    after = moves.withColumnRenamed("payment_id", "id")
    values = {
        "status": F.coalesce("last_state", F.col("status")),
        "paid_on": F.coalesce(entered_since("status", "captured"), F.col("paid_on")),
        "refunded_on": F.coalesce("_refunded", F.col("refunded_on")),
    }
    if learn:
        values["provider_capture_id"] = F.coalesce(F.col("provider_capture_id"),
                                                   F.col("_capture.capture_id"))
    # Completions of a captured payment change nothing, so its last change is the last entry:
    # a later event's, or else the first event's, unless the payment was captured before all.
    was = F.coalesce(F.col("status") == "captured", F.lit(False))
    changed = (F.when(F.col("last_state") != "captured", F.col("last"))
               .when(F.col("entered").isNotNull(), F.col("entered"))
               .when((F.col("first_state") == "captured") & ~was, F.col("first")))
    if "notes" in payments.columns:
        values["notes"] = F.coalesce(changed["note"], F.col("notes"))
    if payloads:
        values["provider_payload_json"] = F.coalesce(changed["payload"],
                                                     F.col("provider_payload_json"))
    return payments.join(after, "id", "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in payments.columns])


def classify_actions(events: DataFrame, payments: DataFrame, learn: bool = True,
                     matched: DataFrame | None = None) -> DataFrame:
    """What each event led to: (event_id, ok, action, reason)."""
    kind = F.col("event_type")
    hit = match_payments(events, payments, learn) if matched is None else matched
    completed = kind == COMPLETED
    lost = F.when(F.col("capture_id").isNull(), "missing_capture_id").when(
        F.col("payment_id").isNull(), "payment_not_found")
    reason = F.when(completed, lost).when(~F.coalesce(kind.isin(*STATUS_OF), F.lit(False)),
                                          "event_not_used")
    action = (F.when(completed & lost.isNull(), "granted").when(kind == DENIED, "marked_failed")
              .when(kind == REFUNDED, "revoked_after_refund").otherwise("ignored"))
    return hit.select("event_id", (~completed | lost.isNull() | kind.isNull()).alias("ok"),
                      action.alias("action"), reason.alias("reason"))


def apply_captures(payments: DataFrame, responses: DataFrame) -> DataFrame:
    """Store order responses on their payments.

    ``responses``: order_id (one row per order), payload, arrived_on. COMPLETED captures the
    payment with its amounts: no gross keeps the earlier one, no fee or net is 0. Anything else
    fails it. ``paid_on`` is the capture's own time, or the arrival where it has none.
    """
    got = responses.select(F.col("order_id").alias("provider_order_id"), "payload", "arrived_on",
                           capture_fields("payload").alias("_r"))
    done = F.coalesce(F.col("_r.status") == "COMPLETED", F.lit(False))
    failed = F.col("payload").isNotNull() & ~done

    def amount(field: str, prior):
        return falsy_or(F.nullif(F.col(f"_r.{field}"), F.lit("")).try_cast("double"), prior, 0.0)

    def given(new, old: str):
        return F.when(done, new).otherwise(F.col(old))

    values = {
        "provider_capture_id": given(F.col("_r.capture_id"), "provider_capture_id"),
        "payer_email": given(F.coalesce("_r.payer_email", F.col("payer_email")), "payer_email"),
        "gross_amount": given(amount("gross", F.coalesce("gross_amount", F.lit(0.0))),
                              "gross_amount"),
        "fee_amount": given(amount("fee", 0.0), "fee_amount"),
        "net_amount": given(amount("net", 0.0), "net_amount"),
        "status": F.when(done, "captured").when(failed, "failed").otherwise(F.col("status")),
        "paid_on": given(F.coalesce(F.col("_r.create_time").try_cast("timestamp_ntz"),
                                    F.col("arrived_on")), "paid_on"),
        "provider_payload_json": F.coalesce("payload", F.col("provider_payload_json")),
        "notes": F.when(done, CAPTURED_NOTE).when(
            failed, F.concat(F.lit(NOT_COMPLETED_NOTE),
                             F.coalesce("_r.status", F.lit("")))).otherwise(F.col("notes")),
    }
    return payments.join(got, "provider_order_id", "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in payments.columns])
