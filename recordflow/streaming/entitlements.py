"""Entitlement ledger: at most one active grant per user, revoked by its own payment's refund.

A grant is given by a completion when the user holds none; a refund of another payment does
nothing. So what a user holds depends on the order of all their events. The ledger is a chain: a
grant leads to the next refund of its payment, that one to the user's next completion. The chain is
followed by pointer doubling on event ids, so no task ever holds one user's history. An event that
is delivered several times counts once: its repeats would double the chain at every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.operators.number import next_match, placed_by_range
from recordflow.session import materialize
from recordflow.streaming.delivery import once

# What a grant entitles to, and why it was given and taken.
CODE = "lifetime_access"
GRANTED = "Granted after successful PayPal capture."
REVOKED = "Entitlement revoked after refund."

COLUMNS = ["user_id", "payment_id", "grant_event_id", "granted_on", "revoked_on", "status", "code",
           "reason"]
SCHEMA = ("user_id bigint, payment_id bigint, grant_event_id bigint, granted_on timestamp_ntz, "
          "revoked_on timestamp_ntz, status string, code string, reason string")


def entitlement_ledger(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Grants with their revocation time, NULL while active, their code and the reason of their
    last change.

    ``events``: event_id, ts, user_id, payment_id, kind ('grant' or 'revoke'; others are left
    out). Rows of one event id count once; rows without an id are told apart by their content. Rows
    without a time, user or payment are left out. ``held`` are ledger rows active before, which the
    events may revoke.
    """
    cols = ["user_id", "ts", "event_id", "kind", "payment_id"]
    steps = events.filter(F.col("kind").isin("grant", "revoke") & F.col("user_id").isNotNull()
                          & F.col("payment_id").isNotNull() & F.col("ts").isNotNull()).select(*cols)
    if held is not None:
        steps = steps.unionByName(held.filter("status = 'active'").select(
            "user_id", F.col("granted_on").alias("ts"), F.col("grant_event_id").alias("event_id"),
            F.lit("grant").alias("kind"), "payment_id"))
    return _chain(once(steps))


def _chain(steps: DataFrame) -> DataFrame:
    placed = placed_by_range(steps, ["user_id"], F.struct("ts", "event_id"))
    linked = next_match(placed, ["user_id", "payment_id"], F.col("kind") == "revoke", "_end")
    linked = materialize(next_match(linked, ["user_id"], F.col("kind") == "grant", "_next"),
                         "ledger-links")
    grants = linked.filter("kind = 'grant'")
    after_end = linked.filter("kind = 'revoke' and _next is not null").select(
        F.col("event_id").alias("_end_id"), F.col("_next.event_id").alias("to"))
    first = grants.groupBy(F.col("user_id").alias("_user")).agg(F.min("_order").alias("_first"))
    # ``to`` lies 2^i links ahead, ``reached`` marks the first 2^i grants of every chain. A grant
    # that is never revoked, or not followed by another, ends its chain and leads nowhere.
    hops = materialize(
        grants.select("user_id", F.col("event_id").alias("at"), F.col("_end.event_id").alias("_end_id"))
        .join(after_end, "_end_id", "left")
        .join(first.select("_user", F.col("_first.event_id").alias("_first_id")),
              F.col("user_id") == F.col("_user"))
        .select("at", "to", (F.col("at") == F.col("_first_id")).alias("reached")), "ledger-hops")
    while not hops.filter("reached and to is not null").isEmpty():
        far = hops.select(F.col("at").alias("to"), F.col("to").alias("_far"))
        met = hops.filter("reached and to is not null").select(
            F.col("to").alias("at"), F.lit(True).alias("_met")).distinct()
        hops = materialize(
            hops.join(far, "to", "left").join(met, "at", "left")
            .select("at", F.col("_far").alias("to"),
                    (F.col("reached") | F.col("_met").isNotNull()).alias("reached")), "ledger-hops")
    reached = hops.filter("reached").select(F.col("at").alias("event_id"))
    revoked = F.col("revoked_on").isNotNull()
    return (grants.join(reached, "event_id", "left_semi")
            .select("user_id", "payment_id", F.col("event_id").alias("grant_event_id"),
                    F.col("ts").alias("granted_on"), F.col("_end.ts").alias("revoked_on"))
            .withColumns({"status": F.when(revoked, "revoked").otherwise("active"),
                          "code": F.lit(CODE),
                          "reason": F.when(revoked, REVOKED).otherwise(GRANTED)}).select(*COLUMNS))
