"""Orders: what to ask the payment provider for, and the payments that its answers open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.functions.jsonx import first_link
from recordflow.functions.text import bind, falsy_or, money2, short_id, template
from recordflow.operators.change import assign_ids, insert_rows
from recordflow.operators.join import left_unique
from recordflow.operators.services import Outcome, _accepted, _check, _rejected

# Provider, currency of offers without one, and the note of a new payment.
PROVIDER, CURRENCY = "paypal", "EUR"
CREATED_NOTE = "Order created, awaiting buyer approval."
ANSWER_DDL = "id string, links array<struct<rel: string, href: string>>"


def order_requests(requests: DataFrame, users: DataFrame, offers: DataFrame) -> Outcome:
    """Requests: request_id, user_id, offer_code. The outcome's table holds the accepted ones
    with user, offer, amount and ``payload``, the order as JSON text. Offer codes are unique."""
    people = users.select(F.col("id").alias("_uid"), F.col("email").alias("payer_email"),
                          F.lit(True).alias("_known"))
    open_offers = offers.filter("is_active").select(
        F.col("code").alias("_code"), F.col("id").alias("offer_id"), F.col("name").alias("_title"),
        falsy_or("currency", CURRENCY, "").alias("currency"),
        F.col("price_amount").alias("gross_amount"))
    found = left_unique(requests, people, [("user_id", "_uid")], ["payer_email", "_known"])
    found = left_unique(found, open_offers, [("offer_code", "_code")],
                        ["offer_id", "_title", "currency", "gross_amount"])
    checked = _check(found, [("user_id", F.col("_known").isNull(), "user_not_found"),
                             ("offer_code", F.col("offer_id").isNull(), "offer_not_available")])
    unit = F.struct(
        template("offer-%s-user-%s", "offer_id", "user_id").alias("reference_id"),
        F.col("_title").alias("description"),
        F.struct(F.col("currency").alias("currency_code"), money2("gross_amount").alias("value"))
        .alias("amount"),
        F.col("user_id").cast("string").alias("custom_id"),
        F.concat(F.lit("inv-"), short_id(20, "user_id", "offer_id", "request_id"))
        .alias("invoice_id"))
    payload = F.to_json(F.struct(F.lit("CAPTURE").alias("intent"),
                                 F.array(unit).alias("purchase_units")))
    accepted = _accepted(checked).withColumn("payload", payload)
    return Outcome(accepted.drop("_known", "_title"), _rejected(checked))


def open_payments(payments: DataFrame, ordered: DataFrame, answers: DataFrame, now,
                  start_id: int) -> Outcome:
    """Add a payment for every answered order. ``answers``: request_id, answer (JSON text). One
    without an order id or an approval link is turned down."""
    joined = ordered.join(answers.select("request_id", "answer"), "request_id")

    def fields(doc):
        return F.struct(doc["id"].alias("order_id"),
                        first_link(doc["links"], "approve").alias("approve_url"))

    read = joined.withColumn("_got", bind(F.from_json("answer", ANSWER_DDL), fields))
    blank = [F.coalesce(F.col(f"_got.{c}"), F.lit("")) == "" for c in ("order_id", "approve_url")]
    checked = _check(read, [("answer", blank[0] | blank[1], "incomplete")])
    new = _accepted(checked).select(
        "request_id", "user_id", "offer_id", F.lit(PROVIDER).alias("provider"),
        F.col("_got.order_id").alias("provider_order_id"), "payer_email", "gross_amount",
        F.lit(0.0).alias("fee_amount"), F.lit(0.0).alias("net_amount"), "currency",
        F.lit("created").alias("status"), F.col("answer").alias("provider_payload_json"),
        F.lit(CREATED_NOTE).alias("notes"))
    new = assign_ids(new, "request_id", start_id).drop("request_id")
    kept = [c for c in new.columns if c in payments.columns]
    return Outcome(insert_rows(payments, new.select(*kept), now=now), _rejected(checked))
