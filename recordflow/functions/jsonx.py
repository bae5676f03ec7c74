"""JSON held in text columns: parsing with defaults, payload extraction, link lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordflow.functions.text import _col, bind, last_segment

# The shape of the payment provider's payloads.
CAPTURE_DDL = (
    "status string, payer struct<email_address: string>, "
    "purchase_units array<struct<payments: struct<captures: array<struct<"
    "id: string, create_time: string, amount: struct<value: string>, "
    "seller_receivable_breakdown: struct<paypal_fee: struct<value: string>, "
    "net_amount: struct<value: string>>>>>>>"
)
WEBHOOK_DDL = (
    "event_type string, resource struct<id: string, "
    "links: array<struct<rel: string, href: string>>>"
)


def json_or_empty(c, empty: str = "{}") -> Column:
    """JSON text of a struct, array or map; NULL and empty collections become ``empty``."""
    text = F.to_json(_col(c))
    return F.when(text.isNull() | text.isin("{}", "[]"), F.lit(empty)).otherwise(text)


def _checked(value: Column, use) -> Column:
    """``use(parsed, whole)``: the text parsed once as the first of two items of a list, and whether
    it is one well-formed JSON value.

    The parser stops after the first value and ignores what follows. The second item is a hash of
    the text: where the text holds anything but one value, that item is not where it should be.
    """
    mark = F.hex(F.xxhash64(value))
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit(',"'), mark, F.lit('"]')))
    return bind(F.struct(listed.alias("doc"), mark.alias("mark")), lambda s: use(
        s["doc"], F.coalesce(F.try_variant_get(s["doc"], "$[1]", "string") == s["mark"], F.lit(False))))


def is_json(c) -> Column:
    """True where the text is one well-formed JSON value (a literal null included)."""
    return _checked(_col(c), lambda doc, whole: whole)


def json_parse_or(c, ddl: str, default: Column | None = None) -> Column:
    """Parse to ``ddl``; empty or malformed text gives the default, a valid null stays NULL."""
    fallback = F.lit(None).cast(ddl) if default is None else default
    return _checked(_col(c), lambda doc, whole: F.when(
        whole, F.try_variant_get(doc, "$[0]", ddl)).otherwise(fallback))


def capture_fields(payload) -> Column:
    """Status, payer email and first-capture details of an order response, each optional."""

    def fields(doc: Column) -> Column:
        first = F.get(F.get(doc["purchase_units"], 0)["payments"]["captures"], 0)
        breakdown = first["seller_receivable_breakdown"]
        return F.struct(
            F.upper(F.coalesce(doc["status"], F.lit(""))).alias("status"),
            F.nullif(doc["payer"]["email_address"], F.lit("")).alias("payer_email"),
            first["id"].alias("capture_id"),
            first["create_time"].alias("create_time"),
            first["amount"]["value"].alias("gross"),
            breakdown["paypal_fee"]["value"].alias("fee"),
            breakdown["net_amount"]["value"].alias("net"),
        )

    return bind(F.from_json(_col(payload), CAPTURE_DDL), fields)


def first_link(links, rel: str, with_target: bool = False) -> Column:
    """href of the first link with this rel; ``with_target`` skips links naming nothing."""

    def wanted(link):
        hit = link["rel"] == rel
        return hit & last_segment(link["href"]).isNotNull() if with_target else hit

    return F.get(F.filter(_col(links), wanted), 0)["href"]


def webhook_fields(payload) -> Column:
    """Event type, capture id and the order id behind the first usable 'up' link."""

    def fields(doc: Column) -> Column:
        return F.struct(
            doc["event_type"].alias("event_type"),
            F.nullif(doc["resource"]["id"], F.lit("")).alias("capture_id"),
            last_segment(first_link(doc["resource"]["links"], "up", with_target=True))
            .alias("order_id"),
        )

    return bind(F.from_json(_col(payload), WEBHOOK_DDL), fields)
