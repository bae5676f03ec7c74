"""Pushed events: accept or say why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.functions.jsonx import is_json

# Headers a pushed payment event must carry.
REQUIRED_HEADERS = ["PAYPAL-TRANSMISSION-ID", "PAYPAL-TRANSMISSION-TIME",
                    "PAYPAL-TRANSMISSION-SIG", "PAYPAL-CERT-URL", "PAYPAL-AUTH-ALGO"]


def with_reason(df: DataFrame, body: str = "body", headers: str = "headers",
                needed: list[str] | None = None) -> DataFrame:
    """Adds ``reason``: empty_body, missing_headers, invalid_json, or NULL for a good event.
    ``headers`` is a map column."""
    names = REQUIRED_HEADERS if needed is None else needed
    missing = F.lit(False)
    for name in names:
        missing = missing | (F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit("")) == "")
    empty = F.coalesce(F.col(body), F.lit("")) == ""
    return df.withColumn("reason", F.when(empty, "empty_body").when(missing, "missing_headers")
                         .when(~is_json(body), "invalid_json"))


def triage(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters with ``reason``); batch or streaming."""
    marked = with_reason(df, **options)
    return (marked.filter("reason is null").drop("reason"),
            marked.filter("reason is not null"))
