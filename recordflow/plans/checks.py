"""Validation rules and reference audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions.text import slug_text
from recordflow.operators import quality as q
from recordflow.plans.registry import query
from recordflow.plans.rollups import SLUG_SQL
from recordflow.schemas import INPUT_EDGES, Edge


@query("required_values", """
    SELECT doc_id, length(trim(text)) = 0 OR length(trim(coalesce(source, ''))) = 0 AS is_bad
    FROM documents""")
def required_values(t):
    checked = q.validate(t.documents, [q.required("text"), q.required("source")])
    return checked.select("doc_id", (F.size("errors") > 0).alias("is_bad"))


@query("vocabulary_values", """
    SELECT 'o_orderstatus' AS field, 'not_allowed' AS message, count(*) AS n
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def vocabulary_values(t):
    return q.violation_counts(q.validate(t.orders, [q.one_of("o_orderstatus", ["F", "O"])]))


@query("integer_range", """
    SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 29 THEN NULL ELSE 'invalid' END AS error
    FROM part""")
def integer_range(t):
    checked = q.validate(t.part, [q.int_range("p_size", 5, 30)])
    return checked.select("p_partkey", F.try_element_at("errors", F.lit("p_size")).alias("error"))


@query("float_range", """
    SELECT o_orderkey, CASE WHEN v IS NOT NULL AND v BETWEEN 0 AND 100000 AND NOT isnan(v)
                            THEN NULL ELSE 'invalid' END AS error
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'NaN'::DOUBLE
          ELSE o_totalprice END AS v FROM orders)""")
def float_range(t):
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(
        F.col("o_totalprice"))
    checked = q.validate(t.orders.withColumn("v", price), [q.float_range("v", 0.0, 100000.0)])
    return checked.select("o_orderkey", F.try_element_at("errors", F.lit("v")).alias("error"))


@query("unique_values", """
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name, p_brand, p_size) > 1
                           THEN 'duplicate' END AS error FROM part""")
def unique_values(t):
    flagged = q.flag_doubled(t.part, ["p_name", "p_brand", "p_size"])
    checked = q.validate(flagged, [q.unique("p_name", "is_doubled")])
    return checked.select("p_partkey", F.try_element_at("errors", F.lit("p_name")).alias("error"))


@query("email_shape", r"""
    SELECT page_id, NOT regexp_matches('user' || page_id || '@'
        || regexp_extract(url, '^https?://([^/]+)', 1),
        '^[A-Za-z0-9_+\-]+(\.[A-Za-z0-9_+\-]+)*@([A-Za-z0-9\-]+\.)+[A-Za-z]{2,}$') AS is_bad
    FROM pages""")
def email_shape(t):
    address = F.concat(F.lit("user"), F.col("page_id").cast("string"), F.lit("@"),
                       F.regexp_extract("url", "^https?://([^/]+)", 1))
    checked = q.validate(t.pages.withColumn("email", address), [q.email_shape("email")])
    return checked.select("page_id", (F.size("errors") > 0).alias("is_bad"))


@query("slug_shape", f"""
    SELECT p_partkey, NOT (v = {SLUG_SQL.format('v')} AND v <> '') AS is_bad
    FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN {SLUG_SQL.format('p_name')}
          ELSE p_name END AS v FROM part)""")
def slug_shape(t):
    value = F.when(F.col("p_size") > 25, slug_text("p_name")).otherwise(F.col("p_name"))
    checked = q.validate(t.part.withColumn("slug", value), [q.slug_shape("slug")])
    return checked.select("p_partkey", (F.size("errors") > 0).alias("is_bad"))


@query("maximum_length", """
    SELECT doc_id, length(text) > 2000 AS is_bad FROM documents""")
def maximum_length(t):
    checked = q.validate(t.documents, [q.max_length("text", 2000)])
    return checked.select("doc_id", (F.size("errors") > 0).alias("is_bad"))


_RULES_SQL = """
    SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 5 AND 29 THEN 'invalid' END AS e1,
           CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'not_allowed' END AS e2,
           CASE WHEN length(p_name) > 10 THEN 'too_long' END AS e3 FROM part"""


def _rules():
    return [q.int_range("p_size", 5, 30), q.one_of("p_brand", ["Brand#1", "Brand#2", "Brand#3"]),
            q.required("p_name"), q.max_length("p_name", 10)]


def _error_text():
    return F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")


@query("validate_rows", f"""
    SELECT p_partkey, concat_ws(',', 'p_size=' || e1, 'p_brand=' || e2, 'p_name=' || e3) AS errors
    FROM ({_RULES_SQL})""")
def validate_rows(t):
    return q.validate(t.part, _rules()).select("p_partkey", _error_text().alias("errors"))


@query("validate_first_error", f"""
    SELECT p_partkey, coalesce('p_size=' || e1, 'p_brand=' || e2, 'p_name=' || e3, '') AS errors
    FROM ({_RULES_SQL})""")
def validate_first_error(t):
    return q.validate(t.part, _rules(), mode="first").select(
        "p_partkey", _error_text().alias("errors"))


@query("split_valid", f"""
    SELECT p_partkey, coalesce(e1, e2, e3) IS NULL AS is_valid FROM ({_RULES_SQL})""")
def split_valid(t):
    good, bad = q.split_valid(q.validate(t.part, _rules()))
    return good.select("p_partkey", F.lit(True).alias("is_valid")).unionByName(
        bad.select("p_partkey", F.lit(False).alias("is_valid")))


@query("violation_counts", f"""
    SELECT field, message, count(*) AS n FROM (
        SELECT 'p_size' AS field, e1 AS message FROM ({_RULES_SQL})
        UNION ALL SELECT 'p_brand', e2 FROM ({_RULES_SQL})
        UNION ALL SELECT 'p_name', e3 FROM ({_RULES_SQL})) WHERE message IS NOT NULL GROUP BY 1, 2""")
def violation_counts(t):
    return q.violation_counts(q.validate(t.part, _rules()))


_AUDITED = INPUT_EDGES + [
    Edge("labels", "doc_id", "documents", "doc_id"),
    Edge("events", "user_id", "supplier", "s_suppkey"),
    Edge("events", "event_id", "customer", "c_custkey"),
]


def _edge_sql(edge: Edge) -> str:
    return f"""
    SELECT '{edge.child}.{edge.fk}->{edge.parent}.{edge.key}' AS edge,
           count(*) FILTER ({edge.fk} IS NOT NULL AND p IS NULL) AS orphans,
           count(*) FILTER ({edge.fk} IS NULL) AS nulls
    FROM (SELECT c.{edge.fk}, p.{edge.key} AS p FROM {edge.child} c
          LEFT JOIN {edge.parent} p ON p.{edge.key} = c.{edge.fk})"""


@query("foreign_key_audit", " UNION ALL ".join(_edge_sql(e) for e in _AUDITED))
def foreign_key_audit(t):
    names = {n for e in _AUDITED for n in (e.child, e.parent)}
    return q.fk_audit(t.some(names), _AUDITED)
