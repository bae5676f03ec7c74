"""Text, JSON, number and scoring functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import jsonx
from recordflow.functions import text as x
from recordflow.plans.reads import key_number
from recordflow.plans.registry import query

_WS = (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
       r"\x{3000}]")


def clean_sql(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


@query("clean_text", f"""
    SELECT doc_id, {clean_sql("chr(160) || chr(12288) || text || chr(8195) || chr(10)")} AS text
    FROM documents""")
def clean_text(t):
    padded = F.concat(F.lit("\u00a0\u3000"), "text", F.lit("\u2003\n"))
    return t.documents.select("doc_id", x.clean(padded).alias("text"))


@query("slugify", f"""
    SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-'),
           ''), 'project-' || substr(sha256(p_partkey::VARCHAR), 1, 8)) AS slug
    FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN ' -- ' ELSE p_name || ' & ' || p_type END
          AS v FROM part)""")
def slugify(t):
    name = F.when(F.col("p_size") < 10, " -- ").otherwise(
        F.concat("p_name", F.lit(" & "), "p_type"))
    return t.part.select("p_partkey", x.slugify(name, "p_partkey").alias("slug"))


@query("slugify_documents", f"""
    SELECT doc_id, trim(regexp_replace(lower({clean_sql('text')}), '[^a-z0-9]+', '-', 'g'), '-')
           AS slug FROM documents""")
def slugify_documents(t):
    return t.documents.select("doc_id", x.slug_text("text").alias("slug"))


@query("identifierify", """
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('__' || p_name || '_ _' || p_type),
           '[^a-z0-9_]+', '_', 'g'), '_{2,}', '_', 'g'), '_') AS name FROM part""")
def identifierify(t):
    name = F.concat(F.lit("__"), "p_name", F.lit("_ _"), "p_type")
    return t.part.select("p_partkey", x.identifierify(name).alias("name"))


@query("norm_email", """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN lower(c_name || '@Example.ORG') END AS email
    FROM customer""")
def norm_email(t):
    raw = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("\t "), "c_name",
                                                   F.lit("@Example.ORG "))).otherwise(" \n")
    return t.customer.select("c_custkey", x.norm_email(raw).alias("email"))


_KIND_SQL = """CASE event_type WHEN 'view' THEN ' Role ' WHEN 'click' THEN 'label'
    WHEN 'purchase' THEN 'testid' WHEN 'signup' THEN 'CSS' WHEN 'error' THEN 'xpath' END"""


@query("score_by_type", """
    SELECT event_id, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 95
           WHEN 'purchase' THEN 85 WHEN 'signup' THEN 40 ELSE 0 END AS score,
           CASE event_type WHEN 'view' THEN 'recommended' WHEN 'click' THEN 'recommended'
           WHEN 'purchase' THEN 'good' ELSE 'fragile' END AS label,
           CASE WHEN value >= 50 THEN 'error' WHEN event_type IN ('view', 'click', 'purchase')
           THEN 'ready' ELSE 'warning' END AS status FROM events""")
def score_by_type(t):
    graded = t.events.withColumn("q", x.score_by_type(F.expr(_KIND_SQL)))
    given = F.when(F.col("value") >= 50, "error")
    return graded.select("event_id", "q.score", "q.label",
                         x.status_by_score("q.score", given).alias("status"))


@query("falsy_or", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_discount = 0 THEN 0.5 ELSE l_discount END AS discount,
           CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END AS flag,
           CASE WHEN l_linenumber = 3 THEN 30000 ELSE l_linenumber END AS timeout
    FROM lineitem""")
def falsy_or(t):
    flag = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    line = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_linenumber"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        x.falsy_or("l_discount", 0.5, 0.0).alias("discount"),
        x.falsy_or(flag, "none", "").alias("flag"),
        x.falsy_or(line, 30000, 0).alias("timeout"))


@query("json_or_empty", """
    SELECT event_id, CASE WHEN value >= 10 THEN '{"k":' || json_extract(props, '$.k') || '}'
                          ELSE '{}' END AS doc,
           CASE WHEN value >= 10 THEN '["' || event_type || '"]' ELSE '[]' END AS items
    FROM events""")
def json_or_empty(t):
    big = F.col("value") >= 10
    doc = F.when(big, F.struct(key_number().alias("k")))
    items = F.when(big, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return t.events.select("event_id", jsonx.json_or_empty(doc).alias("doc"),
                           jsonx.json_or_empty(items, "[]").alias("items"))


@query("json_parse_or", """
    SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN NULL
           WHEN 'view' THEN -1 ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events""")
def json_parse_or(t):
    text = (F.when(F.col("event_type") == "error", F.concat("props", F.lit("}")))
            .when(F.col("event_type") == "signup", "null")
            .when(F.col("event_type") == "view", "").otherwise(F.col("props")))
    parsed = jsonx.json_parse_or(text, "struct<k: bigint>",
                                 F.struct(F.lit(-1).cast("bigint").alias("k")))
    return t.events.select("event_id", parsed["k"].alias("k"))


def capture_payload(with_net=True):
    """An order's capture response as JSON text: status, payer, amounts; open orders have no
    capture yet, and fully paid ones no fee."""
    paid = F.col("o_orderstatus") != "O"
    money = x.money2("o_totalprice")
    fee = F.when(F.col("o_orderstatus") == "P", F.struct(x.money2(
        F.col("o_totalprice") / 50).alias("value")))
    capture = F.struct(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("create_time"),
        F.struct(money.alias("value")).alias("amount"),
        F.struct(fee.alias("paypal_fee"), F.struct(money.alias("value")).alias("net_amount"))
        .alias("seller_receivable_breakdown"))
    none = F.array().cast("array<struct<id: string, create_time: string, amount: struct<value: "
                          "string>, seller_receivable_breakdown: struct<paypal_fee: struct<value: "
                          "string>, net_amount: struct<value: string>>>>")
    units = F.array(F.struct(F.struct(F.when(paid, F.array(capture)).otherwise(none)
                                      .alias("captures")).alias("payments")))
    status = F.when(paid, "completed").otherwise("PENDING")
    email = F.when(F.col("o_orderstatus") == "F",
                   F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")))
    return F.to_json(F.struct(status.alias("status"),
                              F.struct(email.alias("email_address")).alias("payer"),
                              units.alias("purchase_units")))


@query("json_extract", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS status,
           CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey || '@example.org' END AS payer_email,
           CASE WHEN o_orderstatus <> 'O' THEN 'C' || o_orderkey END AS capture_id,
           CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END
               AS create_time,
           CASE WHEN o_orderstatus <> 'O' THEN printf('%.2f', o_totalprice) END AS gross,
           CASE WHEN o_orderstatus = 'P' THEN printf('%.2f', o_totalprice / 50) END AS fee,
           CASE WHEN o_orderstatus <> 'O' THEN printf('%.2f', o_totalprice) END AS net
    FROM orders""")
def json_extract(t):
    got = t.orders.withColumn("payload", capture_payload()).withColumn(
        "f", jsonx.capture_fields("payload"))
    return got.select("o_orderkey", "f.*")


@query("first_link", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS approve,
           nullif(regexp_extract(rtrim(url, '/'), '[^/]*$'), '') AS up_id FROM pages""")
def first_link(t):
    links = F.array(
        F.struct(F.lit("self").alias("rel"), F.lit("x").alias("href")),
        F.struct(F.lit("up").alias("rel"), F.lit("//").alias("href")),
        F.struct(F.when(F.col("page_id") % 3 != 0, "approve").otherwise("other").alias("rel"),
                 F.col("url").alias("href")),
        F.struct(F.lit("up").alias("rel"), F.concat("url", F.lit("//")).alias("href")),
        F.struct(F.lit("approve").alias("rel"), F.lit(None).cast("string").alias("href")))
    listed = t.pages.withColumn("links", links)
    return listed.select("page_id", jsonx.first_link("links", "approve").alias("approve"),
                         x.last_segment(jsonx.first_link("links", "up", with_target=True))
                         .alias("up_id"))


@query("last_segment", """
    SELECT page_id, nullif(regexp_extract(rtrim(url, '/'), '[^/]*$'), '') AS segment
    FROM pages""")
def last_segment(t):
    return t.pages.select("page_id", x.last_segment("url").alias("segment"))


@query("money_text", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           printf('%.2f', l_extendedprice * l_discount) AS amount,
           printf('%.2f', l_quantity / 8) AS eighths FROM lineitem""")
def money_text(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        x.money2(F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
        x.money2(F.col("l_quantity") / 8).alias("eighths"))


@query("reference_text", """
    SELECT o_orderkey, 'offer-' || o_orderpriority || '-user-' || o_custkey AS reference,
           'inv-' || substr(sha256(o_orderkey || '|' || o_custkey), 1, 20) AS invoice
    FROM orders""")
def reference_text(t):
    return t.orders.select(
        "o_orderkey",
        x.template("offer-%s-user-%s", "o_orderpriority", "o_custkey").alias("reference"),
        F.concat(F.lit("inv-"), x.short_id(20, "o_orderkey", "o_custkey")).alias("invoice"))


@query("hours_minutes_seconds", """
    SELECT event_id, s // 3600 AS h, (s % 3600) // 60 AS m, s % 60 AS s,
           format('{:02d}:{:02d}:{:02d}', s // 3600, (s % 3600) // 60, s % 60) AS age
    FROM (SELECT event_id, floor(value * 1000)::BIGINT AS s FROM events)""")
def hours_minutes_seconds(t):
    seconds = F.col("value") * 1000
    return t.events.withColumn("p", x.hms(seconds)).select(
        "event_id", "p.h", "p.m", "p.s", x.hms_text(seconds).alias("age"))


@query("safe_ratio", """
    SELECT user_id, CASE WHEN b = 0 THEN 0.0 ELSE (a * 100)::DOUBLE / b END AS ratio
    FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value >= 40) AS a,
                 count(*) FILTER (value >= 40) AS b FROM events GROUP BY 1)""")
def safe_ratio(t):
    sums = t.events.groupBy("user_id").agg(
        F.count_if(F.expr("event_type = 'purchase' AND value >= 40")).alias("a"),
        F.count_if(F.expr("value >= 40")).alias("b"))
    return sums.select("user_id", x.safe_ratio("a", "b").alias("ratio"))


@query("megabytes", """
    SELECT doc_id, CASE WHEN n_chars * 400 > 524287 THEN n_chars * 400 // 1048576 END AS mb
    FROM documents""")
def megabytes(t):
    return t.documents.select("doc_id", x.mb(F.col("n_chars") * 400).alias("mb"))


_CLASSES = [("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[!@#$%^&*()]", 10),
            (r"""[~`\-_=+\[\]{}|;:''",.<>?/]""", 21)]
_OTHER = r"""[^a-zA-Z0-9!@#$%^&*()~`\-_=+\[\]{}|;:''",.<>?/]"""


def _class_sql(pattern: str, size: int) -> str:
    hits = f"regexp_extract_all(text, '{pattern}')"
    return (f"CASE WHEN len({hits}) = 0 THEN 0 "
            f"ELSE {size} + len(list_distinct({hits}[2:])) END")


@query("char_entropy", f"""
    SELECT doc_id, floor(n * ln(score) / 0.6931471805599453 * 100 + 0.5) / 100 AS entropy
    FROM (SELECT doc_id, length(text) AS n,
          {" + ".join(_class_sql(p, s) for p, s in [*_CLASSES, (_OTHER, 36)])}
          + len(regexp_extract_all(text, '{"|".join(p + "+" for p, _ in _CLASSES)}|{_OTHER}+'))
          AS score FROM documents WHERE text <> '')
    UNION ALL SELECT doc_id, 0.0 FROM documents WHERE text = '' OR text IS NULL""")
def char_entropy(t):
    return t.documents.select("doc_id", x.char_entropy("text").alias("entropy"))
