"""Filters, projections, paging and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import join, select
from recordflow.plans.registry import query
from recordflow.schemas import HIDDEN


@query("where_all", """
    SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def where_all(t):
    return select.where_all(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


def _flagged_labels(t):
    flag = F.when(F.col("toxic") == 0, F.col("quality") == 1)
    return t.labels.withColumn("is_active", flag)


@query("active_rows", """
    SELECT doc_id, quality, toxic, true AS is_active FROM labels
    WHERE toxic = 0 AND quality = 1""")
def active_rows(t):
    return select.active(_flagged_labels(t))


@query("include_inactive", """
    SELECT doc_id, quality, toxic, CASE WHEN toxic = 0 THEN quality = 1 END AS is_active
    FROM labels""")
def include_inactive(t):
    return select.active(_flagged_labels(t), include_inactive=True)


@query("where_expr", """
    SELECT * FROM lineitem
    WHERE (l_quantity > 30 AND l_discount >= 0.05) OR NOT (l_returnflag <> 'R')""")
def where_expr(t):
    return select.where_expr(
        t.lineitem, "(l_quantity > 30 AND l_discount >= 0.05) OR NOT (l_returnflag <> 'R')")


@query("keyed_rows", "SELECT * FROM customer WHERE c_custkey > 0")
def keyed_rows(t):
    return select.keyed_rows(t.customer, "c_custkey")


@query("keyed_rows_text", "SELECT * FROM part WHERE p_name <> ''")
def keyed_rows_text(t):
    return select.keyed_rows(t.part, "p_name")


@query("exclude_self", "SELECT * FROM part WHERE p_partkey <> 7")
def exclude_self(t):
    return select.exclude(t.part, "p_partkey", 7)


@query("project_columns", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def project_columns(t):
    return select.project(t.lineitem, ["l_orderkey", "l_extendedprice"])


@query("visible_columns", """
    SELECT c_custkey AS id, c_name AS first_name, c_mktsegment AS account_status FROM customer""")
def visible_columns(t):
    users = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("account_status"),
        F.sha2("c_name", 256).alias("password"), F.col("c_name").alias("google_sub"))
    return select.visible(users, HIDDEN["auth_user"])


@query("lookup_batch", """
    SELECT e.k AS o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderkey IS NOT NULL AS found
    FROM (SELECT DISTINCT event_id * 2 AS k FROM events) e
    LEFT JOIN orders o ON o.o_orderkey = e.k""")
def lookup_batch(t):
    wanted = t.events.select((F.col("event_id") * 2).alias("o_orderkey")).distinct()
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return select.lookup_all(wanted, orders, "o_orderkey")


@query("ordered_ascending", "SELECT p_size, p_partkey, p_name FROM part ORDER BY 1, 2")
def ordered_ascending(t):
    return select.ordered(t.part.select("p_size", "p_partkey", "p_name"), ["p_size", "p_partkey"])


@query("ordered_descending", """
    SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey""")
def ordered_descending(t):
    return select.ordered(t.orders.select("o_orderkey", "o_orderdate"),
                          ["-o_orderdate", "o_orderkey"])


@query("first_row", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_row(t):
    return select.first_row(t.orders, ["-o_totalprice", "o_orderkey"])


@query("page_of_rows", """
    SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 300""")
def page_of_rows(t):
    return select.page(t.orders, ["-o_orderdate", "o_orderkey"], start=300)


@query("page_deep", """
    SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 1200""")
def page_deep(t):
    return select.Paged(t.orders, ["-o_orderdate", "o_orderkey"]).page(1200)


@query("page_after_key", "SELECT * FROM orders WHERE o_orderkey > 400 ORDER BY 1 LIMIT 100")
def page_after_key(t):
    return select.page_after(t.orders, "o_orderkey", 400)


@query("page_info", """
    SELECT count(*) AS total, true AS has_previous, count(*) > 400 AS has_next FROM orders""")
def page_info(t):
    return select.page_info(t.orders, start=300)


@query("inner_join", """
    SELECT o_orderkey, o_totalprice, c_custkey, c_name
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    return join.inner(t.orders, t.customer, on).select(
        "o_orderkey", "o_totalprice", "c_custkey", "c_name")


@query("theta_join", """
    SELECT n_name, s_suppkey, s_acctbal FROM supplier JOIN nation
    ON s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000""")
def theta_join(t):
    joined = join.theta(t.supplier, t.nation, "s_acctbal > n_regionkey * 1000",
                        on=[("s_nationkey", "n_nationkey")])
    return joined.select("n_name", "s_suppkey", "s_acctbal")


@query("theta_join_small", """
    SELECT s_suppkey, r_regionkey FROM supplier JOIN region
    ON s_acctbal >= r_regionkey * 2000 AND s_acctbal < r_regionkey * 2000 + 2500""")
def theta_join_small(t):
    bands = t.region.select("r_regionkey", (F.col("r_regionkey") * 2000).alias("low"),
                            (F.col("r_regionkey") * 2000 + 2500).alias("high"))
    return join.band_join(t.supplier, "s_acctbal", bands, "low", "high").select(
        "s_suppkey", "r_regionkey")


@query("band_join", """
    SELECT o_orderkey, n_nationkey FROM orders JOIN nation
    ON o_totalprice >= n_nationkey * 20000 AND o_totalprice < n_nationkey * 20000 + 30000""")
def band_join(t):
    bands = t.nation.select("n_nationkey", (F.col("n_nationkey") * 20000).alias("low"),
                            (F.col("n_nationkey") * 20000 + 30000).alias("high"))
    return join.band_join(t.orders, "o_totalprice", bands, "low", "high").select(
        "o_orderkey", "n_nationkey")


@query("owned_rows", """
    SELECT l.* FROM lineitem l
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'
        AND o_custkey IN (SELECT c_custkey FROM customer
                          WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0))""")
def owned_rows(t):
    customers = t.customer.withColumn("is_active", F.col("c_acctbal") > 0)
    orders = t.orders.filter("o_orderstatus <> 'P'")
    chain = [join.Hop(orders, "l_orderkey", "o_orderkey"),
             join.Hop(customers, "o_custkey", "c_custkey")]
    return join.owned(t.lineitem, chain, "c_mktsegment", "BUILDING")


@query("without_child", """
    SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def without_child(t):
    return join.without_child(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


def _orders_as_projects(t):
    return t.orders.withColumn("is_active", F.col("o_orderstatus") == "O")


@query("without_active_child", """
    SELECT * FROM customer WHERE NOT EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def without_active_child(t):
    return join.without_child(t.customer, "c_custkey", _orders_as_projects(t), "o_custkey")


@query("without_any_child", """
    SELECT * FROM customer WHERE NOT EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def without_any_child(t):
    return join.without_child(t.customer, "c_custkey", _orders_as_projects(t), "o_custkey",
                              active_only=False)


def _orders_as_entitlements(t):
    status = F.when(F.col("o_orderstatus") == "F", "active").otherwise("revoked")
    return t.orders.select(
        F.col("o_custkey").alias("user_id"), F.lit("lifetime_access").alias("code"),
        status.alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_active"))


@query("entitled_users", """
    SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
        AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def entitled_users(t):
    return join.entitled(t.customer, "c_custkey", _orders_as_entitlements(t), "user_id",
                         "lifetime_access")


@query("entitled_users_any_row", """
    SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
        AND o_orderstatus = 'F')""")
def entitled_users_any_row(t):
    return join.entitled(t.customer, "c_custkey", _orders_as_entitlements(t), "user_id",
                         "lifetime_access", require_active_row=False)


@query("linked_counts", """
    SELECT n_nationkey, n_name, n_regionkey, count(s_suppkey) AS n_children
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def linked_counts(t):
    return join.linked(t.nation, "n_nationkey", t.supplier, "s_nationkey")


@query("with_children", """
    WITH placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1
                    AS pos FROM orders),
    lists AS (SELECT o_custkey, pos // 8 AS part,
                     string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY pos) AS orders
              FROM placed GROUP BY ALL)
    SELECT c_custkey, coalesce(part, 0) AS part, coalesce(orders, '') AS orders
    FROM customer LEFT JOIN lists ON o_custkey = c_custkey""")
def with_children(t):
    nested = join.with_children(t.customer, "c_custkey", t.orders, "o_custkey", "o_orderkey",
                                ["o_orderkey", "o_orderstatus"], per_part=8)
    text = F.array_join(F.transform("children", lambda x: F.concat(
        x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ",")
    return nested.select("c_custkey", "part", text.alias("orders"))


@query("child_rows", """
    SELECT c_custkey, CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (
               PARTITION BY o_custkey ORDER BY o_orderkey) END AS position, o_orderkey, o_orderstatus
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def child_rows(t):
    rows = join.child_rows(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey",
                           "o_orderkey", ["o_orderkey", "o_orderstatus"])
    return rows.select("c_custkey", "position", "child.*")


@query("band_join_uneven", """
    WITH bands AS (SELECT 0 AS band, 0.0 AS low, 1e9 AS high
        UNION ALL SELECT c_custkey + 1, c_custkey * 300.0, c_custkey * 300.0 + 1 + c_custkey % 900
        FROM customer)
    SELECT o_orderkey, band FROM orders JOIN bands ON o_totalprice >= low AND o_totalprice < high""")
def band_join_uneven(t):
    """One band over everything beside many narrow ones."""
    low = F.col("c_custkey") * 300.0
    bands = t.customer.select((F.col("c_custkey") + 1).alias("band"), low.alias("low"),
                              (low + 1 + F.col("c_custkey") % 900).alias("high"))
    wide = t.spark.sql("SELECT 0L AS band, 0D AS low, 1e9D AS high")
    return join.band_join(t.orders, "o_totalprice", wide.unionByName(bands), "low", "high").select(
        "o_orderkey", "band")


def key_number(column="props"):
    """The number in an event's properties."""
    return F.get_json_object(column, "$.k").cast("bigint")


@query("match_fallback", """
    WITH e AS (SELECT event_id, 'C' || json_extract_string(props, '$.k') AS capture_id,
                      'O' || event_id AS order_id FROM events),
    p AS (SELECT o_orderkey AS id, 'O' || o_orderkey AS provider_order_id,
                 CASE WHEN o_orderstatus = 'F' THEN 'C' || o_orderkey END AS provider_capture_id
          FROM orders)
    SELECT event_id, capture_id, order_id, coalesce(a.id, b.id) AS payment_id
    FROM e LEFT JOIN p a ON a.provider_capture_id = e.capture_id
           LEFT JOIN p b ON b.provider_order_id = e.order_id""")
def match_fallback(t):
    events = t.events.select(
        "event_id", F.concat(F.lit("C"), key_number().cast("string")).alias("capture_id"),
        F.concat(F.lit("O"), F.col("event_id").cast("string")).alias("order_id"))
    key = F.col("o_orderkey").cast("string")
    payments = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("O"), key).alias("provider_order_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), key))
        .alias("provider_capture_id"))
    return join.match_fallback(events, payments)


@query("match_priority", """
    WITH by_name AS (SELECT substr(c_name, 10) AS k, min(c_custkey) AS id FROM customer GROUP BY 1),
    by_nation AS (SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer
                  WHERE c_acctbal > 0 GROUP BY 1)
    SELECT s_suppkey, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS matched
    FROM supplier LEFT JOIN by_name a ON s_acctbal > 5000 AND a.k = substr(s_name, 10)
                  LEFT JOIN by_nation b ON b.k = s_nationkey""")
def match_priority(t):
    src = t.supplier.withColumn("sub", F.when(F.col("s_acctbal") > 5000,
                                              F.expr("substr(s_name, 10)")))
    dim = t.customer.withColumn("sub", F.expr("substr(c_name, 10)")).withColumn(
        "nation", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).select(
        "c_custkey", F.col("sub").alias("c_sub"), "nation")
    return join.match_priority(src, dim, [("sub", "c_sub"), ("s_nationkey", "nation")],
                               "c_custkey").select("s_suppkey", "matched")


@query("localized_labels", """
    WITH words AS (SELECT DISTINCT lang, source FROM documents WHERE lang <> 'en')
    SELECT doc_id, d.lang, CASE WHEN w.lang IS NULL THEN d.source
                                ELSE w.lang || ':' || w.source END AS label
    FROM documents d LEFT JOIN words w ON w.lang = d.lang AND w.source = d.source""")
def localized_labels(t):
    words = t.documents.filter("lang <> 'en'").select("lang", "source").distinct().withColumn(
        "target", F.concat("lang", F.lit(":"), "source"))
    return join.localize(t.documents, "source", "lang", words).select("doc_id", "lang", "label")
