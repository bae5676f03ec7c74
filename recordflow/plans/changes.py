"""Table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import change, users
from recordflow.plans.registry import query
from recordflow.plans.rollups import ELEMENT_STATUS_SQL
from recordflow.schemas import DEFAULTS, INPUT_EDGES, Edge

NOW = "2024-02-01 12:00:00"


@query("insert_rows", f"""
    SELECT p_partkey AS id, p_name AS name, 'ready' AS status, p_size AS sort_order,
           true AS is_active, TIMESTAMP '2000-01-01' AS modified_on FROM part WHERE p_size <= 25
    UNION ALL SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_name END, 'partial', 0,
           true, TIMESTAMP '{NOW}' FROM part WHERE p_size > 25""")
def insert_rows(t):
    base = t.part.filter("p_size <= 25").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.lit("ready").alias("status"), F.col("p_size").alias("sort_order"),
        F.lit(True).alias("is_active"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("modified_on"))
    new = t.part.filter("p_size > 25").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") <= 40, F.col("p_name")).alias("name"))
    return change.insert_rows(base, new, DEFAULTS["project_page"], now=NOW)


@query("assign_ids", """
    SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders""")
def assign_ids(t):
    return change.assign_ids(t.orders.select("o_orderkey"), "o_orderkey", 1000)


@query("patch_rows", """
    SELECT c.c_custkey, CASE WHEN o.k IS NULL OR o.k % 3 = 0 THEN c_name
                             ELSE 'n' || o.k END AS c_name,
           c_nationkey, CASE WHEN o.k % 2 = 0 THEN o.price ELSE c_acctbal END AS c_acctbal,
           CASE WHEN o.k IS NULL THEN c_mktsegment WHEN o.k % 5 = 0 THEN NULL
                ELSE 'seg ' || (o.k % 5) END AS c_mktsegment
    FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k, max(o_totalprice) AS price
                               FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def patch_rows(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"),
                                             F.max("o_totalprice").alias("price"))
    key = F.col("k")
    patches = last.select(
        F.col("o_custkey").alias("c_custkey"),
        F.when(key % 3 != 0, F.concat(F.lit(" n"), key.cast("string"), F.lit(" ")))
        .alias("c_name"),
        F.when(key % 2 == 0, F.col("price")).alias("c_acctbal"),
        F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" seg "), (key % 5).cast("string")))
        .alias("c_mktsegment"))
    return change.patch(t.customer, patches, "c_custkey", cleaned=["c_name"],
                        nullable_blank=["c_mktsegment"])


@query("update_where", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_quantity > 40 OR l_returnflag = 'R' THEN l_quantity + l_linenumber
                ELSE l_quantity END AS l_quantity,
           l_extendedprice,
           CASE WHEN l_quantity > 40 OR l_returnflag = 'R' THEN l_quantity / 100
                ELSE l_discount END AS l_discount,
           l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""")
def update_where(t):
    return change.update_where(t.lineitem, "l_quantity > 40 OR l_returnflag = 'R'",
                               {"l_quantity": "l_quantity + l_linenumber",
                                "l_discount": "l_quantity / 100"})


@query("delete_where", """
    SELECT * FROM lineitem WHERE NOT (l_quantity > 40 AND l_returnflag = 'R')""")
def delete_where(t):
    return change.delete_where(t.lineitem, "l_quantity > 40 AND l_returnflag = 'R'")


@query("delete_where_null", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders
    WHERE o_orderstatus = 'P' OR o_totalprice <= 200000""")
def delete_where_null(t):
    priced = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P",
                                                  F.col("o_totalprice")).alias("price"))
    return change.delete_where(priced, "price > 200000")


@query("stamp_changes", f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '{NOW}' ELSE o_orderdate END
           AS modified_on, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE o_custkey END AS modified_by
    FROM orders""")
def stamp_changes(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("modified_on"),
                           F.col("o_custkey").alias("modified_by"))
    return change.stamp(rows, F.col("o_orderstatus") == "F", NOW, 7).drop("o_orderstatus")


_GONE_SQL = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'"


def _pages(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lit("partial").alias("status"),
                           (F.col("o_orderstatus") != "P").alias("is_active"))


def _elements(t):
    """lineitem rows as elements, the part key standing in for their own id."""
    return t.lineitem.select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("page_id"),
        F.expr(ELEMENT_STATUS_SQL).alias("status"),
        (F.col("l_linestatus") == "F").alias("is_active"))


@query("archive_pages", f"""
    SELECT o_orderkey AS page_id, 'page' AS kind,
           CASE WHEN o_orderkey IN ({_GONE_SQL}) THEN 'archived' ELSE 'partial' END AS status,
           CASE WHEN o_orderkey IN ({_GONE_SQL}) THEN false ELSE o_orderstatus <> 'P' END
               AS is_active, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL
    SELECT l_orderkey, 'element',
           CASE WHEN l_orderkey IN ({_GONE_SQL}) THEN 'archived' ELSE {ELEMENT_STATUS_SQL} END
               AS status,
           CASE WHEN l_orderkey IN ({_GONE_SQL}) THEN false ELSE l_linestatus = 'F' END
               AS is_active, count(*) AS n FROM lineitem GROUP BY ALL""")
def archive_pages(t):
    keys = t.orders.filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    pages, elements = change.archive_pages(_pages(t), _elements(t), keys)
    both = pages.select(F.col("id").alias("page_id"), F.lit("page").alias("kind"), "status",
                        "is_active").unionByName(
        elements.select("page_id", F.lit("element").alias("kind"), "status", "is_active"))
    return both.groupBy("page_id", "kind", "status", "is_active").agg(
        F.count(F.lit(1)).alias("n"))


@query("archive_elements", f"""
    WITH gone AS (SELECT p_partkey FROM part WHERE p_size = 13),
    touched AS (SELECT DISTINCT l_orderkey FROM lineitem
                WHERE l_partkey IN (SELECT p_partkey FROM gone)),
    kids AS (SELECT l_orderkey, bool_or(s = 'error') AS e, bool_or(s = 'warning') AS w
             FROM (SELECT l_orderkey, {ELEMENT_STATUS_SQL} AS s FROM lineitem
                   WHERE l_linestatus = 'F'
                   AND l_partkey NOT IN (SELECT p_partkey FROM gone)) GROUP BY 1)
    SELECT o_orderkey AS id, o_orderstatus <> 'P' AS is_active,
           CASE WHEN o_orderstatus = 'P' OR t.l_orderkey IS NULL THEN 'partial'
                WHEN k.l_orderkey IS NULL THEN 'partial' WHEN e THEN 'error'
                WHEN w THEN 'partial' ELSE 'ready' END AS status
    FROM orders LEFT JOIN touched t ON t.l_orderkey = o_orderkey
                LEFT JOIN kids k ON k.l_orderkey = o_orderkey""")
def archive_elements(t):
    keys = t.part.filter("p_size = 13").select("p_partkey")
    return change.archive_elements(_pages(t), _elements(t), keys)[0]


# Deleting a region: nations, customers and orders go with it, lineitems lose their order,
# suppliers hold their nation.
_DELETE_EDGES = [
    e._replace(on_delete="set_null") if e.child == "lineitem" and e.parent == "orders"
    else e._replace(on_delete="restrict") if e.child == "supplier" else e
    for e in INPUT_EDGES]
_DEAD_SQL = """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2),
    c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
    o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))"""


def _without_region(t):
    names = {n for e in _DELETE_EDGES for n in (e.child, e.parent)}
    return change.delete_cascade(t.some(names), _DELETE_EDGES, "region",
                                 t.region.filter("r_regionkey = 2").select("r_regionkey"))


@query("delete_cascade", f"""{_DEAD_SQL}
    SELECT 'region' AS tbl, r_regionkey::BIGINT AS k, false AS cleared FROM region
        WHERE r_regionkey <> 2
    UNION ALL SELECT 'nation', n_nationkey, false FROM nation
        WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n)
    UNION ALL SELECT 'customer', c_custkey, false FROM customer
        WHERE c_custkey NOT IN (SELECT c_custkey FROM c)
    UNION ALL SELECT 'orders', o_orderkey, false FROM orders
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
    UNION ALL SELECT 'lineitem', l_partkey, l_orderkey IN (SELECT o_orderkey FROM o)
        FROM lineitem""")
def delete_cascade(t):
    tables, _ = _without_region(t)
    keep = F.lit(False).alias("cleared")
    parts = [tables[name].select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("k"),
                                 keep)
             for name, key in [("region", "r_regionkey"), ("nation", "n_nationkey"),
                               ("customer", "c_custkey"), ("orders", "o_orderkey")]]
    out = tables["lineitem"].select(F.lit("lineitem").alias("tbl"), F.col("l_partkey").alias("k"),
                                    F.col("l_orderkey").isNull().alias("cleared"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("delete_restricted", """
    SELECT 'supplier.s_nationkey->nation.n_nationkey' AS edge, count(*) AS n FROM supplier
    WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def delete_restricted(t):
    return _without_region(t)[1]


@query("starter_projects", """
    WITH lacking AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'))
    SELECT c_custkey AS owner_id, 'My first project' AS name, 'draft' AS status, 30000 AS timeout_ms,
           'starter-' || substr(sha256(c_custkey::VARCHAR), 1, 8) AS slug FROM lacking""")
def starter_projects(t):
    projects = t.orders.select(F.col("o_custkey").alias("owner_id"),
                               (F.col("o_orderstatus") == "O").alias("is_active"))
    fresh, _ = change.starter_rows(t.customer, "c_custkey", projects)
    return fresh.select("owner_id", "name", "status", "timeout_ms", "slug")


@query("starter_scenarios", """
    SELECT 'starter-' || substr(sha256(c_custkey::VARCHAR), 1, 8) AS project_slug,
           'Starter scenario' AS name, 'TEST "Starter scenario"' || chr(10) || 'FIN' AS source_text,
           'draft' AS status, '{}' AS ast_json, '[]' AS steps_json, '{}' AS validation_json,
           '' AS generated_code
    FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def starter_scenarios(t):
    projects = t.orders.select(F.col("o_custkey").alias("owner_id"),
                               (F.col("o_orderstatus") == "P").alias("is_active"))
    return change.starter_rows(t.customer, "c_custkey", projects)[1].drop("owner_id")


def _user_table(t):
    """Customers as users; some are blocked or refunded, a third have a subject id."""
    status = (F.when(F.col("c_mktsegment") == "MACHINERY", "blocked")
              .when(F.col("c_mktsegment") == "FURNITURE", "refunded").otherwise("active"))
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("uuid"),
        F.col("c_name").alias("first_name"), F.lit("Old").alias("last_name"),
        F.concat(F.lit("c"), key, F.lit("@example.org")).alias("email"),
        status.alias("account_status"), F.lit(None).cast("string").alias("auth_provider"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sub-"), key)).alias("google_sub"),
        F.lit(None).cast("string").alias("google_picture_url"),
        F.lit(False).alias("email_verified"),
        F.lit(None).cast("timestamp_ntz").alias("last_login_at"), F.lit(True).alias("is_active"))


def _sign_ins(t):
    """Events as sign-ins of user numbers 0, 10, 20, …, partly beyond the known ones."""
    who = F.col("user_id") * 20
    return t.events.select(
        "event_id", F.concat(F.lit(" sub-"), who.cast("string")).alias("sub"),
        F.when(F.col("event_type") == "error", "").otherwise(
            F.concat(F.lit("C"), who.cast("string"), F.lit("@Example.org"))).alias("email"),
        (F.col("event_type") != "view").alias("email_verified"),
        F.when(F.col("value") > 10, F.concat(F.lit("N"), F.col("event_id").cast("string")))
        .alias("given_name"),
        F.lit("").alias("family_name"), F.lit(None).cast("string").alias("picture"))


_SIGN_SQL = """WITH s AS (SELECT event_id, user_id * 20 AS who, event_type, value,
        CASE WHEN event_type = 'error' THEN 'incomplete' WHEN event_type = 'view'
             THEN 'not_verified' WHEN c_mktsegment = 'MACHINERY' THEN 'disabled'
             WHEN c_mktsegment = 'FURNITURE' THEN 'refunded' END AS reason, c_custkey
    FROM events LEFT JOIN customer ON c_custkey = user_id * 20),
    good AS (SELECT who, c_custkey, max(event_id) AS last_id,
             max_by('N' || event_id, event_id) FILTER (value > 10) AS given
             FROM s WHERE reason IS NULL GROUP BY 1, 2)"""


@query("upsert_users", f"""{_SIGN_SQL}
    SELECT c.c_custkey AS id, coalesce(given, c_name) AS first_name, 'Old' AS last_name,
           'c' || c.c_custkey || '@example.org' AS email,
           CASE WHEN g.who IS NOT NULL THEN 'google' END AS auth_provider,
           CASE WHEN g.who IS NOT NULL OR c.c_custkey % 3 = 0 THEN 'sub-' || c.c_custkey END
               AS google_sub, g.who IS NOT NULL AS email_verified,
           CASE WHEN g.who IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_login_at
    FROM customer c LEFT JOIN good g ON g.c_custkey = c.c_custkey
    UNION ALL
    SELECT 5000000 + row_number() OVER (ORDER BY last_id), coalesce(given, 'Google'), 'User',
           'c' || who || '@example.org', 'google', 'sub-' || who, true, TIMESTAMP '{NOW}'
    FROM good WHERE c_custkey IS NULL""")
def upsert_users(t):
    after, _ = users.upsert_users(_user_table(t), _sign_ins(t), ["event_id"], NOW, 5_000_000)
    return after.select("id", "first_name", "last_name", "email", "auth_provider", "google_sub",
                        "email_verified", "last_login_at")


@query("upsert_users_rejected", f"""{_SIGN_SQL}
    SELECT event_id, reason FROM s WHERE reason IS NOT NULL""")
def upsert_users_rejected(t):
    _, rejected = users.upsert_users(_user_table(t), _sign_ins(t), ["event_id"], NOW, 5_000_000)
    return rejected.select("event_id", "reason")


def _feedback(t):
    """Conversation turns as feedback on a project (an order) by a user (a customer)."""
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("ref"),
        F.when(F.col("turn") != 1, F.col("conv_id") * 7 % 1500).alias("user_id"),
        F.col("conv_id").alias("project_id"),
        F.when(F.col("role") == "system", "  ").otherwise(F.col("role")).alias("subject"),
        F.when(F.col("turn") == 3, "\n").otherwise(F.concat(F.lit("\t"), "text")).alias("message"),
        F.concat(F.lit(" U"), F.col("turn").cast("string"), F.lit("@Example.org"))
        .alias("contact_email"))


def _own_projects(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"),
                           (F.col("o_orderstatus") != "P").alias("is_active"))


@query("feedback_intake", """
    SELECT conv_id || '-' || turn AS ref, 'u' || turn || '@example.org' AS contact_email,
           CASE WHEN role = 'system' THEN 'subject_required' WHEN turn = 3 THEN 'message_required'
                WHEN turn <> 1 AND conv_id * 7 % 1500 <> 0 AND conv_id <> 0 AND NOT EXISTS (
                    SELECT 1 FROM orders WHERE o_orderkey = conv_id AND o_orderstatus <> 'P'
                    AND o_custkey = conv_id * 7 % 1500) THEN 'no_access' END AS reason
    FROM conversations""")
def feedback_intake(t):
    good, bad = change.intake(_feedback(t), _own_projects(t))
    cols = ["ref", "contact_email"]
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(*cols, "reason"))


@query("feedback_reply", f"""
    SELECT doc_id AS id, CASE WHEN q IS NULL THEN 'new' ELSE 'answered' END AS status,
           CASE WHEN q IS NOT NULL THEN 'quality ' || q END AS admin_reply,
           CASE WHEN q IS NOT NULL THEN TIMESTAMP '{NOW}' END AS replied_on
    FROM documents LEFT JOIN (SELECT doc_id AS k, quality AS q FROM labels) ON k = doc_id""")
def feedback_reply(t):
    base = t.documents.select(
        F.col("doc_id").alias("id"), F.lit("new").alias("status"),
        F.lit(None).cast("string").alias("admin_reply"),
        F.lit(None).cast("timestamp_ntz").alias("replied_on"))
    replies = t.labels.select(F.col("doc_id").alias("id"), F.concat(
        F.lit(" quality "), F.col("quality").cast("string"), F.lit("\n")).alias("admin_reply"))
    return change.reply(base, replies, NOW)


@query("store_compiled", f"""
    SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'blocked' ELSE 'draft' END AS status,
           CASE WHEN quality = 1 THEN '{{"q":1}}' ELSE '{{}}' END AS ast_json,
           CASE WHEN quality = 1 THEN '["s"]' ELSE '[]' END AS steps_json,
           '{{}}' AS validation_json, '[]' AS source_map_json,
           CASE WHEN l.doc_id IS NOT NULL THEN '' END AS generated_code,
           CASE WHEN l.doc_id IS NOT NULL THEN 'v2' END AS compiler_version,
           CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_compiled_on
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def store_compiled(t):
    none = F.lit(None).cast("string")
    base = t.documents.select(
        F.col("doc_id").alias("id"), F.lit("draft").alias("status"),
        F.lit("{}").alias("ast_json"), F.lit("[]").alias("steps_json"),
        F.lit("{}").alias("validation_json"), F.lit("[]").alias("source_map_json"),
        none.alias("generated_code"), none.alias("compiler_version"),
        F.lit(None).cast("timestamp_ntz").alias("last_compiled_on"))
    good = F.col("quality") == 1
    results = t.labels.select(
        F.col("doc_id").alias("id"),
        F.when(good, F.struct(F.col("quality").alias("q"))).alias("ast"),
        F.when(good, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
        .alias("steps"),
        F.when(F.col("toxic") == 1, "blocked").alias("status"))
    return change.store_compiled(base, results, NOW, versions=("v1", "v2"))
