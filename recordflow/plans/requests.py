"""Record services: whole tables as batches of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions.text import slug_text
from recordflow.operators import billing, run_services, services
from recordflow.plans.reads import key_number
from recordflow.plans.registry import query
from recordflow.plans.rollups import SLUG_SQL

NOW = "2024-02-01 12:00:00"
FIRST_NEW = 10_000_000


def _project_batch(t):
    """Parts as project requests; the large ones are projects already."""
    projects = t.part.filter("p_size > 45").select(
        F.col("p_partkey").alias("id"), F.lit(9).cast("bigint").alias("owner_id"),
        F.col("p_name").alias("name"), slug_text("p_name").alias("slug"),
        F.lit(30000).alias("timeout_ms"), F.lit(True).alias("is_active"))
    asks = t.part.select(
        F.col("p_partkey").alias("request_id"), (F.col("p_size") % 5).cast("bigint")
        .alias("user_id"),
        F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.upper("p_name")).alias("name"),
        (F.col("p_size") - 10).alias("timeout_ms"))
    return services.create_projects(asks, projects, NOW, FIRST_NEW)


@query("create_projects", f"""
    WITH good AS (SELECT p_partkey, p_size, p_name, {SLUG_SQL.format('p_name')} AS slug FROM part
                  WHERE p_size % 5 <> 0 AND p_type <> 'ECONOMY'),
    held AS (SELECT DISTINCT {SLUG_SQL.format('p_name')} AS slug FROM part WHERE p_size > 45),
    n AS (SELECT g.*, row_number() OVER (PARTITION BY g.slug ORDER BY p_partkey)
              + (h.slug IS NOT NULL)::INT AS n FROM good g LEFT JOIN held h ON h.slug = g.slug)
    SELECT p_partkey AS id, 9::BIGINT AS owner_id, p_name AS name,
           {SLUG_SQL.format('p_name')} AS slug, 30000 AS timeout_ms FROM part WHERE p_size > 45
    UNION ALL
    SELECT {FIRST_NEW} + row_number() OVER (ORDER BY p_partkey), p_size % 5, upper(p_name),
           CASE n WHEN 1 THEN slug ELSE slug || '-' || n END,
           CASE p_size WHEN 10 THEN 30000 ELSE p_size - 10 END FROM n""")
def create_projects(t):
    return _project_batch(t).table.select("id", "owner_id", "name", "slug", "timeout_ms")


@query("create_projects_rejected", """
    SELECT p_partkey AS request_id, CASE WHEN p_size % 5 = 0 THEN 'user_id' ELSE 'name' END AS field,
           CASE WHEN p_size % 5 = 0 THEN 'authentication_required' ELSE 'required' END AS reason
    FROM part WHERE p_size % 5 = 0 OR p_type = 'ECONOMY'""")
def create_projects_rejected(t):
    return _project_batch(t).rejected


def _projects(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 + 1).alias("owner_id"),
        (F.col("c_acctbal") > 0).alias("is_active"))


def _pages(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
        F.concat(F.lit("view_"), (F.col("o_orderkey") % 9).cast("string")).alias("name"),
        F.lit("/").alias("route"), F.lit("partial").alias("status"),
        (F.col("o_orderstatus") == "O").alias("is_active"),
        F.lit(None).cast("bigint").alias("modified_by"))


def _page_batch(t):
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        F.col("user_id").alias("project_id"),
        F.concat("event_type", F.lit(" "), (key_number() % 9).cast("string")).alias("name"))
    return services.create_pages(asks, _pages(t), _projects(t), NOW, FIRST_NEW)


_PAGE_SQL = """
    WITH r AS (SELECT event_id, json_extract(props, '$.k')::BIGINT % 4 AS u, user_id AS project,
                      event_type || '_' || (json_extract(props, '$.k')::BIGINT % 9) AS name
               FROM events),
    c AS (SELECT r.*, CASE WHEN u = 0 THEN 'authentication_required'
                           WHEN c_custkey IS NULL OR u <> c_custkey % 3 + 1 THEN 'no_access' END
                      AS reason
          FROM r LEFT JOIN customer ON c_custkey = project AND c_acctbal > 0),
    held AS (SELECT DISTINCT o_custkey, 'view_' || (o_orderkey % 9) AS name FROM orders
             WHERE o_orderstatus = 'O'),
    v AS (SELECT c.*, CASE WHEN reason IS NOT NULL THEN reason
                 WHEN h.name IS NOT NULL OR row_number() OVER (
                     PARTITION BY reason IS NULL, project, c.name ORDER BY event_id) > 1
                 THEN 'duplicate' END AS verdict
          FROM c LEFT JOIN held h ON h.o_custkey = project AND h.name = c.name)"""


@query("create_pages", f"""{_PAGE_SQL}
    SELECT o_orderkey AS id, o_custkey AS project_id, 'view_' || (o_orderkey % 9) AS name,
           'partial' AS status, NULL::BIGINT AS modified_by FROM orders
    UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY event_id), project, name, 'partial', u
    FROM v WHERE verdict IS NULL""")
def create_pages(t):
    return _page_batch(t).table.select("id", "project_id", "name", "status", "modified_by")


@query("create_pages_rejected", f"""{_PAGE_SQL}
    SELECT event_id AS request_id, CASE verdict WHEN 'duplicate' THEN 'name' ELSE 'project_id' END
           AS field, verdict AS reason FROM v WHERE verdict IS NOT NULL""")
def create_pages_rejected(t):
    return _page_batch(t).rejected


def _page_patches(t):
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (F.col("event_id") * 2).alias("page_id"),
        (key_number() % 4).alias("user_id"),
        F.when(F.col("value") > 10, F.concat(F.lit("View "), (key_number() % 9).cast("string")))
        .alias("name"),
        F.when(F.col("event_type") != "view", F.concat(F.lit(" "), "event_type"))
        .alias("route"))
    return services.update_pages(asks, _pages(t), _projects(t), NOW)


_PATCH_SQL = """
    WITH p AS (SELECT o_orderkey AS id, o_custkey AS project, o_orderstatus = 'O' AS live,
                      'view_' || (o_orderkey % 9) AS name FROM orders),
    r AS (SELECT event_id, event_id * 2 AS page, json_extract(props, '$.k')::BIGINT % 4 AS u,
                 CASE WHEN value > 10 THEN 'view_' || (json_extract(props, '$.k')::BIGINT % 9) END
                     AS name, CASE WHEN event_type <> 'view' THEN event_type END AS route
          FROM events),
    c AS (SELECT r.*, p.project, CASE WHEN p.id IS NULL THEN 'not_found'
                 WHEN u = 0 THEN 'authentication_required'
                 WHEN c_custkey IS NULL OR u <> c_custkey % 3 + 1 THEN 'no_access'
                 WHEN NOT live THEN 'not_found' END AS reason
          FROM r LEFT JOIN p ON p.id = r.page
                 LEFT JOIN customer ON c_custkey = p.project AND c_acctbal > 0),
    held AS (SELECT project, name, min(id) AS lo, max(id) AS hi FROM p WHERE live GROUP BY 1, 2),
    v AS (SELECT c.*, CASE WHEN reason IS NOT NULL THEN reason
                 WHEN c.name IS NOT NULL AND (NOT (lo = page AND hi = page) OR row_number() OVER (
                     PARTITION BY reason IS NULL, c.project, c.name ORDER BY event_id) > 1)
                 THEN 'duplicate' END AS verdict
          FROM c LEFT JOIN held h ON h.project = c.project AND h.name = c.name)"""


@query("update_pages", f"""{_PATCH_SQL}
    SELECT p.id, p.project AS project_id, coalesce(v.name, p.name) AS name,
           coalesce(v.route, '/') AS route, v.u AS modified_by
    FROM p LEFT JOIN v ON v.page = p.id AND v.verdict IS NULL""")
def update_pages(t):
    return _page_patches(t).table.select("id", "project_id", "name", "route", "modified_by")


@query("update_pages_rejected", f"""{_PATCH_SQL}
    SELECT event_id AS request_id, CASE verdict WHEN 'duplicate' THEN 'name' ELSE 'page_id' END
           AS field, verdict AS reason FROM v WHERE verdict IS NOT NULL""")
def update_pages_rejected(t):
    return _page_patches(t).rejected


def _element_batch(t):
    """Orders as elements on customers as pages in nations as projects; events are patches."""
    projects = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"),
                               F.lit(1).cast("bigint").alias("owner_id"),
                               (F.col("n_regionkey") != 2).alias("is_active"))
    pages = t.customer.select(F.col("c_custkey").alias("id"),
                              F.col("c_nationkey").cast("bigint").alias("project_id"),
                              F.lit("empty").alias("status"),
                              (F.col("c_acctbal") > 0).alias("is_active"))
    home = pages.select(F.col("id").alias("page_id"), "project_id")
    elements = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page_id"),
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("css").alias("locator_type"), F.lit("x").alias("locator_value"),
        F.lit(40).alias("quality_score"), F.lit("fragile").alias("quality_label"),
        F.lit("warning").alias("status"), (F.col("o_orderstatus") != "P").alias("is_active")
    ).join(home, "page_id")
    kind = (F.when(F.col("event_type") == "view", " Role").when(
        F.col("event_type") == "click", "text").when(F.col("event_type") == "error", "other"))
    asks = t.events.select(
        F.col("event_id").alias("request_id"), F.col("event_id").alias("element_id"),
        F.lit(1).cast("bigint").alias("user_id"), kind.alias("locator_type"),
        F.when(F.col("event_type") == "purchase", " ").when(
            F.col("event_type") == "signup", " y ").alias("locator_value"),
        F.when(F.col("value") > 30, "error").alias("status"))
    return services.update_elements(asks, elements, pages, projects, NOW)


_ELEMENT_SQL = """
    WITH e AS (SELECT o_orderkey AS id, o_custkey AS page, o_orderstatus <> 'P' AS live,
               n_regionkey <> 2 AS open FROM orders JOIN customer ON c_custkey = o_custkey
               JOIN nation ON n_nationkey = c_nationkey),
    r AS (SELECT event_id, event_type, CASE WHEN value > 30 THEN 'error' END AS given FROM events),
    g AS (SELECT e.*, r.event_id IS NOT NULL AS hit, event_type AS k, given FROM e LEFT JOIN r
          ON r.event_id = e.id AND live AND open AND event_type <> 'purchase'),
    after AS (SELECT *, CASE k WHEN 'view' THEN 'role' WHEN 'click' THEN 'text'
                     WHEN 'error' THEN 'other' ELSE 'css' END AS kind,
              CASE k WHEN 'signup' THEN 'y' ELSE 'x' END AS val,
              CASE k WHEN 'view' THEN 100 WHEN 'click' THEN 70 WHEN 'error' THEN 0 ELSE 40 END
                  AS score,
              coalesce(given, CASE WHEN k IN ('view', 'click') THEN 'ready' ELSE 'warning' END)
                  AS st FROM g)"""


@query("update_elements", f"""{_ELEMENT_SQL}
    SELECT id, page AS page_id, kind AS locator_type, val AS locator_value, score AS quality_score,
           st AS status FROM after""")
def update_elements(t):
    return _element_batch(t)[0].table.select("id", "page_id", "locator_type", "locator_value",
                                             "quality_score", "status")


@query("update_elements_pages", f"""{_ELEMENT_SQL},
    kids AS (SELECT page, bool_or(st = 'error') AS e, bool_or(st = 'warning') AS w
             FROM after WHERE live GROUP BY 1)
    SELECT c_custkey AS id, CASE WHEN c_acctbal <= 0 OR c_custkey NOT IN
               (SELECT page FROM after WHERE hit) THEN 'empty'
           WHEN e THEN 'error' WHEN w THEN 'partial' ELSE 'ready' END AS status
    FROM customer LEFT JOIN kids ON page = c_custkey""")
def update_elements_pages(t):
    return _element_batch(t)[1].select("id", "status")


@query("create_scenarios", f"""
    SELECT doc_id AS id, doc_id AS project_id, source AS name, text AS source_text,
           lang AS status, '' AS steps_json FROM documents
    UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY doc_id), doc_id,
           regexp_replace(text, '^\\s+|\\s+$', '', 'g'), lang, 'draft', '[]'
    FROM documents JOIN customer ON c_custkey = doc_id AND c_acctbal > 0
    WHERE n_chars % 3 + 1 = c_custkey % 3 + 1 AND regexp_matches(text, '\\S')""")
def create_scenarios(t):
    asks = t.documents.select(
        F.col("doc_id").alias("request_id"), (F.col("n_chars") % 3 + 1).alias("user_id"),
        F.col("doc_id").alias("project_id"), F.col("text").alias("name"),
        F.col("lang").alias("source_text"))
    table = t.documents.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("project_id"),
        F.col("source").alias("name"), F.col("text").alias("source_text"),
        F.col("lang").alias("status"), F.lit("").alias("steps_json"))
    return services.create_scenarios(asks, table, _projects(t), NOW, FIRST_NEW).table


@query("run_payloads", """
    WITH placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1
                    AS pos FROM orders WHERE o_orderstatus <> 'P'),
    lists AS (SELECT o_custkey, pos // 5 AS part, string_agg(o_orderkey, ',' ORDER BY pos) AS ids
              FROM placed GROUP BY ALL)
    SELECT c_custkey AS id, coalesce(part, 0) AS part, coalesce(ids, '') AS artifacts,
           CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment
    FROM customer LEFT JOIN lists ON o_custkey = c_custkey""")
def run_payloads(t):
    doc = F.to_json(F.struct(F.col("c_mktsegment").alias("seg")))
    runs = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 0, doc).otherwise(F.concat(doc, F.lit("}")))
        .alias("runtime_snapshot_json"), F.lit("").alias("result_summary_json"))
    none = F.lit(None).cast("string")
    artifacts = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("artifact_type"), none.alias("file_path"),
        none.alias("file_name"), none.alias("mime_type"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        (F.col("o_orderstatus") != "P").alias("is_active"))
    nested = services.run_payloads(runs, artifacts, per_part=5)
    ids = F.array_join(F.transform("artifacts", lambda a: a["id"].cast("string")), ",")
    return nested.select("id", "part", ids.alias("artifacts"),
                         F.try_element_at("runtime_snapshot", F.lit("seg")).alias("segment"))


def _runs(t):
    """Orders as runs of their customer's scenario, in projects owned by 1, 2 or 3."""
    none = F.lit(None).cast("string")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
        F.col("o_custkey").alias("scenario_id"), F.lit("executing").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("finished_on"),
        F.lit(None).cast("int").alias("duration_ms"), F.lit("old").alias("error_type"),
        none.alias("stdout_text"), F.lit("{}").alias("result_summary_json"),
        F.lit(True).alias("is_active"))


def _scenarios(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("project_id"),
                             F.lit("draft").alias("status"), F.lit(True).alias("is_active"))


def _finished(t):
    """Events as finishes; a run may be finished again and again."""
    status = (F.when(F.col("event_type") == "purchase", "passed")
              .when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "signup", "cancelled").otherwise("blocked"))
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        (F.col("user_id") * 40 + key_number() % 40).alias("run_id"), status.alias("status"),
        F.floor("value").cast("int").alias("duration_ms"), F.col("props").alias("stdout_text"))
    return run_services.finish_runs(asks, _runs(t), _scenarios(t), _projects(t), NOW)


_FINISH_SQL = """
    WITH r AS (SELECT event_id, json_extract(props, '$.k')::BIGINT % 4 AS u,
               user_id * 40 + json_extract(props, '$.k')::BIGINT % 40 AS run, value, props,
               CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'failed'
                    WHEN 'signup' THEN 'cancelled' ELSE 'blocked' END AS st FROM events),
    good AS (SELECT r.*, o_custkey FROM r JOIN orders ON o_orderkey = run
             JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
             WHERE u <> 0 AND u = c_custkey % 3 + 1)"""


@query("finish_runs", f"""{_FINISH_SQL},
    last AS (SELECT * FROM good QUALIFY row_number() OVER (
                 PARTITION BY run ORDER BY event_id DESC) = 1)
    SELECT o_orderkey AS id, coalesce(st, 'executing') AS status,
           CASE WHEN run IS NOT NULL THEN TIMESTAMP '{NOW}' END AS finished_on,
           floor(value)::INT AS duration_ms,
           CASE WHEN run IS NULL THEN 'old' END AS error_type, props AS stdout_text,
           '{{}}' AS result_summary_json
    FROM orders LEFT JOIN last ON run = o_orderkey""")
def finish_runs(t):
    return _finished(t)[0].table.select("id", "status", "finished_on", "duration_ms", "error_type",
                                        "stdout_text", "result_summary_json")


@query("finish_runs_scenarios", f"""{_FINISH_SQL},
    last AS (SELECT * FROM good QUALIFY row_number() OVER (
                 PARTITION BY o_custkey ORDER BY event_id DESC) = 1)
    SELECT c_custkey AS id, CASE WHEN st IS NULL THEN 'draft' WHEN st = 'blocked' THEN 'ready'
                                 ELSE st END AS status
    FROM customer c LEFT JOIN last ON o_custkey = c.c_custkey""")
def finish_runs_scenarios(t):
    return _finished(t)[1].select("id", "status")


@query("attach_artifacts", f"""
    SELECT doc_id AS id, doc_id AS run_id, lang AS file_path, n_chars AS size_bytes FROM documents
    UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY l.doc_id), l.doc_id, source, n_chars
    FROM documents l JOIN orders ON o_orderkey = l.doc_id
         JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
    WHERE n_chars % 4 <> 0 AND n_chars % 4 = c_custkey % 3 + 1""")
def attach_artifacts(t):
    asks = t.documents.select(
        F.col("doc_id").alias("request_id"), (F.col("n_chars") % 4).alias("user_id"),
        F.col("doc_id").alias("run_id"), F.lit("report").alias("artifact_type"),
        F.col("source").alias("file_path"), F.col("n_chars").alias("size_bytes"))
    table = t.documents.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("run_id"),
        F.col("lang").alias("file_path"), F.col("n_chars").alias("size_bytes"))
    return run_services.attach_artifacts(asks, table, _runs(t), _projects(t), NOW, FIRST_NEW).table


@query("start_runs", f"""
    WITH good AS (SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id
                  AND c_acctbal > 0 WHERE json_extract(props, '$.k')::BIGINT % 4 = c_custkey % 3 + 1)
    SELECT 'run' AS kind, o_orderkey AS id, o_custkey AS scenario_id, 'executing' AS status
    FROM orders
    UNION ALL SELECT 'run', {FIRST_NEW} + row_number() OVER (ORDER BY event_id), user_id,
           'precheck' FROM good
    UNION ALL SELECT 'scenario', c_custkey, c_custkey,
           CASE WHEN c_custkey IN (SELECT user_id FROM good) THEN 'running' ELSE 'draft' END
    FROM customer""")
def start_runs(t):
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        F.col("user_id").alias("scenario_id"))
    (runs, _), scenarios = run_services.start_runs(
        asks, _runs(t), _scenarios(t), _projects(t), NOW, FIRST_NEW)
    return runs.select(F.lit("run").alias("kind"), "id", "scenario_id", "status").unionByName(
        scenarios.select(F.lit("scenario").alias("kind"), "id", F.col("id").alias("scenario_id"),
                         "status"))


def _orders_asked(t):
    """Orders as purchases of a region's offer; one region has none, one is closed."""
    regions = t.region.filter("r_regionkey > 0")
    offers = regions.select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("code"),
        F.lower("r_name").alias("name"),
        F.when(F.col("r_regionkey") == 1, "USD").otherwise("").alias("currency"),
        (F.col("r_regionkey") + 0.125).cast("double").alias("price_amount"),
        (F.col("r_regionkey") != 2).alias("is_active"))
    names = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("offer_code"))
    asks = t.orders.withColumn("k", (F.col("o_orderkey") % 5).cast("int")).join(names, "k").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), "offer_code")
    users = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@x.y")).alias("email"))
    return billing.order_requests(asks, users, offers)


@query("order_requests", """
    SELECT o_orderkey AS request_id, c_name || '@x.y' AS payer_email, r_regionkey AS offer_id,
           '{"intent":"CAPTURE","purchase_units":[{"reference_id":"offer-' || r_regionkey || '-user-'
           || o_custkey || '","description":"' || lower(r_name)
           || '","amount":{"currency_code":"' || CASE r_regionkey WHEN 1 THEN 'USD' ELSE 'EUR' END
           || '","value":"' || printf('%.2f', r_regionkey + 0.125::DOUBLE) || '"},"custom_id":"'
           || o_custkey || '","invoice_id":"inv-' || substr(sha256(o_custkey || '|' || r_regionkey
           || '|' || o_orderkey), 1, 20) || '"}]}' AS payload
    FROM orders JOIN region ON r_regionkey = o_orderkey % 5
    JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE r_regionkey NOT IN (0, 2)""")
def order_requests(t):
    return _orders_asked(t).table.select("request_id", "payer_email",
                                         F.col("offer_id").cast("int").alias("offer_id"),
                                         "payload")


@query("open_payments", f"""
    SELECT o_orderkey AS id, o_custkey AS user_id, 'O' || o_orderkey AS provider_order_id,
           o_totalprice AS gross_amount, o_orderstatus AS status FROM orders
    UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY o_orderkey), o_custkey,
           'P' || o_orderkey, r_regionkey + 0.125::DOUBLE, 'created'
    FROM orders JOIN region ON r_regionkey = o_orderkey % 5
    JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
    WHERE r_regionkey NOT IN (0, 2) AND o_orderstatus <> 'P'""")
def open_payments(t):
    link = F.struct(F.when(F.col("o_orderstatus") == "P", "self").otherwise("approve").alias("rel"),
                    F.lit("https://x.y/approve").alias("href"))
    answers = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.to_json(F.struct(
            F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("id"),
            F.array(link).alias("links"))).alias("answer"))
    table = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("provider_order_id"),
        F.col("o_totalprice").alias("gross_amount"), F.col("o_orderstatus").alias("status"))
    return billing.open_payments(table, _orders_asked(t).table, answers, NOW, FIRST_NEW).table
