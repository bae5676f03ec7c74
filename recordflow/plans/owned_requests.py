"""Record services on what a user owns: settings, elements, scenarios, runs, archiving, sign-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.operators import run_services, services, users
from recordflow.plans.changes import _SIGN_SQL, _sign_ins, _user_table
from recordflow.plans.reads import key_number
from recordflow.plans.registry import query
from recordflow.plans.requests import (_FINISH_SQL, FIRST_NEW, NOW, _pages, _projects, _runs)

# Slugs that the first projects hold: those the names in the requests ask for.
HELD = ["1-urgent", "2-high", "3-medium", "4-not-specified", "5-low"]
_HELD_SQL = "[" + ", ".join(f"'{s}'" for s in HELD) + "]"
_ACCESS_SQL = """CASE WHEN {u} = 0 THEN 'authentication_required'
                 WHEN c_custkey IS NULL OR {u} <> c_custkey % 3 + 1 THEN 'no_access' {more} END"""


def _settings(t):
    """Orders as changes of their customer's project, most of them to one of five names."""
    key = F.col("c_custkey")
    held = F.get(F.array(*[F.lit(s) for s in HELD]), key.cast("int"))
    projects = t.customer.select(
        key.alias("id"), (key % 3 + 1).alias("owner_id"), F.col("c_name").alias("name"),
        F.coalesce(held, F.concat(F.lit("p-"), key.cast("string"))).alias("slug"),
        F.lit(30000).alias("timeout_ms"), F.lit(None).cast("bigint").alias("modified_by"),
        (F.col("c_acctbal") > 0).alias("is_active"))
    status = F.col("o_orderstatus")
    asks = t.orders.select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 4).alias("user_id"),
        F.col("o_custkey").alias("project_id"),
        F.when(status == "F", F.concat(F.lit(" "), "o_orderpriority")).when(
            status == "P", "\t").alias("name"),
        (F.col("o_orderkey") % 320 * 1000).cast("int").alias("timeout_ms"))
    return services.update_projects(asks, projects, NOW)


_SETTINGS_SQL = f"""
    WITH c AS (
        SELECT o_orderkey AS rid, o_orderkey % 4 AS u, o_custkey AS p,
               (o_orderkey % 320 * 1000)::INT AS ms,
               CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS name,
               {_ACCESS_SQL.format(u='o_orderkey % 4', more='''
                 WHEN o_orderstatus = 'P' THEN 'required'
                 WHEN o_orderkey % 320 NOT BETWEEN 1 AND 300 THEN 'invalid' ''')} AS reason
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)"""


@query("update_projects", f"""{_SETTINGS_SQL},
    good AS (SELECT * FROM c WHERE reason IS NULL),
    last AS (SELECT p, arg_max(ms, rid) AS ms, max(u) AS who FROM good GROUP BY 1),
    named AS (SELECT p, arg_max(name, rid) AS name, max(rid) AS turn FROM good
              WHERE name IS NOT NULL GROUP BY 1),
    own AS (SELECT c_custkey AS id, c_name, coalesce(({_HELD_SQL})[c_custkey + 1],
                   'p-' || c_custkey) AS slug FROM customer),
    want AS (SELECT id, name, slug, turn, lower(replace(name, ' ', '-')) AS base
             FROM named JOIN own ON id = p),
    given AS (SELECT id, name, CASE WHEN slug = base THEN slug ELSE base || '-' || (1 +
                     row_number() OVER (PARTITION BY base, slug = base ORDER BY turn)) END AS slug
              FROM want)
    SELECT own.id, coalesce(g.name, c_name) AS name, coalesce(g.slug, own.slug) AS slug,
           coalesce(ms, 30000) AS timeout_ms, who AS modified_by
    FROM own LEFT JOIN given g ON g.id = own.id LEFT JOIN last ON last.p = own.id""")
def update_projects(t):
    return _settings(t).table.select("id", "name", "slug", "timeout_ms", "modified_by")


@query("update_projects_rejected", f"""{_SETTINGS_SQL}
    SELECT rid AS request_id, CASE reason WHEN 'required' THEN 'name' WHEN 'invalid'
           THEN 'timeout_ms' ELSE 'project_id' END AS field, reason FROM c
    WHERE reason IS NOT NULL""")
def update_projects_rejected(t):
    return _settings(t).rejected


@query("touch_projects", f"""
    SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND EXISTS (
               SELECT 1 FROM events WHERE user_id = c_custkey
               AND json_extract(props, '$.k')::BIGINT % 4 = c_custkey % 3 + 1)
           THEN TIMESTAMP '{NOW}' END AS last_opened_on FROM customer""")
def touch_projects(t):
    asks = t.events.select(F.col("event_id").alias("request_id"),
                           (key_number() % 4).alias("user_id"),
                           F.col("user_id").alias("project_id"))
    projects = _projects(t).withColumn("last_opened_on", F.lit(None).cast("timestamp_ntz"))
    return services.touch_projects(asks, projects, NOW).table.select("id", "last_opened_on")


def _elements(t):
    """Lines as elements on their order's page."""
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").alias("project_id"),
        F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("name"),
        F.lit("css").alias("locator_type"), F.lit(40).alias("quality_score"),
        F.when(flag == "A", "error").when(flag == "R", "warning").otherwise("ready")
        .alias("status"), (F.col("l_linestatus") == "O").alias("is_active"))


_LINE_SQL = """l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS page,
               'e' || l_linenumber AS name, l_linestatus = 'O' AS live, CASE l_returnflag
               WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'ready' END AS status
               FROM lineitem)"""


def _new_elements(t):
    """Events as new elements, two requests a page."""
    kind = F.col("event_type")
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        (F.floor(F.col("event_id") / 2) * 3).alias("page_id"),
        F.when(kind == "error", " ").otherwise(
            F.concat(F.lit("E"), (key_number() % 9).cast("string"))).alias("name"),
        F.when(kind == "view", " Role").when(kind == "click", "text").otherwise("css")
        .alias("locator_type"),
        F.when(F.col("value") < 3, "\n").otherwise(" v ").alias("locator_value"))
    return services.create_elements(asks, _elements(t), _pages(t), _projects(t), NOW, FIRST_NEW)


_NEW_ELEMENT_SQL = f"""
    WITH {_LINE_SQL},
    r AS (SELECT event_id, json_extract(props, '$.k')::BIGINT % 4 AS u,
                 event_id // 2 * 3 AS page, value, event_type AS kind,
                 'e' || (json_extract(props, '$.k')::BIGINT % 9) AS name FROM events),
    c AS (SELECT r.*, CASE WHEN o_orderkey IS NULL THEN 'not_found' ELSE
                 {_ACCESS_SQL.format(u='u', more='''WHEN kind = 'error' THEN 'no_name'
                 WHEN value < 3 THEN 'no_value' ''')} END AS reason
          FROM r LEFT JOIN orders ON o_orderkey = page
                 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0),
    v AS (SELECT c.*, CASE WHEN reason IS NOT NULL THEN reason
                 WHEN EXISTS (SELECT 1 FROM l WHERE live AND l.page = c.page AND l.name = c.name)
                      OR row_number() OVER (PARTITION BY reason IS NULL, page, name
                                            ORDER BY event_id) > 1 THEN 'duplicate' END AS verdict,
                 CASE kind WHEN 'view' THEN 'role' WHEN 'click' THEN 'text' ELSE 'css' END AS how
          FROM c),
    after AS (SELECT id, page, name, 'css' AS how, 40 AS score, status, live FROM l
              UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY event_id), page, name, how,
                     CASE how WHEN 'role' THEN 100 WHEN 'text' THEN 70 ELSE 40 END,
                     CASE how WHEN 'css' THEN 'warning' ELSE 'ready' END, true
              FROM v WHERE verdict IS NULL)"""


@query("create_elements", f"""{_NEW_ELEMENT_SQL}
    SELECT id, page AS page_id, name, how AS locator_type, score AS quality_score, status
    FROM after""")
def create_elements(t):
    return _new_elements(t)[0].table.select("id", "page_id", "name", "locator_type",
                                            "quality_score", "status")


@query("create_elements_rejected", f"""{_NEW_ELEMENT_SQL}
    SELECT event_id AS request_id, CASE WHEN verdict IN ('no_name', 'duplicate') THEN 'name'
           WHEN verdict = 'no_value' THEN 'locator_value' ELSE 'page_id' END AS field,
           CASE WHEN verdict IN ('no_name', 'no_value') THEN 'required' ELSE verdict END AS reason
    FROM v WHERE verdict IS NOT NULL""")
def create_elements_rejected(t):
    return _new_elements(t)[0].rejected


@query("create_elements_pages", f"""{_NEW_ELEMENT_SQL},
    kids AS (SELECT page, bool_or(status = 'error') AS e, bool_or(status = 'warning') AS w
             FROM after WHERE live GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' OR o_orderkey NOT IN
               (SELECT page FROM v WHERE verdict IS NULL) THEN 'partial'
           WHEN e THEN 'error' WHEN w THEN 'partial' ELSE 'ready' END AS status
    FROM orders LEFT JOIN kids ON page = o_orderkey""")
def create_elements_pages(t):
    return _new_elements(t)[1].select("id", "status")


def _texts(t):
    """Documents as scenarios of the project with their number."""
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("project_id"),
        F.col("source").alias("name"), F.col("lang").alias("source_text"),
        F.lit("draft").alias("status"), F.lit(None).cast("bigint").alias("modified_by"),
        (F.col("n_chars") % 5 != 0).alias("is_active"))


def _scenario_asks(t, *columns):
    return t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        (F.col("user_id") * 6 + key_number() % 6).alias("scenario_id"), *columns)


def _saves(t):
    kind = F.col("event_type")
    asks = _scenario_asks(
        t, F.when(kind == "error", " ").when(kind == "click", F.concat(
            F.lit(" n"), F.col("event_id").cast("string"))).alias("name"),
        F.when(F.col("value") > 10, F.col("props")).alias("source_text"),
        F.when(kind == "purchase", "ready").alias("status"))
    return services.save_scenarios(asks, _texts(t), _projects(t), NOW)


_SCENARIO_SQL = """
    WITH r AS (SELECT *, json_extract(props, '$.k')::BIGINT % 4 AS u,
               user_id * 6 + json_extract(props, '$.k')::BIGINT % 6 AS scenario FROM events),
    c AS (SELECT r.*, CASE WHEN doc_id IS NULL THEN 'not_found' ELSE
                 {access} END AS reason
          FROM r LEFT JOIN documents ON doc_id = scenario
                 LEFT JOIN customer ON c_custkey = doc_id AND c_acctbal > 0)"""
_SAVE_SQL = _SCENARIO_SQL.format(access=_ACCESS_SQL.format(u="u", more="""
                 WHEN n_chars % 5 = 0 THEN 'not_found'
                 WHEN event_type = 'error' THEN 'required' """))


@query("save_scenarios", f"""{_SAVE_SQL},
    last AS (SELECT scenario, max(u) AS who,
                    arg_max('n' || event_id, event_id) FILTER (event_type = 'click') AS name,
                    arg_max(props, event_id) FILTER (value > 10) AS body,
                    bool_or(event_type = 'purchase') AS ready
             FROM c WHERE reason IS NULL GROUP BY 1)
    SELECT doc_id AS id, coalesce(name, source) AS name, coalesce(body, lang) AS source_text,
           CASE WHEN ready THEN 'ready' ELSE 'draft' END AS status, who AS modified_by
    FROM documents LEFT JOIN last ON scenario = doc_id""")
def save_scenarios(t):
    return _saves(t).table.select("id", "name", "source_text", "status", "modified_by")


@query("save_scenarios_rejected", f"""{_SAVE_SQL}
    SELECT event_id AS request_id, CASE reason WHEN 'required' THEN 'name' ELSE 'scenario_id' END
           AS field, reason FROM c WHERE reason IS NOT NULL""")
def save_scenarios_rejected(t):
    return _saves(t).rejected


@query("archive_own_scenarios", f"""{_SCENARIO_SQL.format(
        access=_ACCESS_SQL.format(u='u', more=''))},
    gone AS (SELECT DISTINCT scenario FROM c WHERE reason IS NULL)
    SELECT doc_id AS id, CASE WHEN scenario IS NULL THEN 'draft' ELSE 'archived' END AS status,
           scenario IS NULL AND n_chars % 5 <> 0 AS is_active
    FROM documents LEFT JOIN gone ON scenario = doc_id""")
def archive_own_scenarios(t):
    after = run_services.archive_own_scenarios(_scenario_asks(t), _texts(t), _projects(t)).table
    return after.select("id", "status", "is_active")


@query("update_runs", f"""{_FINISH_SQL},
    last AS (SELECT * FROM good QUALIFY row_number() OVER (
                 PARTITION BY run ORDER BY event_id DESC) = 1)
    SELECT o_orderkey AS id, coalesce(st, 'executing') AS status,
           CASE WHEN run IS NULL THEN 'old' WHEN st = 'failed' THEN 'timeout' END AS error_type,
           NULL::TIMESTAMP AS finished_on
    FROM orders LEFT JOIN last ON run = o_orderkey""")
def update_runs(t):
    kind = F.col("event_type")
    asks = t.events.select(
        F.col("event_id").alias("request_id"), (key_number() % 4).alias("user_id"),
        (F.col("user_id") * 40 + key_number() % 40).alias("run_id"),
        F.when(kind == "purchase", "passed").when(kind == "error", "failed").when(
            kind == "signup", "cancelled").otherwise("blocked").alias("status"),
        F.when(kind == "error", "timeout").alias("error_type"))
    return run_services.update_runs(asks, _runs(t), _projects(t)).table.select(
        "id", "status", "error_type", "finished_on")


@query("archive_own_projects", """
    SELECT c_custkey AS id, CASE WHEN gone THEN 'archived' ELSE 'draft' END AS status,
           c_acctbal > 0 AND NOT gone AS is_active
    FROM (SELECT *, c_acctbal > 0 AND EXISTS (
              SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 16 = c_custkey % 3 + 1)
              AS gone FROM customer)""")
def archive_own_projects(t):
    asks = t.orders.select(F.col("o_orderkey").alias("request_id"),
                           (F.col("o_orderkey") % 16).alias("user_id"),
                           F.col("o_custkey").alias("project_id"))
    projects = _projects(t).withColumn("status", F.lit("draft"))
    return run_services.archive_own_projects(asks, projects).table.select("id", "status",
                                                                          "is_active")


_ARCHIVE_SQL = f"""
    WITH {_LINE_SQL},
    gone AS (SELECT DISTINCT event_id, o_orderkey AS page FROM events
             JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = o_custkey
             WHERE c_acctbal > 0 AND json_extract(props, '$.k')::BIGINT % 4 = c_custkey % 3 + 1)"""


@query("archive_own_pages", f"""{_ARCHIVE_SQL}
    SELECT 'page' AS kind, o_orderkey AS id,
           CASE WHEN page IS NULL THEN 'partial' ELSE 'archived' END AS status,
           page IS NULL AND o_orderstatus = 'O' AS is_active
    FROM orders LEFT JOIN gone ON page = o_orderkey
    UNION ALL SELECT 'element', id, CASE WHEN g.page IS NULL THEN status ELSE 'archived' END,
           g.page IS NULL AND live FROM l LEFT JOIN gone g ON g.page = l.page""")
def archive_own_pages(t):
    asks = t.events.select(F.col("event_id").alias("request_id"),
                           (key_number() % 4).alias("user_id"),
                           F.col("event_id").alias("page_id"))
    (pages, _), elements = run_services.archive_own_pages(asks, _pages(t), _elements(t),
                                                          _projects(t))
    return _both(pages, elements)


def _both(pages, elements):
    cols = ["id", "status", "is_active"]
    return pages.select(F.lit("page").alias("kind"), *cols).unionByName(
        elements.select(F.lit("element").alias("kind"), *cols))


@query("archive_own_elements", f"""{_ARCHIVE_SQL},
    after AS (SELECT l.id, l.page, l.live AND g.page IS NULL AS live, CASE WHEN g.page IS NULL
                     THEN l.status ELSE 'archived' END AS status, g.page IS NOT NULL AS hit
              FROM l LEFT JOIN gone g ON g.page = l.page AND l.name = 'e1'),
    kids AS (SELECT page, count(*) FILTER (live) AS n, bool_or(hit) AS hit,
                    bool_or(live AND status = 'error') AS e,
                    bool_or(live AND status = 'warning') AS w FROM after GROUP BY 1)
    SELECT 'page' AS kind, o_orderkey AS id, CASE WHEN NOT coalesce(hit, false)
           OR o_orderstatus <> 'O' THEN 'partial' WHEN n = 0 THEN 'partial' WHEN e THEN 'error'
           WHEN w THEN 'partial' ELSE 'ready' END AS status, o_orderstatus = 'O' AS is_active
    FROM orders LEFT JOIN kids ON page = o_orderkey
    UNION ALL SELECT 'element', id, status, live FROM after""")
def archive_own_elements(t):
    home = t.events.select(F.col("event_id").alias("request_id"),
                           (key_number() % 4).alias("user_id"),
                           (F.col("event_id") * 10 + 1).alias("element_id"))
    # An element's own project is its page's here.
    pages = _pages(t)
    place = pages.select(F.col("id").alias("page_id"), "project_id")
    elements = _elements(t).drop("project_id").join(place, "page_id")
    (after, _), pages = run_services.archive_own_elements(home, elements, pages, _projects(t))
    return _both(pages, after)


@query("sign_in_projects", f"""{_SIGN_SQL},
    here AS (SELECT c_custkey AS id FROM good WHERE c_custkey IS NOT NULL
             UNION ALL SELECT 5000000 + row_number() OVER (ORDER BY last_id) FROM good
             WHERE c_custkey IS NULL)
    SELECT o_orderkey AS id, o_custkey * 3 AS owner_id, 'Order' AS name,
           'order-' || o_orderkey AS slug, NULL::TIMESTAMP AS last_opened_on FROM orders
    UNION ALL SELECT {FIRST_NEW} + row_number() OVER (ORDER BY id), id, 'My first project',
           'starter-' || substr(sha256(id::VARCHAR), 1, 8), TIMESTAMP '{NOW}'
    FROM here WHERE id NOT IN (SELECT o_custkey * 3 FROM orders)""")
def sign_in_projects(t):
    projects = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 3).alias("owner_id"),
        F.lit("Order").alias("name"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.lit(None).cast("timestamp_ntz").alias("last_opened_on"),
        (F.col("o_orderstatus") == "O").alias("is_active"))
    _, after, _ = users.sign_in(_user_table(t), projects, _sign_ins(t), ["event_id"], NOW,
                                5_000_000, FIRST_NEW)
    return after.select("id", "owner_id", "name", "slug", "last_opened_on")
