"""Aggregations, sequences and slugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions.text import slug_text
from recordflow.operators import agg, quality, slugs
from recordflow.plans.reads import key_number
from recordflow.plans.registry import query

# lineitem as page elements: its flags as status and activity.
ELEMENT_STATUS_SQL = """CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning'
                             ELSE 'ready' END"""


def elements(t):
    status = (F.when(F.col("l_returnflag") == "R", "error")
              .when(F.col("l_returnflag") == "A", "warning").otherwise("ready"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("page_id"), status.alias("status"),
        (F.col("l_linestatus") == "F").alias("is_active"))


def pages(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.lit("empty").alias("status"),
        (F.col("o_orderstatus") != "P").alias("is_active"))


@query("page_status_rollup", f"""
    WITH kids AS (
        SELECT l_orderkey, bool_or(s = 'error') AS e, bool_or(s = 'warning') AS w
        FROM (SELECT l_orderkey, {ELEMENT_STATUS_SQL} AS s FROM lineitem
              WHERE l_linestatus = 'F') GROUP BY 1)
    SELECT o_orderkey AS id, o_orderstatus <> 'P' AS is_active,
           CASE WHEN o_orderstatus = 'P' THEN 'empty' WHEN k.l_orderkey IS NULL THEN 'partial'
                WHEN e THEN 'error' WHEN w THEN 'partial' ELSE 'ready' END AS status
    FROM orders LEFT JOIN kids k ON k.l_orderkey = o_orderkey""")
def page_status_rollup(t):
    return agg.rollup_status(pages(t), "id", elements(t), "page_id")


@query("count_where", """
    SELECT count(*) FILTER (event_type = 'purchase') AS purchases,
           count(*) FILTER (value >= 10) AS large,
           count(*) FILTER (event_type <> 'view' AND value < 1) AS small_actions FROM events""")
def count_where(t):
    return agg.count_where(t.events, {
        "purchases": "event_type = 'purchase'", "large": "value >= 10",
        "small_actions": "event_type <> 'view' AND value < 1"})


@query("exists_by", """
    SELECT o_custkey, bool_or(o_orderstatus = 'O' AND o_totalprice > 300000) AS found
    FROM orders GROUP BY 1""")
def exists_by(t):
    return agg.exists_by(t.orders, ["o_custkey"], "o_orderstatus = 'O' AND o_totalprice > 300000")


@query("distinct_by", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_by(t):
    return agg.distinct_by(t.lineitem, "l_orderkey", "l_returnflag")


@query("hit_stats", """
    SELECT CASE WHEN grouping(event_type) = 1 THEN 'total' ELSE event_type END AS tier,
           grouping(event_type)::INT AS is_total, count(*) AS entries,
           count(*) FILTER (value >= 10) AS hits, count(*) FILTER (value < 10) AS misses,
           sum(length(props))::BIGINT AS bytes, min(ts) AS oldest,
           (count(*) FILTER (value >= 10) * 100)::DOUBLE / count(*) AS ratio
    FROM events GROUP BY ROLLUP (event_type)""")
def hit_stats(t):
    return agg.hit_stats(t.events, "event_type", "value >= 10", "length(props)", "ts")


@query("progress", """
    SELECT user_id, event_type, count(*) AS total, count(*) FILTER (value >= 10) AS completed,
           coalesce(sum(json_extract(props, '$.k')::BIGINT) FILTER (value >= 10), 0)::BIGINT
               AS points,
           (count(*) FILTER (value >= 10) * 100)::DOUBLE / count(*) AS percent
    FROM events GROUP BY 1, 2""")
def progress(t):
    return agg.progress(t.events, ["user_id", "event_type"], "value >= 10", key_number())


@query("latest_rows", """
    SELECT user_id, event_id, ts, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_rows(t):
    return agg.latest(t.events, ["user_id"], ["ts", "event_id"])


RUN_EVENT_SQL = """CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'passed'
                        WHEN 'error' THEN 'failed' WHEN 'click' THEN 'blocked' END"""


@query("latest_status", f"""
    WITH last AS (SELECT user_id, {RUN_EVENT_SQL} AS s FROM events WHERE event_type <> 'view'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, CASE s WHEN 'started' THEN 'running' WHEN 'passed' THEN 'passed'
           WHEN 'failed' THEN 'failed' ELSE 'ready' END AS status FROM last""")
def latest_status(t):
    return agg.latest_status(t.events.filter("event_type <> 'view'").withColumn(
        "state", F.expr(RUN_EVENT_SQL)), "user_id", ["ts", "event_id"])


@query("transitions", """
    WITH seq AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
                 FROM events)
    SELECT user_id, max_by(event_type, (ts, event_id)) AS last_state,
           max(ts) FILTER (event_type = 'purchase' AND p IS DISTINCT FROM 'purchase') AS entered_on
    FROM seq GROUP BY 1""")
def transitions(t):
    moves = agg.transitions(t.events, "user_id", "ts", "event_id", "event_type", "purchase")
    entered = agg.entered_since(F.lit(None).cast("string"), "purchase")
    return moves.select("user_id", "last_state", entered.alias("entered_on"))


@query("streak", """
    WITH days AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events),
    runs AS (SELECT user_id, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::INT AS run, d
             FROM days),
    sized AS (SELECT user_id, run, count(*) AS n, max(d) AS until FROM runs GROUP BY 1, 2)
    SELECT user_id, max_by(n, until) AS current_streak, max(until) AS last_day
    FROM sized GROUP BY 1""")
def streak(t):
    return agg.streak(t.events, "user_id", "ts")


@query("duplicate_report", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_report(t):
    return quality.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


SLUG_SQL = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("unique_slugs", f"""
    WITH s AS (SELECT p_partkey, {SLUG_SQL.format('p_name')} AS slug FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
    SELECT p_partkey, slug, CASE n WHEN 1 THEN slug ELSE slug || '-' || n END AS unique_slug
    FROM n""")
def unique_slugs(t):
    named = t.part.select("p_partkey", slug_text("p_name").alias("slug"))
    return slugs.dedupe_slugs(named, "slug", "p_partkey")


@query("unique_slugs_taken", f"""
    WITH s AS (SELECT p_partkey, {SLUG_SQL.format('p_name')} AS slug FROM part),
    held AS (SELECT DISTINCT {SLUG_SQL.format('p_name')} AS slug FROM part WHERE p_size > 48),
    n AS (SELECT s.*, row_number() OVER (PARTITION BY s.slug ORDER BY p_partkey)
              + (h.slug IS NOT NULL)::INT AS n
          FROM s LEFT JOIN held h ON h.slug = s.slug)
    SELECT p_partkey, slug, CASE n WHEN 1 THEN slug ELSE slug || '-' || n END AS unique_slug
    FROM n""")
def unique_slugs_taken(t):
    named = t.part.select("p_partkey", slug_text("p_name").alias("slug"))
    projects = t.part.select(slug_text("p_name").alias("slug"),
                             (F.col("p_size") > 48).alias("is_active"))
    return slugs.dedupe_slugs(named, "slug", "p_partkey",
                              slugs.taken_slugs(projects, taken="active"))


# Names that end in numbers themselves: "red-widget-3" may be a name or a second "red-widget".
@query("unique_slugs_rivals", f"""
    WITH RECURSIVE s AS (
        SELECT p_partkey, {SLUG_SQL.format('p_name')} AS family,
               {SLUG_SQL.format('p_name')} || CASE WHEN p_size <= 20 THEN '-' || p_size ELSE '' END
                   AS slug,
               row_number() OVER (PARTITION BY {SLUG_SQL.format('p_name')} ORDER BY p_partkey) AS i
        FROM part),
    walk(family, i, p_partkey, slug, unique_slug, taken) AS (
        SELECT family, i, p_partkey, slug, slug, [slug] FROM s WHERE i = 1
        UNION ALL
        SELECT family, i, p_partkey, slug, given, list_append(taken, given)
        FROM (SELECT s.family, s.i, s.p_partkey, s.slug, w.taken,
                     CASE WHEN NOT list_contains(w.taken, s.slug) THEN s.slug
                     ELSE s.slug || '-' || list_min(list_filter(range(2, s.i + 2),
                          lambda x: NOT list_contains(w.taken, s.slug || '-' || x))) END AS given
              FROM walk w JOIN s ON s.family = w.family AND s.i = w.i + 1))
    SELECT p_partkey, slug, unique_slug FROM walk""")
def unique_slugs_rivals(t):
    own = F.when(F.col("p_size") <= 20, F.concat(F.lit("-"), F.col("p_size").cast("string")))
    named = t.part.select("p_partkey", F.concat(slug_text("p_name"), F.coalesce(own, F.lit("")))
                          .alias("slug"))
    return slugs.dedupe_slugs(named, "slug", "p_partkey")


@query("accept_unique", """
    WITH old AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size > 40),
    new AS (SELECT * FROM part WHERE p_size <= 40)
    SELECT p_partkey, p_name, p_brand,
           row_number() OVER (PARTITION BY new.p_name, new.p_brand ORDER BY p_partkey) = 1
           AND NOT EXISTS (SELECT 1 FROM old WHERE old.p_name = new.p_name
                           AND old.p_brand = new.p_brand) AS accepted
    FROM new""")
def accept_unique(t):
    cols = ["p_partkey", "p_name", "p_brand"]
    accepted, rejected = quality.accept_unique(
        t.part.filter("p_size <= 40").select(*cols), t.part.filter("p_size > 40"),
        ["p_name", "p_brand"], ["p_partkey"])
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False)))
