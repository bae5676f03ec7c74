"""Payment, entitlement and run events: batch results, and streams that must equal them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.plans.reads import key_number
from recordflow.plans.registry import query
from recordflow.plans.texts import capture_payload
from recordflow.schemas import schema_of
from recordflow.session import scratch
from recordflow.sources import event_stream
from recordflow.streaming import jobs, payments, triage
from recordflow.streaming.entitlements import COLUMNS, entitlement_ledger
from recordflow.streaming.runs import run_state, with_duration
from recordflow.streaming.state import StateTable

HEADERS_SQL = "event_type <> 'signup' OR value >= 5"


def _pushed(events):
    """Events as pushed requests; some have no body, lack headers or hold broken JSON."""
    body = (F.when(F.col("event_type") == "error", "")
            .when(F.col("value") > 60, F.substring("props", 1, 5)).otherwise(F.col("props")))
    names = F.array(*[F.lit(h) for h in triage.REQUIRED_HEADERS])
    values = F.when(F.expr(HEADERS_SQL), F.array_repeat(F.lit("x"), 5)).otherwise(
        F.array(*[F.lit("x")] * 4, F.lit("")))
    return events.select("event_id", "props", body.alias("body"),
                         F.map_from_arrays(names, values).alias("headers"))


_TRIAGE_SQL = f"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'empty_body'
           WHEN NOT ({HEADERS_SQL}) THEN 'missing_headers'
           WHEN value > 60 THEN 'invalid_json' END AS reason FROM events"""


@query("event_triage", _TRIAGE_SQL)
def event_triage(t):
    good, dead = triage.triage(_pushed(t.events))
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(
        dead.select("event_id", "reason"))


@query("event_triage_stream", _TRIAGE_SQL)
def event_triage_stream(t):
    good, dead = scratch(t.spark, "good"), scratch(t.spark, "dead")
    jobs.run_stream(_pushed(_event_stream(t)), jobs.triage_step(good, dead),
                    scratch(t.spark, "checkpoint"))
    id_only = T.StructType.fromDDL("event_id bigint")
    dead_rows = T.StructType.fromDDL("event_id bigint, reason string")
    return (t.spark.read.schema(id_only).parquet(good)
            .select("event_id", F.lit(None).cast("string").alias("reason"))
            .unionByName(t.spark.read.schema(dead_rows).parquet(dead).select(
                "event_id", "reason")))


def _event_stream(t):
    return event_stream(t.spark, f"{t.folder}/events.parque[t]", schema_of("events"))


def _payment_events(events):
    """Events as payment events: purchases complete, errors deny, sign-ups refund; clicks are of
    a kind not used. Views complete by order id alone and have a capture id of their own."""
    k = key_number().cast("string")
    kind = (F.when(F.col("event_type").isin("purchase", "view"), payments.COMPLETED)
            .when(F.col("event_type") == "error", payments.DENIED)
            .when(F.col("event_type") == "signup", payments.REFUNDED)
            .otherwise("CHECKOUT.ORDER.APPROVED"))
    capture = (F.when(F.col("value") < 0.5, "")
               .when(F.col("event_type") == "view",
                     F.concat(F.lit("L"), F.col("user_id").cast("string")))
               .otherwise(F.concat(F.lit("C"), k)))
    order = F.when(F.col("event_type") == "view",
                   F.concat(F.lit("O"), (F.col("user_id") + 200).cast("string")))
    return events.select("event_id", "ts", kind.alias("event_type"), capture.alias("capture_id"),
                         order.alias("order_id"))


def _payments(t):
    """Orders as payments: the final ones have a capture id, the open ones only an order id."""
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("O"), key).alias("provider_order_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), key))
        .alias("provider_capture_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "captured").otherwise("created")
        .alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("paid_on"),
        F.lit(None).cast("timestamp_ntz").alias("refunded_on"))


_EVENT_SQL = """
    e AS (SELECT event_id, ts, user_id,
          CASE event_type WHEN 'purchase' THEN 'captured' WHEN 'view' THEN 'captured'
               WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'refunded' END AS state,
          CASE WHEN value < 0.5 THEN NULL WHEN event_type = 'view' THEN 'L' || user_id
               ELSE 'C' || json_extract_string(props, '$.k') END AS cap,
          CASE WHEN event_type = 'view' THEN 'O' || (user_id + 200) END AS ord FROM events),
    p AS (SELECT o_orderkey AS id, 'O' || o_orderkey AS ord, o_custkey,
          CASE WHEN o_orderstatus = 'F' THEN 'C' || o_orderkey END AS cap,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'captured' ELSE 'created' END AS status
          FROM orders),
    learned AS (SELECT p.id, e.cap, (e.ts, e.event_id) AS since FROM e JOIN p ON p.ord = e.ord
          WHERE e.state = 'captured' AND e.cap IS NOT NULL AND p.cap IS NULL
          AND e.cap NOT IN (SELECT cap FROM p WHERE cap IS NOT NULL)
          QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY e.ts, e.event_id) = 1),
    m AS (SELECT e.*, CASE WHEN e.state IS NOT NULL THEN coalesce(a.id, l.id,
               CASE WHEN e.state = 'captured' AND e.cap IS NOT NULL THEN b.id END) END AS pid
          FROM e LEFT JOIN p a ON a.cap = e.cap
          LEFT JOIN learned l ON l.cap = e.cap AND l.since < (e.ts, e.event_id)
          LEFT JOIN p b ON b.ord = e.ord)"""


@query("payment_actions", f"""
    WITH {_EVENT_SQL}
    SELECT event_id, state IS DISTINCT FROM 'captured' OR pid IS NOT NULL AS ok,
           CASE WHEN state = 'captured' AND pid IS NOT NULL THEN 'granted'
                WHEN state = 'failed' THEN 'marked_failed'
                WHEN state = 'refunded' THEN 'revoked_after_refund' ELSE 'ignored' END AS action,
           CASE WHEN state IS NULL THEN 'event_not_used' WHEN state <> 'captured' THEN NULL
                WHEN cap IS NULL THEN 'missing_capture_id'
                WHEN pid IS NULL THEN 'payment_not_found' END AS reason FROM m""")
def payment_actions(t):
    return payments.classify_actions(_payment_events(t.events), _payments(t))


def _state_sql(moves: str) -> str:
    return f"""
    WITH {_EVENT_SQL}, h AS ({moves}),
    seq AS (SELECT h.*, coalesce(lag(state) OVER (PARTITION BY pid ORDER BY ts, event_id), p.status)
                AS prev FROM h JOIN p ON p.id = h.pid),
    s AS (SELECT pid, max_by(state, (ts, event_id)) AS state,
                 max(ts) FILTER (state = 'captured' AND prev <> 'captured') AS paid_on,
                 max(ts) FILTER (state = 'refunded') AS refunded_on FROM seq GROUP BY 1)
    SELECT p.id, p.o_custkey AS user_id, p.ord AS provider_order_id,
           coalesce(p.cap, l.cap) AS provider_capture_id, coalesce(s.state, p.status) AS status,
           s.paid_on, s.refunded_on
    FROM p LEFT JOIN s ON s.pid = p.id LEFT JOIN learned l ON l.id = p.id"""


_ALL_MOVES = "SELECT * FROM m WHERE pid IS NOT NULL"


@query("payment_state", _state_sql(_ALL_MOVES))
def payment_state(t):
    return payments.payment_state(_payment_events(t.events), _payments(t))


@query("payment_state_strict", _state_sql("""
    SELECT m.* FROM m LEFT JOIN (SELECT pid, min((ts, event_id)) AS stop FROM m
        WHERE state = 'refunded' GROUP BY 1) r ON r.pid = m.pid
    WHERE m.pid IS NOT NULL AND (stop IS NULL OR (ts, event_id) <= stop)"""))
def payment_state_strict(t):
    return payments.payment_state(_payment_events(t.events), _payments(t), strict=True)


@query("payment_state_stream", _state_sql(_ALL_MOVES))
def payment_state_stream(t):
    store = jobs.payment_store(t.spark, scratch(t.spark, "payments"), _payments(t))
    jobs.run_stream(_payment_events(_event_stream(t)), jobs.payment_step(store),
                    scratch(t.spark, "checkpoint"))
    return store.current("payments")


def _webhooks(events):
    """Events as pushed payment requests. Every tenth has no body, every eleventh lacks a header,
    every thirteenth is cut off; errors come without an order link."""
    kind = (F.when(F.col("event_type").isin("purchase", "view"), payments.COMPLETED)
            .when(F.col("event_type") == "error", payments.DENIED)
            .when(F.col("event_type") == "signup", payments.REFUNDED)
            .otherwise("CHECKOUT.ORDER.APPROVED"))
    user = F.col("user_id").cast("string")
    capture = F.when(F.col("event_type") == "view", F.concat(F.lit("L"), user)).otherwise(
        F.concat(F.lit("C"), key_number().cast("string")))
    link = F.when(F.col("event_type") == "view", F.format_string(
        ',"links":[{"rel":"self","href":"x"},{"rel":"up","href":"https://p.example/o/O%s/"}]',
        (F.col("user_id") + 200).cast("string"))).otherwise("")
    body = F.format_string('{"event_type":"%s","resource":{"id":"%s"%s}}', kind, capture, link)
    n = F.col("event_id")
    names = F.array(*[F.lit(h) for h in triage.REQUIRED_HEADERS])
    given = F.when(n % 11 == 0, F.array(*[F.lit("x")] * 4, F.lit(""))).otherwise(
        F.array_repeat(F.lit("x"), 5))
    return events.select(
        "event_id", "ts", F.when(n % 10 == 0, "").when(n % 13 == 0, F.substring(body, 1, 40))
        .otherwise(body).alias("body"), F.map_from_arrays(names, given).alias("headers"))


def _job_payments(t):
    """Orders as payments of 50 users, with notes and payloads."""
    return _payments(t).select(
        "id", (F.col("id") % 50).alias("user_id"), "provider_order_id", "provider_capture_id",
        "status", "paid_on", "refunded_on", F.lit("{}").alias("provider_payload_json"),
        F.lit("").alias("notes"))


_JOB_EVENTS_SQL = """
    pushed AS (SELECT event_id, ts, user_id,
          CASE event_type WHEN 'purchase' THEN 'PAYMENT.CAPTURE.COMPLETED'
               WHEN 'view' THEN 'PAYMENT.CAPTURE.COMPLETED' WHEN 'error' THEN 'PAYMENT.CAPTURE.DENIED'
               WHEN 'signup' THEN 'PAYMENT.CAPTURE.REFUNDED' ELSE 'CHECKOUT.ORDER.APPROVED' END
               AS kind,
          CASE WHEN event_type = 'view' THEN 'L' || user_id
               ELSE 'C' || json_extract_string(props, '$.k') END AS cap,
          CASE WHEN event_type = 'view' THEN 'O' || (user_id + 200) END AS ord FROM events
          WHERE event_id % 10 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0),
    e AS (SELECT *, CASE kind WHEN 'PAYMENT.CAPTURE.COMPLETED' THEN 'captured'
               WHEN 'PAYMENT.CAPTURE.DENIED' THEN 'failed'
               WHEN 'PAYMENT.CAPTURE.REFUNDED' THEN 'refunded' END AS state,
          '{"event_type":"' || kind || '","resource":{"id":"' || cap || '"' || CASE WHEN ord IS NULL
               THEN '' ELSE ',"links":[{"rel":"self","href":"x"},{"rel":"up","href":"https://p.example/o/'
               || ord || '/"}]' END || '}}' AS payload FROM pushed)"""
_, _, _EVENT_TAIL = _EVENT_SQL.partition("    p AS (")


@query("payment_job_stream", f"""
    WITH RECURSIVE {_JOB_EVENTS_SQL},
    p AS ({_EVENT_TAIL},
    h AS (SELECT m.*, p.status AS before, p.id % 50 AS owner FROM m JOIN p ON p.id = m.pid),
    seq AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY pid ORDER BY ts, event_id), before)
                AS prev FROM h),
    s AS (SELECT pid, max_by(state, (ts, event_id)) AS state,
                 max(ts) FILTER (state = 'captured' AND prev <> 'captured') AS paid_on,
                 max(ts) FILTER (state = 'refunded') AS refunded_on FROM seq GROUP BY 1),
    c AS (SELECT pid, payload, CASE state WHEN 'captured' THEN 'Marked captured from webhook.'
                 WHEN 'failed' THEN 'Capture denied webhook received.'
                 ELSE 'Refund webhook received.' END AS notes
          FROM seq WHERE state <> 'captured' OR prev <> 'captured'
          QUALIFY row_number() OVER (PARTITION BY pid ORDER BY ts DESC, event_id DESC) = 1),
    x AS (SELECT owner, (ts, event_id) AS pos, ts, event_id, pid, state FROM h
          WHERE state IN ('captured', 'refunded')),
    g AS (SELECT a.owner, a.event_id, a.ts, a.pid, a.pos, min(r.pos) AS stop
          FROM x a LEFT JOIN x r ON r.pid = a.pid AND r.state = 'refunded' AND r.pos > a.pos
          WHERE a.state = 'captured' GROUP BY ALL),
    l AS (SELECT g.owner, g.event_id, g.ts, g.pid, g.pos, g.stop, min(n.pos) AS nxt
          FROM g LEFT JOIN x n ON n.owner = g.owner AND n.state = 'captured' AND n.pos > g.stop
          GROUP BY ALL),
    walk(owner, pos, event_id, pid, stop, nxt) AS (
        SELECT l.owner, l.pos, l.event_id, l.pid, l.stop, l.nxt
        FROM l JOIN (SELECT owner, min(pos) AS first FROM g GROUP BY 1) f
             ON f.owner = l.owner AND f.first = l.pos
        UNION ALL
        SELECT l.owner, l.pos, l.event_id, l.pid, l.stop, l.nxt
        FROM walk w JOIN l ON l.owner = w.owner AND l.pos = w.nxt),
    held AS (SELECT pid, count(*) AS n_grants, max(event_id) AS last_grant,
          max_by(CASE WHEN stop IS NULL THEN 'Granted after successful PayPal capture.'
                      ELSE 'Entitlement revoked after refund.' END, pos) AS reason
          FROM walk GROUP BY 1)
    SELECT p.id, coalesce(p.cap, l.cap) AS provider_capture_id, coalesce(s.state, p.status) AS status,
           s.paid_on, s.refunded_on, coalesce(c.payload, '{{}}') AS provider_payload_json,
           coalesce(c.notes, '') AS notes, n_grants,
           CASE WHEN n_grants IS NOT NULL THEN 'lifetime_access' END AS code, reason
    FROM p LEFT JOIN s ON s.pid = p.id LEFT JOIN c ON c.pid = p.id
    LEFT JOIN learned l ON l.id = p.id LEFT JOIN held ON held.pid = p.id""")
def payment_job_stream(t):
    """Pushed requests end to end: every payment with what its events and grants left on it."""
    store = jobs.payment_store(t.spark, scratch(t.spark, "job"), _job_payments(t))
    jobs.run_stream(_webhooks(_event_stream(t)), jobs.webhook_step(store),
                    scratch(t.spark, "checkpoint"))
    held = store.current("ledger").groupBy(F.col("payment_id").alias("id")).agg(
        F.count("*").alias("n_grants"), F.max("code").alias("code"),
        F.max_by("reason", F.struct("granted_on", "grant_event_id")).alias("reason"))
    return store.current("payments").join(held, "id", "left").select(
        "id", "provider_capture_id", "status", "paid_on", "refunded_on", "provider_payload_json",
        "notes", "n_grants", "code", "reason")


def _ledger_events(events):
    """Purchases grant, sign-ups revoke; each user has three payments."""
    kind = F.when(F.col("event_type") == "purchase", "grant").when(
        F.col("event_type") == "signup", "revoke")
    return events.select("event_id", "ts", "user_id", (key_number() % 3).alias("payment_id"),
                         kind.alias("kind"))


# Follows each user from grant to revocation to the next grant.
_LEDGER_SQL = """
    WITH RECURSIVE e AS (SELECT user_id, (ts, event_id) AS pos, ts, event_id,
        json_extract(props, '$.k')::BIGINT % 3 AS pay, event_type AS kind FROM events
        WHERE event_type IN ('purchase', 'signup')),
    g AS (SELECT c.user_id, c.event_id, c.ts, c.pay, c.pos, min(r.pos) AS stop
          FROM e c LEFT JOIN e r ON r.user_id = c.user_id AND r.pay = c.pay
               AND r.kind = 'signup' AND r.pos > c.pos
          WHERE c.kind = 'purchase' GROUP BY ALL),
    l AS (SELECT g.user_id, g.event_id, g.ts, g.pay, g.pos, g.stop, min(n.pos) AS nxt
          FROM g LEFT JOIN e n ON n.user_id = g.user_id AND n.kind = 'purchase'
               AND n.pos > g.stop GROUP BY ALL),
    walk(user_id, pos, event_id, ts, pay, stop, nxt) AS (
        SELECT l.user_id, l.pos, l.event_id, l.ts, l.pay, l.stop, l.nxt
        FROM l JOIN (SELECT user_id, min(pos) AS first FROM g GROUP BY 1) f
             ON f.user_id = l.user_id AND f.first = l.pos
        UNION ALL
        SELECT l.user_id, l.pos, l.event_id, l.ts, l.pay, l.stop, l.nxt
        FROM walk w JOIN l ON l.user_id = w.user_id AND l.pos = w.nxt)
    SELECT walk.user_id, pay AS payment_id, walk.event_id AS grant_event_id,
           walk.ts AS granted_on, x.ts AS revoked_on,
           CASE WHEN stop IS NULL THEN 'active' ELSE 'revoked' END AS status,
           'lifetime_access' AS code,
           CASE WHEN stop IS NULL THEN 'Granted after successful PayPal capture.'
                ELSE 'Entitlement revoked after refund.' END AS reason
    FROM walk LEFT JOIN (SELECT pos AS at_end, ts FROM e) x ON x.at_end = stop"""


@query("entitlement_ledger", _LEDGER_SQL)
def ledger(t):
    return entitlement_ledger(_ledger_events(t.events))


@query("entitlement_ledger_chained", _LEDGER_SQL)
def ledger_chained(t):
    """Every event delivered twice."""
    events = _ledger_events(t.events)
    return entitlement_ledger(events.unionAll(events))


@query("entitlement_ledger_stream", _LEDGER_SQL)
def ledger_stream(t):
    store = jobs.ledger_store(t.spark, scratch(t.spark, "ledger"))
    jobs.run_stream(_ledger_events(_event_stream(t)), jobs.entitlement_step(store),
                    scratch(t.spark, "checkpoint"))
    return store.current("ledger").select(*COLUMNS)


def _run_events(events):
    """Events as run events: one run per user and number, one scenario per user."""
    kind = (F.when(F.col("event_type") == "signup", "started")
            .when(F.col("event_type").isin("purchase", "error"), "finished").otherwise("status"))
    status = (F.when(F.col("event_type") == "purchase", "passed")
              .when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "click", "executing")
              .when(F.col("event_type") == "view", "compiling"))
    return events.select((F.col("user_id") * 100 + key_number() % 10).alias("run_id"),
                         F.col("user_id").alias("scenario_id"), "event_id", "ts",
                         kind.alias("kind"), status.alias("status"))


_RUN_SQL = """
    SELECT run_id, min(user_id) AS scenario_id, max_by(status, (ts, event_id)) AS status,
           min(ts) FILTER (event_type = 'signup') AS started_on,
           max(ts) FILTER (event_type IN ('purchase', 'error')) AS finished_on,
           floor((epoch_us(max(ts) FILTER (event_type IN ('purchase', 'error')))
           - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 1000)::BIGINT AS duration_ms
    FROM (SELECT *, user_id * 100 + json_extract(props, '$.k')::BIGINT % 10 AS run_id,
          CASE event_type WHEN 'signup' THEN 'precheck' WHEN 'purchase' THEN 'passed'
               WHEN 'error' THEN 'failed' WHEN 'click' THEN 'executing' ELSE 'compiling' END
              AS status FROM events) GROUP BY run_id"""


@query("run_state", _RUN_SQL)
def runs(t):
    return with_duration(run_state(_run_events(t.events))).drop("last_at")


@query("run_state_stream", _RUN_SQL)
def runs_stream(t):
    schema = run_state(_run_events(t.events)).schema
    table = StateTable(t.spark, scratch(t.spark, "runs"), ["run_id"], schema)
    jobs.run_stream(_run_events(_event_stream(t)), jobs.run_step(table),
                    scratch(t.spark, "checkpoint"))
    return with_duration(table.current()).drop("last_at")


@query("upserted_state", """
    SELECT user_id, event_id, ts, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def upserted_state(t):
    """A state table fed one day of events at a time, the last rows per user of each."""
    table = StateTable(t.spark, scratch(t.spark, "latest"), ["user_id"],
                       schema_of("events"), full_every=2)
    last = t.events.groupBy("user_id", F.ceil(F.dayofmonth("ts") / 11).alias("part")).agg(
        F.max_by(F.struct("event_id", "ts", "event_type", "value", "props"), "event_id")
        .alias("r")).select("user_id", "part", "r.*")
    for batch in (1, 2, 3):
        for _ in range(2):  # a replayed batch changes nothing
            table.upsert(last.filter(F.col("part") == batch), batch)
    return table.current().select("user_id", "event_id", "ts", "event_type", "value", "props")


@query("apply_captures", """
    SELECT o_orderkey AS id,
           CASE WHEN o_orderstatus <> 'O' THEN 'C' || o_orderkey END AS provider_capture_id,
           CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey || '@example.org'
                ELSE 'old@example.org' END AS payer_email,
           CASE WHEN o_orderstatus = 'O' THEN 79.0 ELSE printf('%.2f', o_totalprice)::DOUBLE END
               AS gross_amount,
           CASE WHEN o_orderstatus = 'P' THEN printf('%.2f', o_totalprice / 50)::DOUBLE ELSE 0.0
           END AS fee_amount,
           CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE printf('%.2f', o_totalprice)::DOUBLE END
               AS net_amount,
           CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'captured' END AS status,
           CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS paid_on,
           CASE WHEN o_orderstatus = 'O' THEN 'Capture returned non-completed status: PENDING'
                ELSE 'Order captured successfully.' END AS notes FROM orders""")
def apply_captures(t):
    key = F.col("o_orderkey").cast("string")
    base = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("O"), key).alias("provider_order_id"),
        F.lit(None).cast("string").alias("provider_capture_id"),
        F.lit("old@example.org").alias("payer_email"), F.lit(79.0).alias("gross_amount"),
        F.lit(0.0).alias("fee_amount"), F.lit(0.0).alias("net_amount"),
        F.lit("created").alias("status"), F.lit(None).cast("timestamp_ntz").alias("paid_on"),
        F.lit("{}").alias("provider_payload_json"), F.lit("").alias("notes"))
    responses = t.orders.select(
        F.concat(F.lit("O"), key).alias("order_id"), capture_payload().alias("payload"),
        F.lit("2030-01-01").cast("timestamp_ntz").alias("arrived_on"))
    return payments.apply_captures(base, responses).drop("provider_order_id",
                                                         "provider_payload_json")
