"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow import sources
from recordflow.plans.registry import query
from recordflow.schemas import schema_of
from recordflow.session import scratch
from recordflow.streaming.jobs import run_stream


@query("table_scan", "SELECT * FROM lineitem")
def table_scan(t):
    return sources.scan(t.spark, t.folder, "lineitem")


@query("csv_round_trip", "SELECT * FROM documents")
def csv_round_trip(t):
    path = scratch(t.spark, "csv")
    sources.write_csv(t.documents, path)
    return sources.read_csv(t.spark, path, schema_of("documents"))


@query("csv_quarantine", """
    SELECT c_custkey, c_name, c_nationkey = 3 AS is_bad FROM customer""")
def csv_quarantine(t):
    path = scratch(t.spark, "csv")
    balance = F.when(F.col("c_nationkey") == 3, "n/a").otherwise(
        F.col("c_acctbal").cast("string"))
    sources.write_csv(t.customer.withColumn("c_acctbal", balance), path)
    rows = sources.read_csv(t.spark, path, schema_of("customer"), on_error="quarantine")
    good, bad = sources.split_corrupt(rows)
    cols = ["c_custkey", "c_name"]
    return good.select(*cols, F.lit(False).alias("is_bad")).unionByName(
        bad.select(*cols, F.lit(True).alias("is_bad")))


@query("json_round_trip", "SELECT * FROM orders")
def json_round_trip(t):
    path = scratch(t.spark, "json")
    sources.write_json(t.orders, path)
    return sources.read_json(t.spark, path, schema_of("orders"))


@query("xml_round_trip", "SELECT * FROM part")
def xml_round_trip(t):
    path = scratch(t.spark, "xml")
    sources.write_xml(t.part, path, "part")
    return sources.read_xml(t.spark, path, "part", schema_of("part"))


def _escaped(column: str) -> str:
    return (f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


@query("rss_feed", f"""
    WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS feed, * FROM pages),
    heads AS (SELECT DISTINCT feed FROM p)
    SELECT feed, 1 AS part, page_id AS seq,
           '<item><title>page ' || page_id || '</title><link>' || {_escaped('url')}
           || '</link><description>' || {_escaped('html')} || '</description></item>' AS text
    FROM p
    UNION ALL SELECT feed, 0, 0, '<rss version="2.0"><channel><title>' || {_escaped('feed')}
           || '</title>' FROM heads
    UNION ALL SELECT feed, 2, 0, '</channel></rss>' FROM heads""")
def rss_feed(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    pages = t.pages.withColumn("feed", host).withColumn(
        "title", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return sources.render_rss(pages, "feed", "page_id", "title", "url", "html")


@query("ics_calendar", """
    WITH heads AS (SELECT DISTINCT event_type AS feed FROM events)
    SELECT event_type AS feed, 1 AS part, event_id AS seq,
           'BEGIN:VEVENT' || chr(10) || 'UID:' || event_id
           || chr(10) || 'DTSTART:' || strftime(ts + INTERVAL 1 HOUR, '%Y%m%dT%H%M%S')
           || chr(10) || 'DTEND:' || strftime(ts + INTERVAL 90 MINUTE, '%Y%m%dT%H%M%S')
           || chr(10) || 'SUMMARY:user ' || user_id || '\\, ' || event_type
           || chr(10) || 'END:VEVENT' AS text
    FROM events
    UNION ALL SELECT feed, 0, 0, 'BEGIN:VCALENDAR' || chr(10) || 'VERSION:2.0' || chr(10)
           || 'X-WR-CALNAME:' || feed || chr(10) || 'CALSCALE:GREGORIAN' || chr(10)
           || 'METHOD:PUBLISH' FROM heads
    UNION ALL SELECT feed, 2, 0, 'END:VCALENDAR' FROM heads""")
def ics_calendar(t):
    events = t.events.withColumn("stop", F.col("ts") + F.expr("INTERVAL '30' MINUTE")).withColumn(
        "title", F.format_string("user %s, %s", "user_id", "event_type"))
    return sources.render_ics(events, "event_type", "event_id", "title", "ts", "stop",
                              shift_hours=1)


@query("messy_ingest", r"""
    SELECT doc_id AS id, 'src ' || source AS name,
           nullif(regexp_replace('"' || text || '"' || chr(10) || chr(9) || '[TAB]',
                  '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$',
                  '', 'g'), '') AS notes,
           n_chars * 1000 AS amount
    FROM documents""")
def messy_ingest(t):
    """Documents as a messy sheet: padded names, quoted multi-line notes, grouped numbers, and
    an empty row beside every row."""
    nbsp = "\u00a0"
    sheet = t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit(f"{nbsp} src "), "source", F.lit(f"\t{nbsp}")).alias("name"),
        F.concat(F.lit('"'), "text", F.lit('"\n\t[TAB]')).alias("notes"),
        F.concat(F.col("n_chars").cast("string"), F.lit(f"{nbsp}000")).alias("amount"))
    empty = sheet.select(*[F.lit(None).cast("string").alias(c) for c in sheet.columns])
    path = scratch(t.spark, "sheet")
    sources.write_csv(sheet.unionByName(empty), path)
    return sources.ingest_messy(
        t.spark, path,
        T.StructType.fromDDL("id bigint, name string, notes string, amount bigint"))


@query("event_stream", "SELECT * FROM events")
def event_stream(t):
    out = scratch(t.spark, "events")
    # A pattern that matches just this table: a stream takes a folder or a pattern.
    stream = sources.event_stream(t.spark, f"{t.folder}/events.parque[t]", schema_of("events"))

    def step(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_stream(stream, step, scratch(t.spark, "checkpoint"))
    return t.spark.read.schema(schema_of("events")).parquet(out).drop("batch")


@query("page_artifacts", r"""
    WITH f AS (SELECT page_id, url, length(html) AS size, regexp_extract(url, '[^/]*$') AS name
               FROM pages),
    e AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) END AS ext
          FROM f)
    SELECT page_id, name AS file_name, url AS file_path,
           CASE ext WHEN 'zip' THEN 'trace' WHEN 'png' THEN 'screenshot' WHEN 'jpg' THEN 'screenshot'
                WHEN 'webm' THEN 'video' WHEN 'mp4' THEN 'video' WHEN 'out' THEN 'stdout'
                WHEN 'err' THEN 'stderr' WHEN 'html' THEN 'report' WHEN 'pdf' THEN 'report'
                ELSE 'other' END AS artifact_type,
           CASE ext WHEN 'zip' THEN 'application/zip' WHEN 'png' THEN 'image/png'
                WHEN 'jpg' THEN 'image/jpeg' WHEN 'webm' THEN 'video/webm' WHEN 'mp4' THEN 'video/mp4'
                WHEN 'out' THEN 'text/plain' WHEN 'err' THEN 'text/plain' WHEN 'html' THEN 'text/html'
                WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
           coalesce(size, 0)::BIGINT AS size_bytes FROM e""")
def page_artifacts(t):
    """Web pages as artifacts, by what their address ends in."""
    columns = sources.artifact_columns("url", F.length("html"))
    return t.pages.select("page_id", *[c.alias(n) for n, c in columns.items()])


@query("artifact_manifest")
def artifact_manifest(t):
    return sources.artifact_manifest(t.spark, t.folder)
