"""RSS and calendar feeds as ordered lines.

A feed is rows (feed, part, seq, text): part 0 is its head, 1 its items, 2 its tail. Items are
never gathered into one value, so a feed may be as long as the table behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ICS_TIME = "yyyyMMdd'T'HHmmss"
RSS_TIME = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"


def xml_escape(c) -> Column:
    value = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, value)


def ics_escape(c) -> Column:
    value = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    pairs = [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r", ""), ("\n", "\\n")]
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, value)


def _with_ends(items: DataFrame, head: Column, tail: Column) -> DataFrame:
    feeds = items.select("feed").distinct()
    ends = feeds.select(
        "feed",
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"),
                     head.alias("text")),
            F.struct(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("seq"),
                     tail.alias("text")))).alias("end"),
    ).select("feed", "end.*")
    return items.unionByName(ends)


def render_rss(df: DataFrame, feed, seq, title, link, description, date=None) -> DataFrame:
    """Rows to RSS items, one feed per ``feed`` value."""
    fields = [("title", xml_escape(title)), ("link", xml_escape(link)),
              ("description", xml_escape(description))]
    if date is not None:
        fields.append(("pubDate", F.date_format(date, RSS_TIME)))
    body = F.concat(*[part for tag, value in fields
                      for part in (F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))])
    items = df.select(
        F.col(feed).alias("feed"), F.lit(1).alias("part"), F.col(seq).cast("bigint").alias("seq"),
        F.concat(F.lit("<item>"), body, F.lit("</item>")).alias("text"))
    head = F.concat(F.lit('<rss version="2.0"><channel><title>'), xml_escape("feed"),
                    F.lit("</title>"))
    return _with_ends(items, head, F.lit("</channel></rss>"))


def render_ics(df: DataFrame, feed, uid, title, start, stop, shift_hours: float = 0) -> DataFrame:
    """Rows to calendar entries; ``shift_hours`` moves both ends of each entry."""
    shift = F.make_dt_interval(secs=F.lit(3600.0 * shift_hours))
    text = F.concat(
        F.lit("BEGIN:VEVENT\nUID:"), F.col(uid).cast("string"),
        F.lit("\nDTSTART:"), F.date_format(F.col(start) + shift, ICS_TIME),
        F.lit("\nDTEND:"), F.date_format(F.col(stop) + shift, ICS_TIME),
        F.lit("\nSUMMARY:"), ics_escape(title), F.lit("\nEND:VEVENT"))
    items = df.select(F.col(feed).alias("feed"), F.lit(1).alias("part"),
                      F.col(uid).cast("bigint").alias("seq"), text.alias("text"))
    head = F.concat(F.lit("BEGIN:VCALENDAR\nVERSION:2.0\nX-WR-CALNAME:"), ics_escape("feed"),
                    F.lit("\nCALSCALE:GREGORIAN\nMETHOD:PUBLISH"))
    return _with_ends(items, head, F.lit("END:VCALENDAR"))


def write_feed(lines: DataFrame, path: str) -> None:
    """One folder per feed; its files, read in name order, are the document."""
    (lines.repartitionByRange("feed", "part", "seq")
     .sortWithinPartitions("feed", "part", "seq")
     .select("feed", "text").write.partitionBy("feed").text(path))
