import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow import sources

SHEET = "id int, name string, notes string, status string"
HELL = ('Hello "Quote" and ""double quotes""\nLine2 after newline\nHere is a TAB:\t[TAB]\n'
        "Here is NBSP:59 000\nEmoji: \U0001F680  Chinese: 淘宝")


def test_messy_sheet(spark, tmp_path, rows):
    sheet = spark.createDataFrame(
        [(1, "Alice", HELL, "OK"), (2, "Bob", "Normal row after hell cell", "OK"),
         (None, None, None, None), (3, "Charlie", "Another normal row", "OK")], SHEET)
    sources.write_csv(sheet, str(tmp_path / "s"))
    got = sources.ingest_messy(spark, str(tmp_path / "s"), sheet.schema)
    assert rows(got) == [(1, "Alice", HELL, "OK"), (2, "Bob", "Normal row after hell cell", "OK"),
                         (3, "Charlie", "Another normal row", "OK")]
    number = got.filter("id = 1").select(sources.files.ungroup_digits("notes")).first()[0]
    assert "NBSP:59000" in number


def test_csv_keeps_spaces_nulls_and_empty_text(spark, tmp_path, rows):
    schema = T.StructType.fromDDL("i int, s string, t timestamp_ntz, d double")
    df = spark.sql("""SELECT * FROM VALUES (1, ' a ', TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', 0.1D),
                      (2, '', NULL, NULL), (3, NULL, NULL, -1e300D), (4, '"', NULL, 1D)
                      AS v(i, s, t, d)""")
    sources.write_csv(df, str(tmp_path / "c"))
    assert rows(sources.read_csv(spark, str(tmp_path / "c"), schema)) == rows(df)


@pytest.mark.parametrize("bad", ["x,b", "1,b,c", "1"])
def test_bad_csv_is_rejected_or_quarantined(spark, tmp_path, bad):
    (tmp_path / "f.csv").write_text(f"i,s\n7,ok\n{bad}\n")
    schema = T.StructType.fromDDL("i int, s string")
    with pytest.raises(Exception, match="unreadable row"):
        sources.read_csv(spark, str(tmp_path), schema).select("s").collect()
    good, wrong = sources.split_corrupt(
        sources.read_csv(spark, str(tmp_path), schema, on_error="quarantine"))
    assert [tuple(r) for r in good.collect()] == [(7, "ok")]
    assert [r["_corrupt_record"] for r in wrong.collect()] == [bad]


def test_feed_files_are_the_document_in_order(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), F.lit("news").alias("feed"),
                                F.format_string("t<%d>", "id").alias("title"),
                                F.lit("http://x/?a&b").alias("url"), F.lit("d").alias("body"))
    lines = sources.render_rss(df, "feed", "id", "title", "url", "body")
    sources.write_feed(lines, str(tmp_path / "out"))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/feed=news/*.txt")))
    parts = text.strip().split("\n")
    assert parts[0].startswith('<rss version="2.0"><channel><title>news')
    assert parts[-1] == "</channel></rss>"
    assert [p.split("&lt;")[1].split("&gt;")[0] for p in parts[1:-1]] == [str(i) for i in range(50)]
    assert "http://x/?a&amp;b" in parts[1]


def test_calendar_escapes(spark):
    df = spark.sql("SELECT 1L AS id, 'c' AS feed, 'a;b,c\\\\d\ne' AS title, "
                   "TIMESTAMP_NTZ'2024-01-01 23:30:00' AS s, TIMESTAMP_NTZ'2024-01-02 00:00:00' AS e")
    text = sources.render_ics(df, "feed", "id", "title", "s", "e").filter("part = 1").first()["text"]
    assert "SUMMARY:a\\;b\\,c\\\\d\\ne" in text
    assert "DTSTART:20240101T233000" in text


def test_manifest(spark, tmp_path):
    for name, size in [("shot.PNG", 3), ("trace.zip", 1), ("README", 5), ("a.b.html", 2)]:
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["file_name"]: (r["artifact_type"], r["mime_type"], r["size_bytes"])
           for r in sources.artifact_manifest(spark, str(tmp_path)).collect()}
    assert got == {"shot.PNG": ("screenshot", "image/png", 3),
                   "trace.zip": ("trace", "application/zip", 1),
                   "README": ("other", "application/octet-stream", 5),
                   "a.b.html": ("report", "text/html", 2)}
