"""Range joins, deep pages, child rows, cascades over several columns, one-parse JSON, artifacts,
names and addresses in batches of requests."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordflow import sources
from recordflow.functions import jsonx
from recordflow.operators import change, join, select, services, users
from recordflow.schemas import Edge


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp_ntz"])
def test_bands_of_all_widths(spark, rows, kind):
    rng = random.Random(3)
    make = {"bigint": lambda x: int(x), "double": lambda x: x / 7,
            "timestamp_ntz": lambda x: datetime(2020, 1, 1) + timedelta(seconds=x)}[kind]
    top = 10 ** 6
    bands = [(0, make(0), make(top)), (1, make(5), make(5)), (2, None, make(3)), (3, make(9), make(2))]
    for i in range(4, 60):
        low = rng.randrange(top)
        bands.append((i, make(low), make(low + rng.choice([1, 2, 50, top // 3]))))
    points = [(i, make(rng.randrange(-5, top + top // 3))) for i in range(150)]
    points += [(500 + b[0], b[1]) for b in bands[4:20]] + [(600 + b[0], b[2]) for b in bands[4:20]]
    points += [(700, None)]
    if kind == "double":
        bands += [(90, float("-inf"), 3.0), (91, 100.0, float("inf")), (92, float("nan"), 1.0)]
        points += [(701, float("inf")), (702, float("-inf")), (703, float("nan")), (704, -1e300)]
    got = join.band_join(spark.createDataFrame(points, f"p long, x {kind}"), "x",
                         spark.createDataFrame(bands, f"b long, low {kind}, high {kind}"), "low", "high")
    ok = lambda v: v is not None and v == v
    want = [(p, b) for p, x in points for b, low, high in bands
            if ok(x) and ok(low) and ok(high) and low <= x < high]
    assert rows(got, "p", "b") == sorted(want, key=repr)


def test_a_band_is_few_rows_and_no_bands_give_none(spark):
    at = spark.range(1).select(join._pieces(F.lit(1), F.lit((1 << join.CELL_BITS) - 2)).alias("at"))
    assert at.select(F.size("at")).first()[0] <= 2 * join.CELL_BITS
    none = spark.createDataFrame([], "b long, low double, high double")
    assert join.band_join(spark.range(3), "id", none, "low", "high").count() == 0


def test_many_bands_are_not_broadcast(spark):
    bands = spark.range(4000).select(F.col("id").alias("b"), (F.col("id") * 300.0).alias("low"),
                                     (F.col("id") * 300.0 + 901).alias("high"))
    points = spark.range(500).select(F.col("id").alias("p"), (F.col("id") * 2400.0).alias("x"))
    got = join.band_join(points, "x", bands, "low", "high")
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    want = sorted((p, b) for p in range(500) for b in range(max(0, 8 * p - 4), min(8 * p + 1, 4000))
                  if b * 300 <= p * 2400 < b * 300 + 901)
    assert sorted((r.p, r.b) for r in got.collect()) == want


def test_pages_at_any_depth(spark):
    data = [(i, i % 7 if i % 5 else None) for i in range(500)]
    paged = select.Paged(spark.createDataFrame(data, "i long, v long"), ["-v", "i"])
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for start in (0, 3, 250, 495, 600):
        assert [tuple(r) for r in paged.page(start, 20).collect()] == order[start:start + 20]
    assert paged.info(480, 20) == {"total": 500, "has_previous": True, "has_next": False}
    assert select.Paged(spark.createDataFrame([], "i long"), ["i"]).page().count() == 0


def test_child_rows_have_one_grain(spark, rows):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(9, 1, "b"), (7, 1, "a"), (8, None, "x")], "kid long, pid long, v string")
    assert rows(join.child_rows(parents, "id", kids, "pid", "kid", ["v"]).select(
        "id", "position", "child.v")) == [(1, 1, "a"), (1, 2, "b"), (2, None, None)]


def test_delete_over_two_columns_of_a_parent(spark, rows):
    tables = {"p": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, code string"),
              "by_id": spark.createDataFrame([(10, 1), (11, 2)], "k long, p_id long"),
              "by_code": spark.createDataFrame([(20, "a", "a"), (21, "b", "b"), (22, None, "a")],
                                               "k long, code string, other string")}
    edges = [Edge("by_id", "p_id", "p", "id", "cascade"), Edge("by_code", "code", "p", "code", "cascade"),
             Edge("by_code", "other", "p", "code", "set_null")]
    after, _ = change.delete_cascade(tables, edges, "p", spark.createDataFrame([(1,)], "id long"))
    assert rows(after["p"], "id") == [(2,), (3,)]
    assert rows(after["by_id"], "k") == [(11,)]
    assert rows(after["by_code"], "k", "other") == [(21, "b"), (22, None)]


def test_one_parse_sees_all_of_a_text(spark):
    good = ["1", '{"k": [1, 2]}', '"x"', " null ", "[]", '"a\\"b"']
    bad = ["", " ", "1, 2", "1], [2", '1,"x"', "{", '{"a":1}}', "1]", "[1", '{"k":1} x', None, '"']
    texts = spark.createDataFrame([(t,) for t in good + bad], "v string")
    got = [r[0] for r in texts.select(jsonx.is_json("v")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
    plan = texts.select(jsonx.json_parse_or("v", "struct<k: bigint>"))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("parse_json") == 1 or \
        plan.optimizedPlan().toString().count("parseJson") == 1


def test_artifact_columns(spark, rows):
    files = spark.createDataFrame([("/r/a.ZIP", 5), ("/r/.b", None), ("noext", 0), (None, 1), ("x/", 2)],
                                  "path string, n long")
    made = sources.artifact_columns("path", "n")
    got = rows(files.select(*[c.alias(k) for k, c in made.items()]),
               "file_path", "file_name", "artifact_type", "size_bytes")
    assert got == sorted([("/r/a.ZIP", "a.ZIP", "trace", 5), ("/r/.b", ".b", "other", 0),
                          ("noext", "noext", "other", 0), (None, None, "other", 1),
                          ("x/", "", "other", 2)], key=repr)


def test_a_row_may_ask_for_its_name_again(spark, rows):
    asks = spark.createDataFrame([(1, 5, "x"), (2, 6, "x"), (3, 5, "x"), (4, 7, "y"), (5, 8, "z")],
                                 "request_id long, row long, name string")
    held = spark.createDataFrame([(7, "y", True), (9, "z", True)], "id long, name string, is_active boolean")
    out = services._doubled(asks, held, ["name"], own="row")
    assert rows(out.filter("_reason is not null"), "request_id") == [(2,), (5,)]


def test_renamed_projects_leave_held_slugs_alone(spark, rows):
    now = datetime(2024, 1, 1)
    cols = ("id long, owner_id long, name string, slug string, description string, status string, "
            "base_url string, default_browser string, headed boolean, retries int, timeout_ms int, "
            "trace_mode string, last_opened_on timestamp_ntz, is_active boolean, "
            "modified_on timestamp_ntz, modified_by long")
    projects = spark.createDataFrame(
        [(i, 1, n, s, "", "draft", None, "c", False, 0, 1000, "t", now, True, now, 1)
         for i, n, s in [(1, "A", "a"), (2, "B", "b"), (3, "A", "a-2"), (4, "D", "d"), (5, "E", "e")]], cols)
    asks = spark.createDataFrame(
        [(10, 1, 5, "B"), (11, 1, 4, "B"), (12, 1, 2, "C"), (13, 1, 3, "A"), (14, 1, 1, "A")],
        "request_id long, user_id long, project_id long, name string")
    table = services.update_projects(asks, projects, now).table
    # "b" stays held although project 2 gives it up; request 10 comes before 11.
    assert rows(table, "id", "slug") == [(1, "a"), (2, "c"), (3, "a-2"), (4, "b-3"), (5, "b-2")]


def test_new_users_keep_their_first_address(spark, rows):
    cols = ["id", "uuid", "first_name", "last_name", "email", "account_status", "auth_provider",
            "google_sub", "google_picture_url", "email_verified", "last_login_at"]
    kinds = ["long", *["string"] * 8, "boolean", "timestamp_ntz"]
    table = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(cols, kinds)))
    src = spark.createDataFrame(
        [(1, "s1", "one@x", "A"), (2, "s1", "two@x", "B"), (3, "s2", "two@x", "C")],
        "n long, sub string, email string, given_name string").withColumns(
        {"email_verified": F.lit(True), "family_name": F.lit(""), "picture": F.lit("")})
    after, _ = users.upsert_users(table, src, ["n"], datetime(2024, 1, 1), 0)
    assert rows(after, "email", "google_sub", "first_name") == [
        ("one@x", "s1", "B"), ("two@x", "s2", "C")]


def test_rows_to_number_are_spread(spark):
    rows = spark.range(0, 100_000, 1, 4).select("id", F.lit("x" * 20).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        given = change.assign_ids(rows, "id", 7, "n").withColumn("part", F.spark_partition_id())
        assert given.where("n != id + 8").count() == 0
        assert given.groupBy("part").count().agg(F.max("count")).first()[0] < 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
