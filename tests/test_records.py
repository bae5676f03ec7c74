"""Joins, rollups, validation and table changes on small records with edge values."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from recordflow.operators import agg, change, join, quality, select, users
from recordflow.schemas import APP_EDGES, Edge, schema_of

NOW = "2024-02-01 12:00:00"


def test_select_edges(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (0, true, 'a'), (1, NULL, ''), (2, false, NULL), "
                   "(NULL, true, 'b') AS v(id, is_active, s)")
    assert rows(select.active(df), "s") == [("a",), ("b",)]
    assert select.active(df.drop("is_active")).count() == 4
    assert rows(select.keyed_rows(df, "id"), "id") == [(1,), (2,)]
    assert rows(select.keyed_rows(df, "s"), "s") == [("a",), ("b",)]
    assert rows(select.exclude(df, "id", 1), "id") == [(0,), (2,)]
    assert rows(select.exclude(df, "id", 1, null_safe=True), "id") == [(0,), (2,), (None,)]
    assert rows(select.where_all(df, {"s": None, "id": 2}), "id") == [(2,)]
    assert select.lookup(df, "id", 0)["s"] == "a"
    with pytest.raises(select.NotFound):
        select.lookup(df, "id", 9)
    info = select.page_info(df, start=0, step=4).first()
    assert tuple(info) == (4, False, False)
    assert [r["id"] for r in select.ordered(df, ["-id"]).collect()] == [2, 1, 0, None]
    assert [r["id"] for r in select.page_after(df, "id", 0, 1).collect()] == [1]


def test_rollup_keeps_inactive_parents(spark, rows):
    pages = spark.sql("SELECT * FROM VALUES (1, 'old', true), (2, 'old', false), (3, 'old', true), "
                      "(4, 'old', true), (5, 'old', true), (6, 'old', true) AS v(id, status, is_active)")
    kids = spark.sql("SELECT * FROM VALUES (1, 'error', true), (1, 'warning', true), "
                     "(2, 'error', true), (3, 'error', false), (4, 'warning', true), "
                     "(5, 'ready', true), (6, NULL, true), (NULL, 'error', true) "
                     "AS v(page_id, status, is_active)")
    got = agg.rollup_status(pages, "id", kids, "page_id")
    assert rows(got, "id", "status") == [(1, "error"), (2, "old"), (3, "partial"),
                                         (4, "partial"), (5, "ready"), (6, "ready")]


def test_children_come_whole_in_parts(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.range(25).select(F.col("id").alias("kid"), F.lit(1).cast("long").alias("pid"))
    got = join.with_children(parents, "id", kids, "pid", "kid", ["kid"], per_part=10)
    found = {(r["id"], r["part"]): [c["kid"] for c in r["children"]] for r in got.collect()}
    assert found == {(1, 0): list(range(10)), (1, 1): list(range(10, 20)),
                     (1, 2): list(range(20, 25)), (2, 0): []}


def test_theta_needs_equal_columns(spark):
    with pytest.raises(ValueError, match="band_join"):
        join.theta(spark.range(3), spark.range(3).toDF("b"), "id < b", on=[])


def test_owned_through_two_hops(spark, rows):
    projects = spark.sql("SELECT * FROM VALUES (1, 10, true), (2, 10, false), (3, 11, true) "
                         "AS v(id, owner_id, is_active)")
    pages = spark.sql("SELECT * FROM VALUES (5, 1), (6, 2), (7, 3) AS v(id, project_id)")
    elements = spark.sql("SELECT * FROM VALUES (50, 5), (60, 6), (70, 7), (80, NULL) "
                         "AS v(id, page_id)")
    chain = [join.Hop(pages, "page_id"), join.Hop(projects, "project_id")]
    assert rows(join.owned(elements, chain, "owner_id", 10), "id") == [(50,)]
    assert rows(join.owned(elements, chain, "owner_id"), "id") == [(50,), (70,)]


def test_localize_uses_the_key_without_a_label(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('Save', 'fr'), ('Open', 'fr'), ('Save', 'de') AS v(k, lang)")
    words = spark.sql("SELECT 'fr' AS lang, 'Save' AS source, 'Enregistrer' AS target")
    assert rows(join.localize(df, "k", "lang", words), "label") == [
        ("Enregistrer",), ("Open",), ("Save",)]


def test_validation_edges(spark, rows):
    df = spark.sql("""SELECT * FROM VALUES (1, 'ok', 5, 1.0D, 'a@b.co', 'x-y'),
        (2, '  ', 6, double('NaN'), 'a@b', 'X'), (3, NULL, NULL, NULL, NULL, NULL),
        (4, 'too long', -1, -0.1D, 'a..b@c.de', '') AS v(id, name, n, f, mail, slug)""")
    rules = [quality.required("name"), quality.max_length("name", 5), quality.int_range("n", 0, 6),
             quality.float_range("f", 0.0, 1.0), quality.email_shape("mail"),
             quality.slug_shape("slug")]
    got = {r["id"]: dict(r["errors"]) for r in quality.validate(df, rules).collect()}
    bad = {"n": "invalid", "f": "invalid", "mail": "invalid", "slug": "invalid"}
    assert got == {1: {}, 2: {"name": "required", **bad}, 3: {"name": "required", **bad},
                   4: {"name": "too_long", **bad}}
    first = {r["id"]: dict(r["errors"]) for r in quality.validate(df, rules, "first").collect()}
    assert first[2] == {"name": "required"}


def test_uniqueness_sets_null_keys_aside(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, NULL), (4, NULL), (5, 'b'), "
                   "(6, 'c') AS v(id, name)")
    assert rows(quality.flag_doubled(df, ["name"]).filter("is_doubled"), "id") == [(1,), (2,)]
    old = spark.sql("SELECT 'c' AS name")
    good, bad = quality.accept_unique(df, old, ["name"], ["id"])
    assert rows(good, "id") == [(1,), (3,), (4,), (5,)]
    assert rows(bad, "id") == [(2,), (6,)]


def test_missing_columns_get_defaults_and_nulls_stay(spark, rows):
    base = spark.createDataFrame([(1, "a", "x", 5)], "id long, name string, status string, n int")
    new = spark.createDataFrame([(2, None)], "id long, name string")
    got = change.insert_rows(base, new, {"name": "never", "status": "draft"})
    assert rows(got) == [(1, "a", "x", 5), (2, None, "draft", None)]


def test_patch_keeps_sets_and_blanks(spark, rows):
    base = spark.createDataFrame([(1, "a", "u"), (2, "b", "v"), (3, "c", "w")],
                                 "id long, name string, url string")
    patches = spark.createDataFrame([(1, None, " "), (2, " z ", None)],
                                    "id long, name string, url string")
    got = change.patch(base, patches, "id", cleaned=["name"], nullable_blank=["url"])
    assert rows(got) == [(1, "a", None), (2, "z", "v"), (3, "c", "w")]


def test_update_and_delete_count_and_ignore_null(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (1, 5), (2, NULL), (3, 1) AS v(id, n)")
    seen = Observation("hits")
    got = change.update_where(df, "n > 2", {"n": "id * 10", "id": "n"}, seen)
    assert rows(got) == [(2, None), (3, 1), (5, 10)]
    assert seen.get["rows"] == 1
    assert rows(change.delete_where(df, "n > 2")) == [(2, None), (3, 1)]


def test_archive_element_refreshes_only_its_page(spark, rows):
    pages = spark.sql("SELECT * FROM VALUES (1, 'error', true), (2, 'stale', true) "
                      "AS v(id, status, is_active)")
    elements = spark.sql("SELECT * FROM VALUES (10, 1, 'error', true), (11, 1, 'ready', true), "
                         "(20, 2, 'ready', true), (21, 2, 'ready', NULL) "
                         "AS v(id, page_id, status, is_active)")
    keys = spark.createDataFrame([(10,)], "id int")
    after_pages, after = change.archive_elements(pages, elements, keys)
    assert rows(after_pages, "id", "status") == [(1, "ready"), (2, "stale")]
    assert rows(after, "id", "status", "is_active") == [
        (10, "archived", False), (11, "ready", True), (20, "ready", True), (21, "ready", None)]


def app_tables(spark):
    def table(name, ddl_rows):
        schema = schema_of(name)
        cols = [f for f in schema.fields]
        return spark.createDataFrame(
            [tuple(r.get(f.name) for f in cols) for r in ddl_rows], schema)

    empty = {n: table(n, []) for n in ("google_identity", "project_element", "scenario",
                                       "scenario_run", "run_artifact")}
    return {**empty,
            "auth_user": table("auth_user", [{"id": 1}, {"id": 2}]),
            "project": table("project", [{"id": 1, "owner_id": 1}, {"id": 2, "owner_id": 2}]),
            "project_page": table("project_page", [{"id": 1, "project_id": 1},
                                                   {"id": 2, "project_id": 2}]),
            "billing_offer": table("billing_offer", [{"id": 9}]),
            "billing_payment": table("billing_payment", [
                {"id": 1, "user_id": 1, "offer_id": 9}, {"id": 2, "user_id": 2, "offer_id": 9}]),
            "user_entitlement": table("user_entitlement", [
                {"id": 1, "user_id": 2, "payment_id": 1}, {"id": 2, "user_id": 1, "payment_id": 2}]),
            "feedback": table("feedback", [{"id": 1, "user_id": 1, "project_id": 1},
                                           {"id": 2, "user_id": 2, "project_id": 2}])}


def test_delete_follows_the_declared_keys(spark, rows):
    tables = app_tables(spark)
    keys = spark.createDataFrame([(1,)], "id long")
    after, blocked = change.delete_cascade(tables, APP_EDGES, "auth_user", keys)
    assert rows(after["auth_user"], "id") == [(2,)]
    assert rows(after["project"], "id") == [(2,)]
    assert rows(after["project_page"], "id") == [(2,)]
    assert rows(after["billing_payment"], "id") == [(2,)]
    assert rows(after["user_entitlement"], "id", "user_id", "payment_id") == [(1, 2, None)]
    assert rows(after["feedback"], "id", "user_id", "project_id") == [(1, None, None), (2, 2, 2)]
    assert blocked is None
    offer = spark.createDataFrame([(9,)], "id long")
    _, blocked = change.delete_cascade(tables, APP_EDGES, "billing_offer", offer)
    assert rows(blocked) == [("billing_payment.offer_id->billing_offer.id", 2)]


def test_delete_rejects_cycles(spark):
    edges = [Edge("a", "x", "b"), Edge("b", "y", "a")]
    with pytest.raises(ValueError, match="cycle"):
        change.delete_cascade({}, edges, "a", spark.createDataFrame([(1,)], "id long"))


def test_sign_in_upsert(spark, rows):
    cols = ["id", "first_name", "last_name", "email", "account_status", "google_sub"]
    table = spark.createDataFrame([], schema_of("auth_user"))
    known = spark.createDataFrame(
        [(1, "Ann", "A", "ann@x.y", "active", "s1"), (2, "Bob", "B", "bob@x.y", "active", None),
         (3, "Cy", "C", "cy@x.y", "blocked", "s3"), (4, "Di", "D", "di@x.y", "refunded", "s4")],
        "id long, first_name string, last_name string, email string, account_status string, "
        "google_sub string")
    table = change.insert_rows(table, known)
    src = spark.createDataFrame(
        [(1, "s1", "other@x.y", True, "", "New"), (2, "s2", " BOB@x.y", True, "Rob", ""),
         (3, "s3", "cy@x.y", True, "a", "b"), (4, "s4", "di@x.y", True, "a", "b"),
         (5, "", "e@x.y", True, "a", "b"), (6, "s6", "f@x.y", False, "a", "b"),
         (7, "s7", "new@x.y", True, "", ""), (8, "s7", "new@x.y", True, "Nia", ""),
         (9, "s7", "new@x.y", True, "", "Z"), (10, None, None, None, None, None)],
        "n long, sub string, email string, email_verified boolean, given_name string, "
        "family_name string").withColumn("picture", F.lit(" "))
    after, rejected = users.upsert_users(table, src, ["n"], NOW, 100)
    assert rows(after, *cols) == [
        (1, "Ann", "New", "ann@x.y", "active", "s1"),
        (101, "Nia", "Z", "new@x.y", "active", "s7"),
        (2, "Rob", "B", "bob@x.y", "active", "s2"), (3, "Cy", "C", "cy@x.y", "blocked", "s3"),
        (4, "Di", "D", "di@x.y", "refunded", "s4")]
    assert rows(rejected, "n", "reason") == [(10, "incomplete"), (3, "disabled"), (4, "refunded"),
                                             (5, "incomplete"), (6, "not_verified")]


def test_starter_rows_reach_users_without_active_projects(spark, rows):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    projects = spark.sql("SELECT * FROM VALUES (1L, true), (2L, false) AS v(owner_id, is_active)")
    fresh, scenarios = change.starter_rows(people, "id", projects)
    assert rows(fresh, "owner_id") == [(2,), (3,)]
    assert scenarios.count() == 2
    again, _ = change.starter_rows(people, "id", projects, active_only=False)
    assert rows(again, "owner_id") == [(3,)]


def test_starter_slugs_are_unique(spark, rows):
    """Two owners whose hashes begin with the same eight digits, and a slug already taken."""
    people = spark.createDataFrame([(69235,), (95303,), (None,)], "id long")
    projects = spark.sql("SELECT 0L AS owner_id, true AS is_active, 'starter-c11eb5e6-2' AS slug")
    fresh, scenarios = change.starter_rows(people, "id", projects)
    want = [(69235, "starter-c11eb5e6"), (95303, "starter-c11eb5e6-3")]
    assert [r for r in rows(fresh, "owner_id", "slug") if r[0]] == want
    assert [r for r in rows(scenarios, "owner_id", "project_slug") if r[0]] == want
    assert fresh.count() == scenarios.count() == 3
