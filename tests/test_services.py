"""Record services on small tables."""

import json

import pytest

from recordflow.operators import billing, change, run_services, services, users
from recordflow.schemas import schema_of

NOW = "2024-02-01 12:00:00"


@pytest.fixture(scope="module")
def app(spark):
    def table(name, *ddl_rows):
        schema = schema_of(name)
        return spark.createDataFrame(
            [tuple({"is_active": True, **r}.get(f.name) for f in schema.fields)
             for r in ddl_rows], schema)

    return {
        "project": table("project", {"id": 1, "owner_id": 10, "name": "One", "slug": "one"},
                         {"id": 2, "owner_id": 11, "name": "Two", "slug": "two"},
                         {"id": 3, "owner_id": 10, "name": "Gone", "slug": "gone",
                          "is_active": False}),
        "project_page": table("project_page",
                              {"id": 1, "project_id": 1, "name": "home", "status": "partial",
                               "route": "/"},
                              {"id": 2, "project_id": 1, "name": "login", "status": "partial"},
                              {"id": 3, "project_id": 2, "name": "home", "status": "partial"},
                              {"id": 4, "project_id": 1, "name": "old", "is_active": False}),
        "project_element": table("project_element",
                                 {"id": 1, "project_id": 1, "page_id": 1, "name": "ok",
                                  "locator_type": "css", "locator_value": "#a",
                                  "quality_score": 40, "quality_label": "fragile",
                                  "status": "warning"},
                                 {"id": 2, "project_id": 1, "page_id": 1, "name": "no",
                                  "locator_type": "role", "locator_value": "b",
                                  "quality_score": 100, "quality_label": "recommended",
                                  "status": "ready"}),
        "scenario": table("scenario", {"id": 1, "project_id": 1, "name": "s", "source_text": "x",
                                       "status": "draft"}),
        "scenario_run": table("scenario_run",
                              {"id": 1, "runtime_snapshot_json": '{"os":"linux"}',
                               "result_summary_json": "{broken"},
                              {"id": 2, "runtime_snapshot_json": "",
                               "result_summary_json": None}),
        "run_artifact": table("run_artifact", {"id": 7, "run_id": 1, "file_name": "b"},
                              {"id": 5, "run_id": 1, "file_name": "a"},
                              {"id": 6, "run_id": 1, "file_name": "x", "is_active": False}),
    }


def test_create_projects(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, " One ", None, 0, " "), (2, 10, "one!", "d ", 5000, "http://x"),
         (3, 0, "Nobody", "", 1, ""), (4, 11, " ", "", 1, ""), (5, 11, "Gone", "", None, None)],
        "request_id long, user_id long, name string, description string, timeout_ms int, "
        "base_url string")
    table, rejected = services.create_projects(asks, app["project"], NOW, 100)
    assert rows(table.filter("id > 100"), "id", "owner_id", "name", "slug", "description",
                "status", "base_url", "retries", "timeout_ms", "created_by") == [
        (101, 10, "One", "one-2", "", "draft", None, 0, 30000, 10),
        (102, 10, "one!", "one-3", "d", "draft", "http://x", 0, 5000, 10),
        (103, 11, "Gone", "gone-2", "", "draft", None, 0, 30000, 11)]
    assert rows(rejected) == [(3, "user_id", "authentication_required"), (4, "name", "required")]
    parity, _ = services.create_projects(asks, app["project"], NOW, 100, taken="active")
    assert rows(parity.filter("name = 'Gone' AND is_active"), "slug") == [("gone",)]


def test_update_projects(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 1, "Two", 3, None), (2, 10, 1, None, None, " "), (3, 10, 2, "x", None, None),
         (4, 10, 3, "x", None, None), (5, 11, 2, None, 6, None), (6, 11, 2, " ", None, None)],
        "request_id long, user_id long, project_id long, name string, retries int, "
        "base_url string")
    table, rejected = services.update_projects(asks, app["project"], NOW)
    assert rows(table, "id", "name", "slug", "retries", "base_url", "modified_by") == [
        (1, "Two", "two-2", 3, None, 10), (2, "Two", "two", None, None, None),
        (3, "Gone", "gone", None, None, None)]
    assert rows(rejected) == [(3, "project_id", "no_access"), (4, "project_id", "no_access"),
                              (5, "retries", "invalid"), (6, "name", "required")]
    same = spark.createDataFrame([(1, 10, 1, "ONE")],
                                 "request_id long, user_id long, project_id long, name string")
    assert rows(services.update_projects(same, app["project"], NOW).table.filter("id = 1"),
                "slug") == [("one",)]


def test_create_pages(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 1, "Home", None), (2, 10, 1, "My Page", " /p "), (3, 10, 1, "my-page", None),
         (4, 10, 2, "a", None), (5, 10, 1, "--", None), (6, 10, 1, "old", " "),
         (7, None, 1, "b", None), (8, 10, None, "b", None)],
        "request_id long, user_id long, project_id long, name string, route string")
    table, rejected = services.create_pages(asks, app["project_page"], app["project"], NOW, 50)
    assert rows(table.filter("id > 50"), "id", "name", "route", "status", "sort_order") == [
        (51, "my_page", "/p", "partial", 0), (52, "old", None, "partial", 0)]
    assert rows(rejected) == [
        (1, "name", "duplicate"), (3, "name", "duplicate"), (4, "project_id", "no_access"),
        (5, "name", "required"), (7, "project_id", "authentication_required"),
        (8, "project_id", "no_access")]


def test_update_pages(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 1, "HOME", " "), (2, 10, 2, "home", None), (3, 10, 9, "x", None),
         (4, 10, 4, "x", None), (5, 11, 1, "x", None), (6, 11, 3, None, "/r")],
        "request_id long, user_id long, page_id long, name string, route string")
    table, rejected = services.update_pages(asks, app["project_page"], app["project"], NOW)
    assert rows(table, "id", "name", "route") == [
        (1, "home", None), (2, "login", None), (3, "home", "/r"), (4, "old", None)]
    assert rows(rejected) == [(2, "name", "duplicate"), (3, "page_id", "not_found"),
                              (4, "page_id", "not_found"), (5, "page_id", "no_access")]


def test_create_elements(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 2, "Save Button", " Role ", "x"), (2, 10, 2, "list", "xpath", "//a"),
         (3, 10, 1, "OK", "role", "x"), (4, 10, 1, "z", "role", " "), (5, 10, 9, "z", "role", "x")],
        "request_id long, user_id long, page_id long, name string, locator_type string, "
        "locator_value string")
    (table, rejected), pages = services.create_elements(
        asks, app["project_element"], app["project_page"], app["project"], NOW, 20)
    assert rows(table.filter("id > 20"), "id", "project_id", "name", "quality_score",
                "quality_label", "status") == [
        (21, 1, "save_button", 100, "recommended", "ready"),
        (22, 1, "list", 0, "fragile", "warning")]
    assert rows(rejected) == [(3, "name", "duplicate"), (4, "locator_value", "required"),
                              (5, "page_id", "not_found")]
    assert rows(pages, "id", "status")[:3] == [(1, "partial"), (2, "partial"), (3, "partial")]


def test_update_elements(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 1, None, "label", None, None), (2, 10, 2, "ok", None, None, None)],
        "request_id long, user_id long, element_id long, name string, locator_type string, "
        "locator_value string, status string")
    (table, rejected), pages = services.update_elements(
        asks, app["project_element"], app["project_page"], app["project"], NOW)
    assert rows(table, "id", "name", "locator_type", "quality_score", "status") == [
        (1, "ok", "label", 95, "ready"), (2, "no", "role", 100, "ready")]
    assert rows(rejected) == [(2, "name", "duplicate")]
    assert rows(pages, "id", "status")[0] == (1, "ready")
    given = spark.createDataFrame([(1, 10, 2, "css", "error")], "request_id long, user_id long, "
                                  "element_id long, locator_type string, status string")
    (table, _), pages = services.update_elements(
        given, app["project_element"], app["project_page"], app["project"], NOW)
    assert rows(table.filter("id = 2"), "quality_score", "status") == [(40, "error")]
    assert rows(pages, "id", "status")[0] == (1, "error")


def test_scenarios(spark, app, rows):
    asks = spark.createDataFrame([(1, 10, 1, " Buy "), (2, 10, 1, " "), (3, 11, 1, "x")],
                                 "request_id long, user_id long, project_id long, name string")
    table, rejected = services.create_scenarios(asks, app["scenario"], app["project"], NOW, 5)
    assert rows(table.filter("id > 5"), "id", "name", "source_text", "ast_json", "steps_json",
                "status") == [(6, "Buy", services.NEW_SCENARIO, "{}", "[]", "draft")]
    assert rows(rejected) == [(2, "name", "required"), (3, "project_id", "no_access")]
    saves = spark.createDataFrame(
        [(1, 10, 1, None, "", "ready"), (2, 10, 1, "t ", None, None), (3, 10, 1, "", "q", None)],
        "request_id long, user_id long, scenario_id long, name string, source_text string, "
        "status string")
    table, rejected = services.save_scenarios(saves, app["scenario"], app["project"], NOW)
    assert rows(table, "name", "source_text", "status") == [("t", "", "ready")]
    assert rows(rejected) == [(3, "name", "required")]


def test_run_payloads(app):
    got = {r["id"]: r for r in services.run_payloads(
        app["scenario_run"], app["run_artifact"], per_part=100).collect()}
    assert [a["file_name"] for a in got[1]["artifacts"]] == ["a", "b"]
    assert got[1]["runtime_snapshot"] == {"os": "linux"} and got[1]["result_summary"] == {}
    assert got[2]["artifacts"] == [] and got[2]["runtime_snapshot"] == {}


def test_fold_patches_takes_the_last_value_given(spark, rows):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, "b", None)],
                               "id long, n long, s string, v long")
    assert rows(change.fold_patches(df, "id", "n")) == [(1, "b", 5)]


def test_run_services(spark, app, rows):
    projects, scenarios, runs = app["project"], app["scenario"], app["scenario_run"]
    asks = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 10, 9)],
                                 "request_id long, user_id long, scenario_id long")
    (started, rejected), after = run_services.start_runs(asks, runs, scenarios, projects, NOW, 40)
    assert rows(started.filter("id > 40"), "id", "project_id", "scenario_id", "status",
                "runtime_snapshot_json", "result_summary_json") == [
        (41, 1, 1, "precheck", "{}", "{}")]
    assert rows(rejected, "request_id", "reason") == [(2, "no_access"), (3, "not_found")]
    assert rows(after, "status") == [("running",)]

    mid = spark.createDataFrame([(1, 10, 41, "executing", None), (2, 10, 41, "compiling", "E")],
                                "request_id long, user_id long, run_id long, status string, "
                                "error_type string")
    moved = run_services.update_runs(mid, started, projects).table
    assert rows(moved.filter("id = 41"), "status", "error_type") == [("compiling", "E")]

    end = spark.createDataFrame([(1, 10, 41, "passed", 12), (2, 10, 41, "blocked", None)],
                                "request_id long, user_id long, run_id long, status string, "
                                "duration_ms int")
    (done, _), scen = run_services.finish_runs(end, moved, after, projects, NOW)
    assert rows(done.filter("id = 41"), "status", "duration_ms", "error_type",
                "result_summary_json") == [("blocked", None, None, "{}")]
    assert done.filter("id = 41 AND finished_on IS NOT NULL").count() == 1
    assert rows(scen, "status") == [("ready",)]
    (_, _), scen = run_services.finish_runs(end.filter("request_id = 1"), moved, after, projects,
                                            NOW)
    assert rows(scen, "status") == [("passed",)]

    files = spark.createDataFrame([(1, 10, 41, "trace", "/a", None), (2, 10, 77, "trace", "/b", 3)],
                                  "request_id long, user_id long, run_id long, "
                                  "artifact_type string, file_path string, size_bytes long")
    table, rejected = run_services.attach_artifacts(files, app["run_artifact"], done, projects,
                                                    NOW, 90)
    assert rows(table.filter("id > 90"), "id", "run_id", "size_bytes", "notes") == [(91, 41, 0, "")]
    assert rows(rejected, "request_id", "reason") == [(2, "not_found")]


def test_archive_services(spark, app, rows):
    def asks(key, *pairs):
        return spark.createDataFrame([(i, u, k) for i, (u, k) in enumerate(pairs)],
                                     f"request_id long, user_id long, {key} long")

    projects, pages = app["project"], app["project_page"]
    elements, scenarios = app["project_element"], app["scenario"]
    table, rejected = run_services.archive_own_projects(asks("project_id", (10, 1), (10, 2)),
                                                        projects)
    assert rows(table, "id", "status", "is_active") == [
        (1, "archived", False), (2, None, True), (3, None, False)]
    assert rows(rejected, "reason") == [("no_access",)]
    (table, _), parts = run_services.archive_own_pages(asks("page_id", (10, 1), (10, 3)), pages,
                                                       elements, projects)
    assert rows(table.filter("status = 'archived'"), "id") == [(1,)]
    assert rows(parts, "status", "is_active") == [("archived", False), ("archived", False)]
    (table, _), fresh = run_services.archive_own_elements(asks("element_id", (10, 1)), elements,
                                                          pages, projects)
    assert rows(table, "id", "status") == [(1, "archived"), (2, "ready")]
    assert rows(fresh, "id", "status")[0] == (1, "ready")
    table, rejected = run_services.archive_own_scenarios(asks("scenario_id", (10, 1), (0, 1)),
                                                         scenarios, projects)
    assert rows(table, "status") == [("archived",)]
    assert rows(rejected, "reason") == [("authentication_required",)]


def test_orders_open_payments(spark, rows):
    users = spark.createDataFrame([(1, "a@b.c")], "id long, email string")
    offers = spark.createDataFrame(
        [(5, "LIFETIME", "All", None, 79.0, True), (6, "OLD", "Old", "USD", 1.0, False)],
        "id long, code string, name string, currency string, price_amount double, "
        "is_active boolean")
    asks = spark.createDataFrame([(1, 1, "LIFETIME"), (2, 1, "OLD"), (3, 2, "LIFETIME"),
                                  (4, 1, "LIFETIME"), (5, 1, "NONE")],
                                 "request_id long, user_id long, offer_code string")
    ordered, rejected = billing.order_requests(asks, users, offers)
    unit = json.loads(ordered.filter("request_id = 1").first()["payload"])["purchase_units"][0]
    assert unit["reference_id"] == "offer-5-user-1" and unit["custom_id"] == "1"
    assert unit["amount"] == {"currency_code": "EUR", "value": "79.00"}
    assert len(unit["invoice_id"]) == 24
    assert rows(rejected, "request_id", "reason") == [
        (2, "offer_not_available"), (3, "user_not_found"), (5, "offer_not_available")]
    answers = spark.createDataFrame(
        [(1, '{"id":"O1","links":[{"rel":"self","href":"x"},{"rel":"approve","href":"u"}]}'),
         (4, '{"id":"O4","links":[]}')], "request_id long, answer string")
    empty = spark.createDataFrame([], schema_of("billing_payment"))
    table, rejected = billing.open_payments(empty, ordered, answers, NOW, 0)
    assert rows(table, "id", "user_id", "offer_id", "provider_order_id", "payer_email",
                "gross_amount", "currency", "status") == [
        (1, 1, 5, "O1", "a@b.c", 79.0, "EUR", "created")]
    assert rows(rejected, "request_id", "reason") == [(4, "incomplete")]


def test_touch_projects(spark, app, rows):
    asks = spark.createDataFrame(
        [(1, 10, 1), (2, 11, 1), (3, 10, 3), (4, None, 2), (5, 10, None), (6, 10, 1)],
        "request_id long, user_id long, project_id long")
    table, rejected = services.touch_projects(asks, app["project"], NOW)
    assert rows(table.selectExpr("id", "string(last_opened_on)", "modified_by")) == rows(
        spark.createDataFrame([(1, NOW, 10), (2, None, None), (3, None, None)],
                              "id long, at string, who long"))
    got = {r.request_id: r.reason for r in rejected.collect()}
    assert got == {2: "no_access", 3: "no_access", 4: "authentication_required", 5: "no_access"}
    empty, _ = services.touch_projects(asks.limit(0), app["project"], NOW)
    assert empty.filter("last_opened_on is not null").count() == 0


def test_sign_in_gives_a_project_once(spark, app):
    users_ = spark.createDataFrame(
        [(10, "a@x.y", "s10", "active"), (11, "b@x.y", None, "active"),
         (12, "c@x.y", None, "blocked"), (13, "d@x.y", None, "active")],
        "id long, email string, google_sub string, account_status string")
    users_ = users_.selectExpr(
        "*", "'F' first_name", "'L' last_name", "cast(null as string) auth_provider",
        "cast(null as string) google_picture_url", "false email_verified", "true is_active",
        "cast(null as timestamp_ntz) last_login_at", "cast(null as string) uuid")
    src = spark.createDataFrame(
        [(1, "s10", "a@x.y"), (2, "s12", "c@x.y"), (3, "s13", "D@x.y"), (4, "new", "e@x.y"),
         (5, "new", "e@x.y"), (6, None, "f@x.y")], "n long, sub string, email string").selectExpr(
        "*", "true email_verified", "'' given_name", "'' family_name", "'' picture")
    owned = app["project"].filter("id <> 1")  # user 10 has an archived project left
    after, projects, rejected = users.sign_in(users_, owned, src, ["n"], NOW, 100, 500)
    assert {r.id for r in after.filter("last_login_at is not null").collect()} == {10, 13, 101}
    fresh = projects.filter("id > 500").selectExpr(
        "owner_id", "name", "status", "string(last_opened_on) at", "slug").collect()
    assert {tuple(r)[:4] for r in fresh} == {
        (13, "My first project", "draft", NOW), (101, "My first project", "draft", NOW)}
    assert len(fresh) == len({r.slug for r in fresh}) == 2
    assert projects.count() == 4
    assert {r.n: r.reason for r in rejected.collect()} == {2: "disabled", 6: "incomplete"}
    again = users.sign_in(after, projects, src, ["n"], NOW, 200, 600)[1]
    assert again.filter("id > 600").count() == 0
