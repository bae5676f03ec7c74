"""Record services over batches of requests: projects, pages, elements, scenarios, runs.

A request row has ``request_id`` (unique integer, the order of arrival), ``user_id`` and its
fields. Requests are checked against the tables as they were before the batch and against
earlier requests of the batch; a request that fails names its first broken check. A name held
before the batch stays held until the batch is done, also where a request gives it up.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.jsonx import json_parse_or
from recordflow.functions.text import (clean, falsy_or, identifierify, score_by_type, short_id,
                                       slugify, status_by_score)
from recordflow.operators.agg import rollup_status
from recordflow.operators.change import (_lit, _marked, assign_ids, fold_patches, insert_rows,
                                         patch, stamp)
from recordflow.operators.join import left_unique, with_children
from recordflow.operators.select import active
from recordflow.operators.slugs import dedupe_slugs, taken_slugs
from recordflow.schemas import DEFAULTS
from recordflow.session import materialize

# Fixed value: the text of a scenario created without one.
NEW_SCENARIO = 'TEST "New scenario"\nFIN'
RETRIES, TIMEOUT_MS = (0, 5), (1000, 300000)
BLANK_TO_NULL = {"base_url", "route"}
STRIPPED = {"description", "notes"}


class Outcome(NamedTuple):
    """The table after the batch, and (request_id, field, reason) of what was turned down."""

    table: DataFrame
    rejected: DataFrame


def _check(requests: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Adds ``_field`` and ``_reason`` of the first broken check."""
    field = reason = F.lit(None).cast("string")
    for name, broken, text in reversed(checks):
        hit = F.coalesce(broken, F.lit(True))
        field = F.when(hit, F.lit(name)).otherwise(field)
        reason = F.when(hit, F.lit(text)).otherwise(reason)
    return requests.withColumns({"_field": field, "_reason": reason})


def _rejected(*checked: DataFrame) -> DataFrame:
    parts = [c.filter("_reason IS NOT NULL").select(
        "request_id", F.col("_field").alias("field"), F.col("_reason").alias("reason"))
        for c in checked]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("_reason IS NULL").drop("_field", "_reason")


def _given(requests: DataFrame, name: str, other=None) -> Column:
    return F.col(name) if name in requests.columns else F.lit(other)


def _no_user() -> Column:
    return F.coalesce(F.col("user_id"), F.lit(0)) == 0


def _with_owner(requests: DataFrame, projects: DataFrame, project: str) -> DataFrame:
    """Adds ``_owner`` of the active project a request is about."""
    side = active(projects).select(F.col("id").alias("_pid"), F.col("owner_id").alias("_owner"))
    return left_unique(requests, side, [(project, "_pid")], ["_owner"])


def _no_access() -> Column:
    return F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id"))


def _doubled(candidates: DataFrame, existing: DataFrame, keys: list[str],
             own: str | None = None) -> DataFrame:
    """Candidates with a ``duplicate`` verdict where an active row (other than ``own``) or an
    earlier candidate (for another row than ``own``) has the name."""
    ids = active(existing).groupBy(*keys).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    who = F.col("request_id") if own is None else F.col(own)
    first = candidates.groupBy(*keys).agg(F.min_by(who, "request_id").alias("_first"))
    verdict = first.join(ids, keys, "left")
    marked = left_unique(candidates, verdict, [(k, k) for k in keys], ["_first", "_lo", "_hi"])
    held = F.col("_lo").isNotNull()
    if own is not None:
        held = held & ~((F.col("_lo") == F.col(own)) & (F.col("_hi") == F.col(own)))
    # Whoever asks first gets the name; its row may ask for it again.
    broken = held | (F.col("_first") != who)
    return _check(marked, [("name", broken, "duplicate")]).drop("_first", "_lo", "_hi")


def _insert(table: DataFrame, accepted: DataFrame, values: dict[str, Column], defaults: dict,
            now, start_id: int) -> DataFrame:
    new = accepted.select("request_id", *[v.alias(c) for c, v in values.items()],
                          F.col("user_id").alias("created_by"),
                          F.col("user_id").alias("modified_by"),
                          short_id(32, "user_id", "request_id").alias("uuid"))
    new = assign_ids(new, "request_id", start_id).drop("request_id")
    kept = [c for c in new.columns if c in table.columns]
    return insert_rows(table, new.select(*kept), defaults, now=now)


def _update(table: DataFrame, accepted: DataFrame, key: str, values: dict[str, Column],
            now) -> DataFrame:
    """Apply requests as patches, the last given value per field, and stamp what changed."""
    wanted = accepted.select(F.col(key).alias("id"), "request_id",
                             *[v.alias(c) for c, v in values.items()],
                             F.col("user_id").alias("modified_by"))
    side = fold_patches(wanted, "id", "request_id").withColumn("_hit", F.lit(True))
    who = side.select("id", F.col("modified_by").alias("_who"), "_hit")
    fields = side.drop("_hit", "modified_by")
    after = patch(table, fields, "id", nullable_blank=[c for c in BLANK_TO_NULL
                                                       if c in fields.columns])
    after = left_unique(after, who, [("id", "id")], ["_who", "_hit"])
    return stamp(after, F.col("_hit"), now, F.col("_who")).select(*table.columns)


def create_projects(requests: DataFrame, projects: DataFrame, now, start_id: int,
                    taken: str = "all") -> Outcome:
    """Requests: name, and any of description, base_url, default_browser, headed, retries,
    timeout_ms, trace_mode. Slugs are made unique among those in use and in the batch."""
    cols = DEFAULTS["project"]
    checked = _check(requests.withColumn("name", clean("name")), [
        ("user_id", _no_user(), "authentication_required"),
        ("name", F.col("name") == "", "required")])
    accepted = _accepted(checked).withColumn("slug", slugify("name", "request_id"))
    accepted = dedupe_slugs(accepted, "slug", "request_id", taken_slugs(projects, taken=taken))
    values = {
        "owner_id": F.col("user_id"), "name": F.col("name"), "slug": F.col("unique_slug"),
        "description": clean(_given(requests, "description")), "status": F.lit("draft"),
        "base_url": F.nullif(clean(_given(requests, "base_url")), F.lit("")),
        "default_browser": F.coalesce(_given(requests, "default_browser"),
                                      F.lit(cols["default_browser"])),
        "headed": F.coalesce(_given(requests, "headed").cast("boolean"), F.lit(False)),
        "retries": falsy_or(_given(requests, "retries").cast("int"), cols["retries"]),
        "timeout_ms": falsy_or(_given(requests, "timeout_ms").cast("int"), cols["timeout_ms"]),
        "trace_mode": F.coalesce(_given(requests, "trace_mode"), F.lit(cols["trace_mode"])),
        "last_opened_on": _lit(now, "timestamp_ntz"),
    }
    return Outcome(_insert(projects, accepted, values, cols, now, start_id), _rejected(checked))


def update_projects(requests: DataFrame, projects: DataFrame, now,
                    taken: str = "all") -> Outcome:
    """Requests: project_id and the settings to change, NULL for those to keep. A new name
    brings a new slug, in order of the requests that won. Slugs held before the batch stay held
    until it is done; a project's own one is free for itself."""
    fields = [c for c in ("name", "description", "base_url", "default_browser", "headed",
                          "retries", "timeout_ms", "trace_mode", "status")
              if c in requests.columns]
    found = _with_owner(requests, projects, "project_id")
    checks = [("project_id", _no_user(), "authentication_required"),
              ("project_id", _no_access(), "no_access")]
    if "name" in fields:
        checks.append(("name", F.col("name").isNotNull() & (clean("name") == ""), "required"))
    for name, (low, high) in (("retries", RETRIES), ("timeout_ms", TIMEOUT_MS)):
        if name in fields:
            checks.append((name, F.col(name).isNotNull() & ~F.col(name).between(low, high),
                           "invalid"))
    checked = _check(found, checks)
    accepted = _accepted(checked)
    values = {c: clean(c) if c in ("name", "description") else F.col(c) for c in fields}
    values = {c: F.when(F.col(c).isNotNull(), v) for c, v in values.items()}
    after = _update(projects, accepted, "project_id", values, now)
    if "name" not in fields:
        return Outcome(after, _rejected(checked))

    renamed = (accepted.filter("name IS NOT NULL").groupBy(F.col("project_id").alias("id")).agg(
        F.max_by("name", "request_id").alias("_name"), F.max("request_id").alias("_at")))
    slugs = materialize(renamed.select("id", "_at", slugify("_name", "id").alias("_want")), "renamed")
    held = taken_slugs(projects, taken=taken)
    kept = _own_slugs(slugs, projects, held)
    fresh = slugs.join(kept.select("id"), "id", "left_anti")
    given = dedupe_slugs(fresh.select("_want", "_at"), "_want", "_at", held, "_slug")
    given = fresh.join(given.select("_at", "_slug"), "_at").select("id", "_slug").unionByName(kept)
    after = left_unique(after, given, [("id", "id")], ["_slug"])
    after = after.withColumn("slug", F.coalesce("_slug", F.col("slug"))).drop("_slug")
    return Outcome(after.select(*projects.columns), _rejected(checked))


def touch_projects(requests: DataFrame, projects: DataFrame, now) -> Outcome:
    """Requests: project_id. Projects opened by their owner get the time of the batch."""
    checked = _check(_with_owner(requests, projects, "project_id"), [
        ("project_id", _no_user(), "authentication_required"),
        ("project_id", _no_access(), "no_access")])
    values = {"last_opened_on": _lit(now, "timestamp_ntz")}
    return Outcome(_update(projects, _accepted(checked), "project_id", values, now),
                   _rejected(checked))


def _own_slugs(slugs: DataFrame, projects: DataFrame, held: DataFrame) -> DataFrame:
    """(id, _slug) of projects whose own slug is the first of s, s-2, s-3, … that nobody else holds."""
    def number(slug, want):
        rest = F.substr(slug, F.length(want) + 2)
        return F.when(slug == want, F.lit(1)).when(
            F.startswith(slug, F.concat(want, F.lit("-"))) & rest.rlike("^[1-9][0-9]{0,17}$")
            & (rest != "1"), rest.try_cast("bigint"))

    own = slugs.join(projects.select("id", "slug"), "id").withColumn(
        "_n", number(F.col("slug"), F.col("_want"))).filter("_n IS NOT NULL")
    # Held slugs by the name they may be a suffix of: themselves, and without their last number.
    family = held.select(F.explode(F.array_distinct(F.array(
        F.col("slug"), F.regexp_replace("slug", "-[1-9][0-9]{0,17}$", "")))).alias("_want"),
        F.col("slug").alias("_other")).withColumn("_k", number(F.col("_other"), F.col("_want")))
    smaller = (own.select("id", "_want", "_n").join(family, "_want").filter("_k < _n")
               .groupBy("id").agg(F.count("*").alias("_below")))
    return (own.join(smaller, "id", "left").filter("coalesce(_below, 0) = _n - 1")
            .select("id", F.col("slug").alias("_slug")))


def create_pages(requests: DataFrame, pages: DataFrame, projects: DataFrame, now,
                 start_id: int) -> Outcome:
    """Requests: project_id, name, and any of route, notes, sort_order."""
    found = _with_owner(requests, projects, "project_id").withColumn("name", identifierify("name"))
    checked = _check(found, [
        ("project_id", _no_user(), "authentication_required"),
        ("project_id", _no_access(), "no_access"),
        ("name", F.col("name") == "", "required")])
    named = _doubled(_accepted(checked), pages, ["project_id", "name"])
    values = {
        "project_id": F.col("project_id"), "name": F.col("name"), "status": F.lit("partial"),
        "route": F.nullif(clean(_given(requests, "route")), F.lit("")),
        "notes": clean(_given(requests, "notes")),
        "sort_order": falsy_or(_given(requests, "sort_order").cast("int"), 0),
    }
    return Outcome(_insert(pages, _accepted(named), values, DEFAULTS["project_page"], now,
                           start_id), _rejected(checked, named))


def _with_row(requests: DataFrame, table: DataFrame, key: str, take: list[str]) -> DataFrame:
    """Adds ``_<column>`` of the row a request is about, and ``_live`` where it is active."""
    side = table.select(F.col("id").alias("_rid"),
                        F.coalesce(F.col("is_active"), F.lit(False)).alias("_live"),
                        *[F.col(c).alias(f"_{c}") for c in take])
    return left_unique(requests, side, [(key, "_rid")], ["_live", *[f"_{c}" for c in take]])


def _row_checks(key: str) -> list[tuple[str, Column, str]]:
    return [(key, F.col("_live").isNull(), "not_found"),
            (key, _no_user(), "authentication_required"), (key, _no_access(), "no_access"),
            (key, ~F.col("_live"), "not_found")]


def update_pages(requests: DataFrame, pages: DataFrame, projects: DataFrame, now) -> Outcome:
    """Requests: page_id and any of name, route, notes, status, sort_order; NULL keeps."""
    found = _with_owner(_with_row(requests, pages, "page_id", ["project_id"]), projects,
                        "_project_id")
    found = found.withColumn("name", F.when(_given(requests, "name").isNotNull(),
                                            identifierify(_given(requests, "name"))))
    checked = _check(found, [*_row_checks("page_id"),
                             ("name", F.coalesce(F.col("name") == "", F.lit(False)), "required")])
    good = _accepted(checked).withColumn("project_id", F.col("_project_id"))
    named = _doubled(good.filter("name IS NOT NULL"), pages, ["project_id", "name"], "page_id")
    accepted = _accepted(named).unionByName(good.filter("name IS NULL"))
    values = _patch_values(requests, ["name", "route", "notes", "status", "sort_order"])
    return Outcome(_update(pages, accepted, "page_id", values, now), _rejected(checked, named))


def _patch_values(requests: DataFrame, fields: list[str]) -> dict[str, Column]:
    values = {}
    for c in fields:
        if c == "name" or c in requests.columns:
            values[c] = (F.when(F.col(c).isNotNull(), clean(c)) if c in STRIPPED else F.col(c))
    return values


def create_elements(requests: DataFrame, elements: DataFrame, pages: DataFrame,
                    projects: DataFrame, now, start_id: int) -> tuple[Outcome, DataFrame]:
    """Requests: page_id, name, locator_type, locator_value, and any of notes, is_critical,
    sort_order. Returns the outcome and the pages with the status of those that gained one."""
    found = _with_owner(_with_row(requests, pages, "page_id", ["project_id"]), projects,
                        "_project_id")
    found = found.withColumns({"name": identifierify("name"),
                               "locator_type": F.lower(clean("locator_type")),
                               "locator_value": clean("locator_value")})
    checked = _check(found, [
        *_row_checks("page_id")[:3], ("name", F.col("name") == "", "required"),
        ("locator_value", F.col("locator_value") == "", "required")])
    named = _doubled(_accepted(checked), elements, ["page_id", "name"])
    accepted = _accepted(named)
    quality = score_by_type("locator_type")
    values = {
        "project_id": F.col("_project_id"), "page_id": F.col("page_id"), "name": F.col("name"),
        "locator_type": F.col("locator_type"), "locator_value": F.col("locator_value"),
        "quality_label": quality["label"], "quality_score": quality["score"],
        "status": status_by_score(quality["score"]),
        "is_critical": F.coalesce(_given(requests, "is_critical").cast("boolean"), F.lit(False)),
        "notes": clean(_given(requests, "notes")),
        "sort_order": falsy_or(_given(requests, "sort_order").cast("int"), 0),
    }
    after = _insert(elements, accepted, values, DEFAULTS["project_element"], now, start_id)
    return (Outcome(after, _rejected(checked, named)),
            refresh_pages(pages, after, accepted.select("page_id")))


def update_elements(requests: DataFrame, elements: DataFrame, pages: DataFrame,
                    projects: DataFrame, now) -> tuple[Outcome, DataFrame]:
    """Requests: element_id and any of name, locator_type, locator_value, notes, is_critical,
    status, sort_order; NULL keeps. A new locator is graded anew, and decides the status unless
    one is given. One request per element."""
    row = ["project_id", "page_id", "locator_type"]
    found = _with_owner(_with_row(requests, elements, "element_id", row), projects, "_project_id")
    asked = {c: _given(requests, c) for c in ("name", "locator_type", "locator_value", "status")}
    found = found.withColumns({
        "name": F.when(asked["name"].isNotNull(), identifierify(asked["name"])),
        "locator_type": F.when(asked["locator_type"].isNotNull(),
                               F.lower(clean(asked["locator_type"]))),
        "locator_value": F.when(asked["locator_value"].isNotNull(),
                                clean(asked["locator_value"])),
        "status": asked["status"].cast("string")})
    blank = [(c, F.coalesce(F.col(c) == "", F.lit(False)), "required")
             for c in ("name", "locator_value")]
    checked = _check(found, [*_row_checks("element_id"), *blank])
    good = _accepted(checked).withColumn("page_id", F.col("_page_id"))
    named = _doubled(good.filter("name IS NOT NULL"), elements, ["page_id", "name"], "element_id")
    accepted = _accepted(named).unionByName(good.filter("name IS NULL"))
    graded = F.col("locator_type").isNotNull() | F.col("locator_value").isNotNull()
    quality = score_by_type(F.coalesce("locator_type", F.col("_locator_type")))
    accepted = accepted.withColumns({
        "quality_label": F.when(graded, quality["label"]),
        "quality_score": F.when(graded, quality["score"]),
        "status": F.when(graded, status_by_score(quality["score"], F.col("status")))
        .otherwise(F.col("status"))})
    wanted = _patch_values(requests, ["name", "notes", "is_critical", "sort_order"])
    for c in ("locator_type", "locator_value", "status", "quality_label", "quality_score"):
        wanted[c] = F.col(c)
    after = _update(elements, accepted, "element_id", wanted, now)
    return (Outcome(after, _rejected(checked, named)),
            refresh_pages(pages, after, accepted.select("page_id")))


def refresh_pages(pages: DataFrame, elements: DataFrame, touched: DataFrame) -> DataFrame:
    """Work out the status of the touched active pages from their elements."""
    marked = _marked(pages, "id", touched, "_touched")
    fresh = rollup_status(marked, "id", elements, "page_id", only=F.col("_touched"))
    return fresh.select(*pages.columns)


def create_scenarios(requests: DataFrame, scenarios: DataFrame, projects: DataFrame, now,
                     start_id: int) -> Outcome:
    """Requests: project_id, name, and any of source_text, sort_order."""
    found = _with_owner(requests, projects, "project_id").withColumn("name", clean("name"))
    checked = _check(found, [
        ("project_id", _no_user(), "authentication_required"),
        ("project_id", _no_access(), "no_access"),
        ("name", F.col("name") == "", "required")])
    values = {
        "project_id": F.col("project_id"), "name": F.col("name"), "status": F.lit("draft"),
        "source_text": F.coalesce(_given(requests, "source_text", NEW_SCENARIO), F.lit("")),
        "generated_code": F.lit(""),
        "sort_order": falsy_or(_given(requests, "sort_order").cast("int"), 0),
    }
    return Outcome(_insert(scenarios, _accepted(checked), values, DEFAULTS["scenario"], now,
                           start_id), _rejected(checked))


def save_scenarios(requests: DataFrame, scenarios: DataFrame, projects: DataFrame,
                   now) -> Outcome:
    """Requests: scenario_id and any of name, source_text, status, sort_order; NULL keeps."""
    found = _with_owner(_with_row(requests, scenarios, "scenario_id", ["project_id"]), projects,
                        "_project_id")
    name = _given(requests, "name")
    found = found.withColumn("name", F.when(name.isNotNull(), clean(name)))
    checked = _check(found, [
        *_row_checks("scenario_id"),
        ("name", F.coalesce(F.col("name") == "", F.lit(False)), "required")])
    values = _patch_values(requests, ["name", "source_text", "status", "sort_order"])
    return Outcome(_update(scenarios, _accepted(checked), "scenario_id", values, now),
                   _rejected(checked))


def run_payloads(runs: DataFrame, artifacts: DataFrame, per_part: int) -> DataFrame:
    """Runs with their parsed JSON texts and their active artifacts in order of id, at most
    ``per_part`` of them in a row."""
    fields = ["id", "artifact_type", "file_path", "file_name", "mime_type", "size_bytes"]
    nested = with_children(runs, "id", active(artifacts).withColumn("_order", F.col("id")),
                           "run_id", "_order", fields, per_part, "artifacts")
    empty = F.create_map().cast("map<string,string>")
    return nested.withColumns({
        "runtime_snapshot": json_parse_or("runtime_snapshot_json", "map<string,string>", empty),
        "result_summary": json_parse_or("result_summary_json", "map<string,string>", empty)})
