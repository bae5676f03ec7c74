"""Run and archive services over batches of requests; see :mod:`services` for the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import clean, falsy_or
from recordflow.operators.agg import RUN_TO_SCENARIO, latest
from recordflow.operators.change import _lit, archive, archive_elements, archive_pages
from recordflow.operators.join import left_unique
from recordflow.operators.services import (Outcome, _accepted, _check, _given, _insert, _rejected,
                                           _row_checks, _with_owner, _with_row)

# States a run and its scenario take at the start, and a scenario's after any
# finish that is not one of the known ends.
RUN_START, SCENARIO_START, SCENARIO_ELSE = "precheck", "running", "ready"
STATUS_FIELDS = ["status", "error_type", "error_message"]
FINISH_FIELDS = [*STATUS_FIELDS, "duration_ms", "failed_step_index", "failed_step_source",
                 "result_summary_json", "stdout_text", "stderr_text"]


def _about(requests: DataFrame, table: DataFrame, key: str, projects: DataFrame,
           take=()) -> DataFrame:
    """Requests with the owner of the row they are about, checked for presence and access;
    archived rows are open to these services."""
    found = _with_owner(_with_row(requests, table, key, ["project_id", *take]), projects,
                        "_project_id")
    return _check(found, _row_checks(key)[:3])


def _set_status(table: DataFrame, latest_status: DataFrame) -> DataFrame:
    """``table`` with the given (id, _status)."""
    after = left_unique(table, latest_status, [("id", "id")], ["_status"])
    return after.withColumn("status", F.coalesce("_status", F.col("status"))).select(
        *table.columns)


def start_runs(requests: DataFrame, runs: DataFrame, scenarios: DataFrame, projects: DataFrame,
               now, start_id: int) -> tuple[Outcome, DataFrame]:
    """Requests: scenario_id and maybe runtime_snapshot_json. Returns the runs and the scenarios."""
    checked = _about(requests, scenarios, "scenario_id", projects)
    accepted = _accepted(checked)
    values = {
        "project_id": F.col("_project_id"), "scenario_id": F.col("scenario_id"),
        "status": F.lit(RUN_START), "started_on": _lit(now, "timestamp_ntz"),
        "runtime_snapshot_json": falsy_or(_given(requests, "runtime_snapshot_json")
                                          .cast("string"), "{}", ""),
    }
    started = accepted.select(F.col("scenario_id").alias("id"),
                              F.lit(SCENARIO_START).alias("_status")).distinct()
    after = _insert(runs, accepted, values, {"result_summary_json": "{}"}, now, start_id)
    return Outcome(after, _rejected(checked)), _set_status(scenarios, started)


def update_runs(requests: DataFrame, runs: DataFrame, projects: DataFrame) -> Outcome:
    """Requests: run_id, status, and maybe error_type, error_message, which are cleared where
    not given. The last request per run counts; its scenario is not touched."""
    checked = _about(requests, runs, "run_id", projects)
    return Outcome(_overwrite(runs, _accepted(checked), requests, STATUS_FIELDS, {}),
                   _rejected(checked))


def finish_runs(requests: DataFrame, runs: DataFrame, scenarios: DataFrame, projects: DataFrame,
                now) -> tuple[Outcome, DataFrame]:
    """Requests: run_id, status and the result fields, cleared where not given. Returns the runs
    and the scenarios, whose status follows their last finish."""
    checked = _about(requests, runs, "run_id", projects, ["scenario_id"])
    accepted = _accepted(checked)
    after = _overwrite(runs, accepted, requests, FINISH_FIELDS,
                       {"finished_on": _lit(now, "timestamp_ntz")})
    status = F.lit(SCENARIO_ELSE)
    for source, target in RUN_TO_SCENARIO.items():
        status = F.when(F.col("status") == source, F.lit(target)).otherwise(status)
    ends = latest(accepted.select(F.col("_scenario_id").alias("id"), "request_id",
                                  status.alias("_status")), ["id"], ["request_id"])
    return Outcome(after, _rejected(checked)), _set_status(scenarios, ends.select("id", "_status"))


def _overwrite(runs: DataFrame, accepted: DataFrame, requests: DataFrame, fields: list[str],
               values: dict) -> DataFrame:
    """Set all fields of the runs asked for, to NULL where a request leaves one out."""
    sets = {}
    for c in fields:
        if c in runs.columns:
            value = _given(requests, c).cast(runs.schema[c].dataType)
            sets[c] = falsy_or(value, "{}", "") if c.endswith("_json") else value
    sets.update({c: v for c, v in values.items() if c in runs.columns})
    rows = accepted.select(F.col("run_id").alias("id"), "request_id",
                           *[v.alias(f"_s_{c}") for c, v in sets.items()],
                           F.lit(True).alias("_hit"))
    last = latest(rows, ["id"], ["request_id"]).drop("request_id")
    after = left_unique(runs, last, [("id", "id")], [c for c in last.columns if c != "id"])
    return after.select(*[
        F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        if c in sets else F.col(c) for c in runs.columns])


def attach_artifacts(requests: DataFrame, artifacts: DataFrame, runs: DataFrame,
                     projects: DataFrame, now, start_id: int) -> Outcome:
    """Requests: run_id, artifact_type, file_path, and any of file_name, mime_type, size_bytes,
    notes."""
    checked = _about(requests, runs, "run_id", projects)
    values = {
        "run_id": F.col("run_id"), "artifact_type": F.col("artifact_type"),
        "file_path": F.col("file_path"),
        "file_name": _given(requests, "file_name").cast("string"),
        "mime_type": _given(requests, "mime_type").cast("string"),
        "size_bytes": F.coalesce(_given(requests, "size_bytes").cast("bigint"), F.lit(0)),
        "notes": clean(_given(requests, "notes")),
    }
    return Outcome(_insert(artifacts, _accepted(checked), values, {}, now, start_id),
                   _rejected(checked))


def archive_own_projects(requests: DataFrame, projects: DataFrame) -> Outcome:
    """Requests: project_id."""
    checked = _check(_with_owner(requests, projects, "project_id"), [
        ("project_id", F.coalesce(F.col("user_id"), F.lit(0)) == 0, "authentication_required"),
        ("project_id", F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")),
         "no_access")])
    return Outcome(archive(projects, "id", _accepted(checked).select("project_id")),
                   _rejected(checked))


def archive_own_pages(requests: DataFrame, pages: DataFrame, elements: DataFrame,
                      projects: DataFrame) -> tuple[Outcome, DataFrame]:
    """Requests: page_id. Returns the pages, and the elements archived with them."""
    checked = _about(requests, pages, "page_id", projects)
    after, parts = archive_pages(pages, elements, _accepted(checked).select("page_id"))
    return Outcome(after, _rejected(checked)), parts


def archive_own_elements(requests: DataFrame, elements: DataFrame, pages: DataFrame,
                         projects: DataFrame) -> tuple[Outcome, DataFrame]:
    """Requests: element_id. Returns the elements, and the pages with their new status."""
    checked = _about(requests, elements, "element_id", projects)
    fresh, after = archive_elements(pages, elements, _accepted(checked).select("element_id"))
    return Outcome(after, _rejected(checked)), fresh


def archive_own_scenarios(requests: DataFrame, scenarios: DataFrame,
                          projects: DataFrame) -> Outcome:
    """Requests: scenario_id."""
    checked = _about(requests, scenarios, "scenario_id", projects)
    return Outcome(archive(scenarios, "id", _accepted(checked).select("scenario_id")),
                   _rejected(checked))
