"""Table schemas, vocabularies and declared foreign keys.

Timestamps are zone-less (``timestamp_ntz``): the modelled application stores wall-clock
times without a zone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

AUDIT = (
    "is_active boolean, created_on timestamp_ntz, created_by bigint, "
    "modified_on timestamp_ntz, modified_by bigint"
)

# Input tables of the test data set.
INPUT_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Application tables; every one also carries ``id`` and the audit columns.
_APP_COLUMNS = {
    "auth_user": "uuid string, first_name string, last_name string, email string, "
                 "account_status string, auth_provider string, google_sub string, "
                 "google_picture_url string, email_verified boolean, last_login_at timestamp_ntz",
    "google_identity": "user_id bigint, provider string, google_sub string, "
                       "email_verified boolean, linked_at timestamp_ntz",
    "project": "uuid string, owner_id bigint, name string, slug string, description string, "
               "status string, base_url string, default_browser string, headed boolean, "
               "retries int, timeout_ms int, trace_mode string, last_opened_on timestamp_ntz",
    "project_page": "uuid string, project_id bigint, name string, route string, status string, "
                    "notes string, sort_order int",
    "project_element": "uuid string, project_id bigint, page_id bigint, name string, "
                       "locator_type string, locator_value string, quality_label string, "
                       "quality_score int, status string, is_critical boolean, notes string, "
                       "sort_order int",
    "scenario": "uuid string, project_id bigint, name string, source_text string, status string, "
                "ast_json string, steps_json string, validation_json string, "
                "generated_code string, source_map_json string, parser_version string, "
                "compiler_version string, last_compiled_on timestamp_ntz, sort_order int",
    "scenario_run": "uuid string, project_id bigint, scenario_id bigint, status string, "
                    "started_on timestamp_ntz, finished_on timestamp_ntz, duration_ms int, "
                    "failed_step_index int, failed_step_source string, error_type string, "
                    "error_message string, runtime_snapshot_json string, "
                    "result_summary_json string, stdout_text string, stderr_text string",
    "run_artifact": "uuid string, run_id bigint, artifact_type string, file_path string, "
                    "file_name string, mime_type string, size_bytes bigint, notes string",
    "billing_offer": "code string, name string, description string, provider string, "
                     "currency string, price_amount double, is_lifetime boolean",
    "billing_payment": "uuid string, user_id bigint, offer_id bigint, provider string, "
                       "provider_order_id string, provider_capture_id string, "
                       "provider_payer_id string, payer_email string, gross_amount double, "
                       "fee_amount double, net_amount double, currency string, status string, "
                       "paid_on timestamp_ntz, refunded_on timestamp_ntz, "
                       "provider_payload_json string, notes string",
    "user_entitlement": "uuid string, user_id bigint, payment_id bigint, code string, "
                        "status string, granted_on timestamp_ntz, revoked_on timestamp_ntz, "
                        "reason string",
    "feedback": "uuid string, user_id bigint, project_id bigint, category string, "
                "status string, subject string, message string, contact_email string, "
                "priority string, admin_reply string, replied_on timestamp_ntz, "
                "resolved_on timestamp_ntz, meta_json string",
}
APP_DDL = {name: f"id bigint not null, {cols}, {AUDIT}" for name, cols in _APP_COLUMNS.items()}


def schema_of(name: str) -> T.StructType:
    """Declared schema of an input or application table."""
    ddl = INPUT_DDL.get(name) or APP_DDL.get(name)
    if ddl is None:
        raise KeyError(f"unknown table {name!r}")
    return T.StructType.fromDDL(ddl)


# The vocabularies stored records must use.
VOCABULARIES = {
    "account_status": ["pending", "active", "blocked", "refunded", "revoked"],
    "locator_type": ["role", "label", "text", "testid", "css"],
    "locator_quality": ["recommended", "good", "acceptable", "fragile"],
    "project_status": ["draft", "active", "archived"],
    "page_status": ["empty", "partial", "ready", "error", "archived"],
    "element_status": ["ready", "warning", "error", "archived"],
    "scenario_status": ["empty", "draft", "blocked", "incomplete", "ready", "running", "passed",
                        "failed", "cancelled", "archived"],
    "run_status": ["idle", "precheck", "compiling", "executing", "passed", "failed", "cancelled",
                   "blocked"],
    "trace_mode": ["off", "on", "retain-on-failure", "on-first-retry"],
    "browser": ["chromium", "firefox", "webkit"],
    "payment_provider": ["paypal"],
    "payment_status": ["created", "approved", "captured", "failed", "refunded", "revoked"],
    "entitlement_code": ["lifetime_access"],
    "entitlement_status": ["active", "revoked", "refunded"],
    "feedback_category": ["suggestion", "question", "complaint", "bug", "billing",
                          "feature_request", "other"],
    "feedback_status": ["new", "in_review", "answered", "closed"],
    "feedback_priority": ["low", "normal", "high", "urgent"],
    "artifact_type": ["trace", "screenshot", "video", "stdout", "stderr", "report", "other"],
}

# Column defaults applied when an insert leaves the column out.
DEFAULTS = {
    "project": {"status": "draft", "default_browser": "chromium", "headed": False, "retries": 0,
                "timeout_ms": 30000, "trace_mode": "retain-on-failure"},
    "project_page": {"status": "partial", "sort_order": 0},
    "project_element": {"locator_type": "role", "quality_label": "recommended",
                        "quality_score": 100, "status": "ready", "is_critical": False,
                        "sort_order": 0},
    "scenario": {"source_text": "", "status": "draft", "ast_json": "{}", "steps_json": "[]",
                 "validation_json": "{}", "source_map_json": "[]", "parser_version": "v1",
                 "compiler_version": "v1", "sort_order": 0},
    "feedback": {"category": "suggestion", "status": "new", "priority": "normal",
                 "meta_json": "{}"},
}

# Columns that readers never see.
HIDDEN = {
    "auth_user": ["uuid", "password", "registration_key", "reset_password_key",
                  "registration_id", "auth_provider", "google_sub", "google_picture_url",
                  "email_verified", "last_login_at"],
    "project": ["uuid"], "project_page": ["uuid"], "project_element": ["uuid"],
    "scenario": ["uuid"], "scenario_run": ["uuid"], "run_artifact": ["uuid"],
    "billing_payment": ["uuid"], "user_entitlement": ["uuid"], "feedback": ["uuid"],
}


class Edge(NamedTuple):
    """A foreign key: ``child.fk`` points at ``parent.key``."""

    child: str
    fk: str
    parent: str
    key: str = "id"
    on_delete: str = "cascade"  # cascade | set_null | restrict


APP_EDGES = [
    Edge("google_identity", "user_id", "auth_user"),
    Edge("project", "owner_id", "auth_user"),
    Edge("project_page", "project_id", "project"),
    Edge("project_element", "project_id", "project"),
    Edge("project_element", "page_id", "project_page"),
    Edge("scenario", "project_id", "project"),
    Edge("scenario_run", "project_id", "project"),
    Edge("scenario_run", "scenario_id", "scenario"),
    Edge("run_artifact", "run_id", "scenario_run"),
    Edge("billing_payment", "user_id", "auth_user"),
    Edge("billing_payment", "offer_id", "billing_offer", on_delete="restrict"),
    Edge("user_entitlement", "user_id", "auth_user"),
    Edge("user_entitlement", "payment_id", "billing_payment", on_delete="set_null"),
    Edge("feedback", "user_id", "auth_user", on_delete="set_null"),
    Edge("feedback", "project_id", "project", on_delete="set_null"),
]

INPUT_EDGES = [
    Edge("nation", "n_regionkey", "region", "r_regionkey"),
    Edge("customer", "c_nationkey", "nation", "n_nationkey"),
    Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
    Edge("orders", "o_custkey", "customer", "c_custkey"),
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Edge("lineitem", "l_partkey", "part", "p_partkey"),
    Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
