"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated,
or ``all``) other queries than the default ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordflow.plans import QUERIES  # noqa: E402

HEADLINE = [
    "table_scan", "where_expr", "project_columns", "ordered_descending", "page_of_rows",
    "inner_join", "band_join", "owned_rows", "without_child", "entitled_users", "with_children",
    "match_fallback", "localized_labels", "foreign_key_audit", "page_status_rollup", "exists_by",
    "hit_stats", "duplicate_report", "latest_status", "transitions", "streak", "unique_slugs",
    "unique_slugs_rivals", "accept_unique", "patch_rows", "update_where", "archive_pages",
    "archive_elements", "delete_cascade", "upsert_users", "clean_text", "slugify_documents",
    "char_entropy", "json_parse_or", "json_extract", "money_text", "validate_rows",
    "unique_values", "event_triage", "payment_actions", "payment_state", "entitlement_ledger",
    "run_state", "apply_captures", "rss_feed",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("recordflow-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["page_status_rollup"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
