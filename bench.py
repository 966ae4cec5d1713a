"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the sample tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names (default: the list below)
"""

import json
import os
import sys
import time

from portolan.queries import QUERIES
from portolan.session import build_session

HEADLINE = [
    "brand_summary", "catalog_search", "catalog_kpis", "dashboard_kpis", "by_year", "by_origin_top8", "top_brands", "top_hs",
    "dispatch_search", "facets", "paginate_items", "executive_summary", "company_counts", "audit_summary", "observation_parse",
    "apply_brand_rules", "unify_brands", "brand_skeleton_clusters", "brand_fuzzy_pairs", "facet_hierarchy", "detect_brand",
    "extract_fields", "extract_items", "exact_duplicates", "replica_delta", "replica_merge", "review_changes", "forward_fill",
    "historical_dispatches", "sheet_totals", "import_client_sheet", "parse_currency_roundtrip", "parse_date_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "portolan-bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(8, int(cpus))), spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["by_year"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
