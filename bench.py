"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hazardloom.plans import catalog, tables  # noqa: E402
from hazardloom.session import build_session  # noqa: E402

HEADLINE = [
    "top_states",
    "state_type_percentages",
    "quality_report",
    "numeric_summary",
    "correlation_matrix",
    "policy_imputation",
    "median_mode_imputation",
    "linear_interpolation",
    "nearest_neighbour_imputation",
    "date_features",
    "cleaned_pages",
    "cleaned_pages_full",
    "merged_text",
    "top_tokens",
    "text_quality",
    "token_length_report",
    "frequent_itemsets",
    "rule_summary",
    "risk_by_class",
    "weight_sweep",
    "ranking_stability",
    "narratives",
    "stratified_split",
    "classification_report",
    "boosted_model",
    "learned_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    jobs: dict[str, int] = {}
    for name in HEADLINE:
        # every query builds its own intermediate tables
        tables.forget()
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "jobs": jobs,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
