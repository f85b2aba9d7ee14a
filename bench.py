"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.plans import catalog  # noqa: E402
from tabloom.session import local_session  # noqa: E402

HEADLINE = [
    "b_profile_report",
    "b9_describe_wide",
    "b11_correlation_matrix",
    "b13_duplicate_rows",
    "c2_infer_multimodal_documents",
    "d3_impute",
    "d6_text_features",
    "e1_random_split",
    "e2_stratified_split",
    "e4_chronological_split",
    "e5_kfold_assign",
    "f2_ordinal_encode",
    "f3_standard_scale",
    "f5_tfidf",
    "h4_classification_report",
    "h6_roc_auc",
    "h8_regression_scores",
    "h10_ndcg_at_k",
    "j2_search_runs",
    "j4_leaderboard_top5",
    "k1_classify_lines",
    "k3_tail_lines",
    "k6_run_steps",
    "k9_telemetry_state",
    "k10_run_status",
    "a6_fingerprint",
    "g3_cross_validate",
    "g4_compare_models",
    "g11_isolation_forest",
    "g12_forecast",
    "i5_parse_payloads",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8, os.environ.get("BENCH_MEMORY", "8g"))
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["b12_class_imbalance"](spark, folder).collect()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
