"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is built and fully materialised with the noop sink."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlab.plans import catalog
from flowlab.session import local_session

HEADLINE = [
    "prepare_audit", "scan_csv_flows", "duplicate_profile", "class_distribution", "missing_profile",
    "dedupe_exact", "clean_label", "stratified_sample", "stratified_split", "cap_per_class",
    "undersample_majority", "permute_column", "impute_mean", "standard_scale", "prep_pipeline",
    "per_class_report", "classification_summary", "leaked_rows", "segment_metrics", "redundant_pairs",
    "group_medians", "feature_auc", "signatures", "permutation_importance", "smote_counts", "knn_join",
    "best_per_group", "pivot_metric", "sheet_75", "clf_gaussian_nb", "clf_lda", "clf_qda",
    "clf_decision_tree", "clf_random_forest", "clf_logistic", "clf_adaboost", "clf_mlp", "pca_project",
    "kpca_project",
    "leakage_study",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM and Python workers before the clock runs
    catalog.QUERIES["class_distribution"](spark, sf).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["kernel_linear"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds, failed = {}, {}
    for name in wanted:
        start = time.time()
        try:
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as error:  # a failing query must not hide the other timings
            failed[name] = str(error)[:200]
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
