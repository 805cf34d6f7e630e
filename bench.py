"""Seconds per headline query on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rareclass.session import build_session
from suite import all_queries

HEADLINE = (
    "m11_tuned_metrics", "m1_average_precision_tied", "m5_recall_at_fpr_tied", "m7_m8_calibration",
    "t1_impute_medians", "t2_standard_scale", "d1_stratified_split", "d3_partition_dirichlet",
    "g1_knn_join", "g2_minority_typology", "g7_g8_univariate_auc_ks", "g11_price_overlap",
    "o1_smote", "o2_adasyn", "g14_nearest_segments", "g18_minority_census",
    "e1_linear_attribution", "e2_sampled_shapley", "e11_stability_guarded",
    "r1_local_logistic", "r5_average_by_accuracy", "r10_grouped_run_logistic", "r18_pooled_logistic",
    "r18_pooled_boosted", "r11_first_splits", "r11_r12_best_booster", "r25_standalone_clients", "r13_select_prefix", "r20_early_stop_flag",
    "l9_verify_hashes", "l14_migrate_summary", "s6_split_store",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    registered, seconds = all_queries(), {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
