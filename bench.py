"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder (default /root/testdata/sf0.1), BENCH_CPUS the local threads (default 8).
Every query but the long ones runs once to warm up and is then timed over a full evaluation of its result.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from catalog import QUERIES
from tallyframe.session import RECOMMENDED_SETTINGS

HEADLINE = [
    "shape_lineitem", "null_counts_lineitem", "value_counts_documents", "top_values_part", "distinct_counts_orders",
    "class_balance_orders", "describe_lineitem", "quantiles_events", "iqr_outliers_lineitem", "crosstab_rate_orders",
    "density_histogram_events", "group_profile_lineitem", "rank_groups_lineitem", "rank_all_orders",
    "quartile_bands_lineitem", "replace_invalid_lineitem", "cap_extreme_events", "downsample_orders",
    "stratified_split_orders", "label_encode_orders", "correlation_matrix_lineitem", "chi2_scores_lineitem",
    "f_scores_lineitem", "mutual_info_lineitem", "standard_scale_part", "robust_scale_part",
    "quantile_normal_scale_events", "rare_one_hot_part", "confusion_matrix_lineitem", "classification_report_lineitem",
    "ranking_metrics_events", "silhouette_lineitem", "choose_k_part", "logistic_scores_orders",
    "segment_lineitem", "nearest_mutual_info_events", "kmeans_part",
]
# Jobs of minutes, with 200 trees and 200 rounds: timed only with BENCH_LONG=1, once and without a warm-up.
LONG = ["forest_importance_lineitem", "compare_models_lineitem"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder_for_checkpoints = tempfile.TemporaryDirectory(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=RECOMMENDED_SETTINGS)
        .config("spark.checkpoint.dir", folder_for_checkpoints.name)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE + (LONG if os.environ.get("BENCH_LONG") else []):
        for _ in range(1 if name in LONG else 2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    folder_for_checkpoints.cleanup()


if __name__ == "__main__":
    main()
