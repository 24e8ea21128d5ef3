"""Wall-clock seconds of the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of local cores. Every query is written to the
no-op sink, so all its columns and rows are computed and none is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b2_min_max_scaling", "d3_interval_means", "e1_day_aggregates", "e3_dense_days", "f1_trailing_temperature", "f2_trailing_radiation",
    "f4_last_day_lag", "f5_last_week_lag", "c1_day_slot_pivot", "g3_second_resolution_alignment", "h2_fourier_terms",
    "k21_peak_regressor_features", "i1_kmeans_per_series", "i7_silhouette", "i9_calinski_harabasz", "i11_adjusted_rand",
    "j7_naive_bayes_per_series", "j16_ridge_per_series", "k8_one_vs_one_auc", "k12_full_diagnostics", "k26_last_day", "k27_last_week",
    "k28_arma_weekly_harmonics", "k29_arma_weather_calendar", "k31_additive_model", "k33_persistence_cross_validation",
    "k22_hard_forecast", "k23_soft_forecast", "k24_hybrid_all_settings_per_series", "l1_residual_histogram",
]


def main() -> None:
    from meterloom.catalog import load_entries
    from meterloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="meterloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_entries()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # Start the executors and the first scan before the clock runs.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
