"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 for every registered query, BENCH_ONLY for a comma-separated list.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "j7_sales_star_join",
    "t1_daily_revenue",
    "j5_gap_fill_series",
    "w1_row_lags",
    "w2_row_rolling_means",
    "w3_moving_averages",
    "w7_decomposition",
    "a1_kpis",
    "a6_category_totals",
    "a8_category_region_totals",
    "a9_category_region_means",
    "a16_statistics_by_value",
    "a22_numeric_profile",
    "a24_exact_quartiles",
    "a25_correlation_pairs",
    "a26_histogram",
    "a27_box_by_category",
    "f1_cleaned_sales",
    "f3_one_hot",
    "f5_outliers_to_median",
    "f8_feature_importance",
    "f9_lag_rolling",
    "f10_scoring_features",
    "m6_expanding_folds",
    "m8_metrics",
    "m10_high_residuals",
    "m16_alerts",
    "m3_many_series_forecast",
    "st2_stream_daily_totals",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from demandlens.catalog import queries
    from demandlens.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_ONLY"):
        names = os.environ["BENCH_ONLY"].split(",")
    # Start the JVM's code paths once, outside the timings.
    registered["a4_revenue_by_category"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
