"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg_daily_sales",
    "agg_order_value",
    "agg_return_rate",
    "agg_unique_customers",
    "annual_metrics",
    "annual_extrapolated",
    "jn_seasonal_attach",
    "jn_lag_365",
    "win_yoy_growth_3y",
    "ts_fold_assign",
    "met_fold_scores",
    "stack_matrix",
    "feat_train",
    "feat_horizon",
    "meta_ridge",
    "meta_bayesian_ridge",
    "ml_random_forest",
    "ml_gbt_shallow",
    "imp_attribution",
    "forecast_full",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dailycast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from dailycast.catalog import QUERIES

    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
