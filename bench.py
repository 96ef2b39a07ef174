"""Time the headline queries once each and print one JSON line.

Intermediate tables are written by the first query that needs them; those writes are timed as
entries of their own (``stage_*``) and are part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import stages  # noqa: E402
from checks.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "average_replicates", "replace_nondetects", "percent_censored", "exceedance_rates",
    "exceedance_rates_by_stream", "criteria_summary", "criteria_points", "km_summary",
    "gehan_test", "gehan_by_stream", "censored_trend", "pooled_trend", "oxygen_trend",
    "decadal_changes", "regression_grid", "loglog_fit", "local_smooth", "partition_fractions",
    "iron_ratio_by_sample", "heatmap_cells", "annual_summary", "qq_lognormal", "box_stats",
    "exact_quartiles", "sampling_coverage", "enrich_lookups", "derived_hardness",
    "pivot_parameters", "pca_svdimpute",
)
STAGES = {"stage_replicates": stages.replicates, "stage_storm": stages.storm, "stage_base": stages.base,
          "stage_compared": stages.compared}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name, build in STAGES.items():
        start = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
