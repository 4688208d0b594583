"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from analogue.registry import queries  # noqa: E402

HEADLINE = [
    "readmit_by_hospital_latest",
    "readmit_percentiles",
    "readmit_trend_annual",
    "readmit_excess_at_risk",
    "satisfaction_by_hospital",
    "satisfaction_state_domain",
    "satisfaction_trend",
    "readmit_vs_satisfaction",
    "discharge_volume_annual",
    "volume_yoy_growth",
    "volume_by_category",
    "utilization_intensity",
    "readmission_burden",
    "mortality_by_hospital",
    "hai_by_hospital",
    "quality_trend",
    "scorecard_all_periods",
    "state_peer_benchmark",
    "hospital_type_comparison",
    "vw_hospital_scorecard",
    "vw_readmission_trends",
    "vw_quality_summary",
    "vw_satisfaction_detail",
    "vw_state_benchmark",
    "load_hospitals",
    "load_readmissions",
    "load_satisfaction",
    "load_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("readmit_by_hospital_latest", "vw_hospital_scorecard"):
        run(name)  # class loading and code generation
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
