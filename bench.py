"""Headline queries, timed one after the other; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from thermogrid.catalog.registry import all_queries  # noqa: E402
from thermogrid.session import local_session  # noqa: E402

HEADLINE = [
    "hottest_cells_with_features",
    "dn_to_lst_P5",
    "heat_class_quantiles_P14",
    "heat_vulnerability_index_P30",
    "live_grid_scoring_ST7",
    "points_per_cell_J2",
    "overlay_area_J3",
    "overlay_length_J4",
    "nearest_feature_J5",
    "scene_static_join_J20",
    "inverse_distance_J22",
    "lattice_edges_J29",
    "zonal_statistics_A1",
    "majority_class_A3",
    "feature_statistics_A13",
    "tercile_confusion_A32",
    "slope_aspect_W11",
    "top_cells_per_scenario_W5",
    "run_all_scenarios_M9",
    "daily_rollup_ST9",
    "grid_prediction_M3",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock does
    times: dict[str, float] = {}
    for key in HEADLINE:
        start = time.perf_counter()
        catalog[key].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
