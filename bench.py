"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from galeframe.plans.registry import load_all  # noqa: E402
from galeframe.session import local_session  # noqa: E402

HEADLINE = [
    "m06_station_skill",
    "d01_height_pivot",
    "d04_resample_midnight",
    "d07_idw_of_nodes",
    "c04_second_model_as_of",
    "c05_as_of_backward",
    "c08_nearest_grid_points",
    "c12_neighbour_series",
    "e01_lag_features",
    "e04_sliding_windows",
    "e06_run_sequences",
    "e08_fill_both_ways",
    "i01_impute_from_similar_rows",
    "i02_impute_station_matrix",
    "i08_global_scaler",
    "j03_time_series_folds",
    "k03_semivariogram",
    "k11_leave_one_out_run",
    "k23_signal_diffusion",
    "m09_stratified_scores",
    "m11_error_box_statistics",
    "n12_patched_store",
    "n17_load_attrition",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    line = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
