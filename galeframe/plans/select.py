"""Sources, column selection, filters, sorting and set operations."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from galeframe.operators import columns as C
from galeframe.operators.forecasts import latest_run, nearest_level
from galeframe.operators.ordering import first_rows
from galeframe.operators.quality import check_layouts
from galeframe.operators.reshape import pivot_mean
from galeframe.plans.aggregates import RUN
from galeframe.plans.registry import query
from galeframe.plans.tables import station_name
from galeframe.session import shared_dir
from galeframe.sources import preprocess, readers, writers
from galeframe.sources.run_files import read_run_files, write_run_files

MAE_SQL = "SELECT station_id, avg(abs(pred - gt)) AS mae FROM predictions GROUP BY ALL"


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, tzinfo=timezone.utc)


def folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "a01_station_files",
    'SELECT station_id, "timestamp", wind_speed, temperature FROM hourly',
    num="wind_speed temperature",
    ts="timestamp",
)
def a01(t):
    path = folder(t, "stations")
    writers.write_per_station(t.hourly, path)
    schema = "timestamp timestamp, wind_speed double, temperature double"
    return readers.read_stations(t.spark, path, schema).select("station_id", "timestamp", "wind_speed", "temperature")


RUN_FILES_SQL = """SELECT n.starttime, n.forecasttime, {columns}, CAST(hour(n.starttime) AS INTEGER) AS run_hour,
    lpad(CAST(grid_id AS VARCHAR), 5, '0') AS station_id, latitude, longitude FROM nwp n JOIN nodes USING (grid_id)"""


def run_files(t, kind, columns, lon_first):
    """The runs written as a tree, one file for each hour, station and point, and read back."""
    path = folder(t, f"runs-{kind}")
    rows = t.nwp.join(t.nodes, "grid_id").withColumn("station_id", station_name(F.col("grid_id")))
    write_run_files(rows.select("starttime", "forecasttime", *columns, "station_id", "latitude", "longitude"), path, kind, lon_first)
    schema = ", ".join(f"{c} {'timestamp' if c == 'starttime' else 'double'}" for c in ("starttime", "forecasttime", *columns))
    return read_run_files(t.spark, path, schema, kind, lon_first)


@query(
    "a02_multilevel_run_files",
    RUN_FILES_SQL.format(columns="toplevel, bottomlevel, u_wind, v_wind, n.qs"),
    num="forecasttime toplevel bottomlevel u_wind v_wind qs latitude longitude",
    ts="starttime",
)
def a02(t):
    return run_files(t, "ML", ["toplevel", "bottomlevel", "u_wind", "v_wind", "qs"], lon_first=False)


@query(
    "a03_single_level_run_files",
    RUN_FILES_SQL.format(columns="toplevel, temperature, pressure"),
    num="forecasttime toplevel temperature pressure latitude longitude",
    ts="starttime",
)
def a03(t):
    return run_files(t, "SL", ["toplevel", "temperature", "pressure"], lon_first=True)


@query(
    "a10_summary_files",
    f"""SELECT station_id, mae FROM ({MAE_SQL}) UNION ALL SELECT 'mean', avg(mae) FROM ({MAE_SQL})""",
    num="mae",
)
def a10(t):
    path = folder(t, "summary")
    mae = t.predictions.groupBy("station_id").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    writers.write_csv(mae, f"{path}/per_station")
    back = readers.read_table(t.spark, f"{path}/per_station", "station_id string, mae double")
    writers.write_csv(back.agg(F.lit("mean").alias("station_id"), F.avg("mae").alias("mae")), f"{path}/summary")
    return back.unionByName(readers.read_table(t.spark, f"{path}/summary", "station_id string, mae double"))


@query(
    "a04_second_model",
    "SELECT starttime, forecasttime, u_wind AS u_wind_10m, v_wind AS v_wind_10m FROM ec",
    num="u_wind_10m v_wind_10m",
    ts="starttime",
)
def a04(t):
    path = folder(t, "second")
    mixed = t.ec.select("starttime", "forecasttime", F.col("u_wind").alias("u_wind10m"), F.col("v_wind").alias("v_wind_10m"))
    mixed.write.parquet(path)
    return readers.read_second_model(t.spark, path, ["u_wind_10m", "v_wind10m"])[0]


@query(
    "a05_multilevel_filter",
    """SELECT grid_id, starttime, forecasttime, u_wind, n.qs FROM nwp n JOIN nodes USING (grid_id)
    WHERE starttime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND height = 38 AND latitude < 49""",
    num="u_wind qs",
    ts="starttime",
)
def a05(t):
    rows = t.nwp.join(t.nodes, "grid_id").filter(readers.multilevel_filter(None, at(5), at(12), [38]))
    return rows.filter("latitude < 49").select(*RUN, "u_wind", "qs")


@query("a06_latest_run", "SELECT max(starttime) AS starttime FROM nwp", ts="starttime")
def a06(t):
    return latest_run(t.nwp)


@query(
    "a07_station_metadata",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS station_id, latitude, longitude, station_height FROM supplier
    JOIN stations ON station_id = lpad(CAST(s_suppkey AS VARCHAR), 5, '0')
    UNION ALL SELECT lpad(CAST(grid_id AS VARCHAR), 5, '0'), latitude, longitude, NULL FROM grid""",
    num="latitude longitude station_height",
)
def a07(t):
    parks = t.grid.select(F.col("grid_id").alias("park_id"), "latitude", "longitude", F.lit(None).alias("altitude"))
    return readers.normalise_metadata(t.stations).unionByName(readers.normalise_metadata(parks))


@query(
    "a09_csv_to_parquet",
    "SELECT event_id, station_id, reading FROM raw",
    num="reading",
)
def a09(t):
    path = folder(t, "csv")
    # a station in one file of the tree is one folder of the target, not one for each file
    writers.write_csv(t.raw.select("event_id", "station_id", "reading").repartition("station_id"), f"{path}/in")
    writers.csv_to_parquet(
        t.spark, f"{path}/in", f"{path}/out", "event_id bigint, station_id string, reading double", ["station_id"]
    )
    back = t.spark.read.schema("event_id bigint, reading double, source string, station_id string").parquet(f"{path}/out")
    return back.select("event_id", "station_id", "reading")


@query(
    "a11_result_files",
    f"""SELECT station_id, mae, 'DCRNN' AS model, 'base' AS variant, 'val' AS split, 0 AS fold, 'excl_val' AS scenario FROM ({MAE_SQL})
    UNION ALL SELECT station_id, mae, 'DCRNN', 'base', 'test', 1, 'excl_val' FROM ({MAE_SQL})""",
    num="mae",
)
def a11(t):
    path = folder(t, "results")
    mae = t.predictions.groupBy("station_id").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    for name in ("dcrnn_base_fold0", "dcrnn_base_test_fold1", "unknown_fold0"):
        writers.write_csv(mae, f"{path}/{name}.csv", sep=",")
    out = readers.read_results(
        t.spark, f"{path}/*.csv", "station_id string, mae double", {"dcrnn_base": ("DCRNN", "base")},
        {"scenario": F.lit("excl_val")},
    )
    return out.drop("prefix")


def wide_runs(t):
    """Runs with one column per level, named as the feature lists expect."""
    cols = {"wind_speed": "wind_speed_h{}", "u_wind": "u_wind_h{}", "v_wind": "v_wind_h{}", "temperature": "temperature_h{}"}
    return pivot_mean(t.nwp, RUN, "height", [10, 38], cols)


WIDE_SQL = """SELECT grid_id, starttime, forecasttime, avg(wind_speed) FILTER (height = 10) AS wind_speed_h10, avg(wind_speed) FILTER (height = 38) AS wind_speed_h38,
    avg(u_wind) FILTER (height = 10) AS u_wind_h10, avg(v_wind) FILTER (height = 10) AS v_wind_h10,
    avg(u_wind) FILTER (height = 38) AS u_wind_h38, avg(v_wind) FILTER (height = 38) AS v_wind_h38,
    avg(temperature) FILTER (height = 10) AS temperature_h10, avg(temperature) FILTER (height = 38) AS temperature_h38 FROM nwp GROUP BY ALL"""


@query(
    "b01_select_features",
    f"SELECT grid_id, starttime, forecasttime, wind_speed_h10, temperature_h38 FROM ({WIDE_SQL})",
    num="wind_speed_h10 temperature_h38",
    ts="starttime",
)
def b01(t):
    return C.select_features(wide_runs(t), RUN, ["wind_speed_h10", "wind_speed", "temperature_h38"])


@query(
    "b02_feature_roles",
    f"SELECT grid_id, starttime, forecasttime, wind_speed_h10, wind_speed_h38, temperature_h10 FROM ({WIDE_SQL})",
    num="wind_speed_h10 wind_speed_h38 temperature_h10",
    ts="starttime",
)
def b02(t):
    wide = wide_runs(t)
    known, observed = C.resolve_roles(wide.columns, ["wind_speed_nwp"], ["temperature_h10"])
    return wide.select(*RUN, *known, *observed)


@query(
    "b03_period_with_margin",
    """SELECT grid_id, starttime, forecasttime, height FROM nwp
    WHERE starttime >= TIMESTAMP '2024-01-12' - INTERVAL 7 DAY AND starttime <= TIMESTAMP '2024-01-20'""",
    ts="starttime",
)
def b03(t):
    rows = t.nwp.filter(C.in_period("starttime", at(12), at(25), cutoff=at(20)))
    return rows.select("grid_id", "starttime", "forecasttime", "height")


@query("b04_leads", "SELECT grid_id, starttime, forecasttime, height FROM nwp WHERE forecasttime BETWEEN 1 AND 5", ts="starttime")
def b04(t):
    return t.nwp.filter(F.col("forecasttime").between(1, 5)).select("grid_id", "starttime", "forecasttime", "height")


@query("b05_run_hours", "SELECT grid_id, starttime, forecasttime, height FROM nwp WHERE hour(starttime) IN (6, 12)", ts="starttime")
def b05(t):
    return t.nwp.filter(C.run_hour_in("starttime", [6, 12])).select("grid_id", "starttime", "forecasttime", "height")


@query(
    "b06_nearest_level",
    "SELECT grid_id, starttime, forecasttime, wind_speed FROM nwp WHERE abs(height - 38) <= 0.01",
    num="wind_speed",
    ts="starttime",
)
def b06(t):
    return t.nwp.filter(nearest_level([10, 38], "height", 100.0)).select(*RUN, "wind_speed")


@query(
    "b07_feature_mode",
    f"SELECT grid_id, starttime, forecasttime, u_wind_h10, v_wind_h10, temperature_h10 FROM ({WIDE_SQL})",
    num="u_wind_h10 v_wind_h10 temperature_h10",
    ts="starttime",
)
def b07(t):
    names = ["wind_speed_h10", "u_wind_h10", "v_wind_h10", "temperature_h10"]
    return wide_runs(t).select(*RUN, *C.features_of_mode(names, "components"))


@query("b08_drop_missing", "SELECT event_id, temperature FROM raw WHERE temperature IS NOT NULL", num="temperature")
def b08(t):
    return t.raw.select("event_id", "temperature").na.drop("any")


@query(
    "b09_station_lists",
    """SELECT station_id, "timestamp", wind_speed FROM hourly WHERE station_id IN (SELECT station_id FROM stations WHERE latitude < 50.5)
    AND station_id NOT IN (SELECT station_id FROM stations WHERE station_height > 2000)""",
    num="wind_speed",
    ts="timestamp",
)
def b09(t):
    pool = t.stations.filter("latitude < 50.5").select("station_id")
    excluded = t.stations.filter("station_height > 2000").select("station_id")
    rows = t.hourly.join(pool, "station_id", "left_semi").join(excluded, "station_id", "left_anti")
    return rows.select("station_id", "timestamp", "wind_speed")


@query(
    "b10_static_columns",
    """SELECT event_id, station_height, latitude FROM raw JOIN stations USING (station_id)""",
    num="station_height latitude",
)
def b10(t):
    return t.raw.join(t.stations, "station_id").select("event_id", "station_height", "latitude")


@query(
    "b11_aligned_start",
    """SELECT event_id FROM raw JOIN (SELECT station_id, min("timestamp") AS f FROM raw GROUP BY ALL) USING (station_id)
    WHERE "timestamp" >= CASE WHEN hour(f) % 5 = 0 THEN f ELSE time_bucket(INTERVAL 5 HOUR, f, TIMESTAMP '1970-01-01') + INTERVAL 5 HOUR END""",
)
def b11(t):
    return C.aligned_start(t.raw, ["station_id"], "timestamp", hours=5).select("event_id")


@query(
    "b12_time_of_day",
    """SELECT station_id, "timestamp", wind_speed FROM hourly WHERE strftime("timestamp", '%H:%M:%S') = '06:00:00'""",
    num="wind_speed",
    ts="timestamp",
)
def b12(t):
    return t.hourly.filter(C.at_time_of_day("timestamp", 6)).select("station_id", "timestamp", "wind_speed")


@query(
    "f01_sorted_runs",
    "SELECT starttime, forecasttime, toplevel, grid_id, u_wind FROM nwp ORDER BY starttime, forecasttime, toplevel, grid_id",
    num="u_wind",
    ts="starttime",
)
def f01(t):
    keys = ["starttime", "forecasttime", "toplevel", "grid_id"]
    return t.nwp.select(*keys, "u_wind").orderBy(*keys)


@query(
    "f02_best_and_worst_stations",
    f"""WITH m AS ({MAE_SQL}) SELECT * FROM (SELECT 'best' AS side, * FROM m ORDER BY round(mae, 9), station_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'worst', * FROM m ORDER BY round(mae, 9) DESC, station_id LIMIT 5)""",
    num="mae",
)
def f02(t):
    mae = t.predictions.groupBy("station_id").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    mae = mae.select("station_id", "mae")
    best = mae.orderBy(F.round("mae", 9), "station_id").limit(5).select(F.lit("best").alias("side"), "*")
    worst = mae.orderBy(F.round("mae", 9).desc(), "station_id").limit(5).select(F.lit("worst").alias("side"), "*")
    return best.unionByName(worst)


@query(
    "f04_best_trials",
    """SELECT study_name, number, value FROM trials WHERE state = 'COMPLETE'
    QUALIFY row_number() OVER (PARTITION BY study_name ORDER BY value, number) <= 10""",
    num="value",
)
def f04(t):
    done = t.trials.filter("state = 'COMPLETE'").select("study_name", "number", "value")
    return first_rows(done, ["study_name"], ["value", "number"], 10)


@query(
    "f05_first_rows",
    """SELECT event_id FROM raw QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "timestamp", event_id) <= 50""",
)
def f05(t):
    return first_rows(t.raw, ["station_id"], ["timestamp", "event_id"], 50).select("event_id")


@query(
    "g01_concatenation",
    """SELECT grid_id, starttime, forecasttime, height, u_wind FROM nwp
    UNION ALL SELECT point, starttime, CAST(forecasttime AS DOUBLE), CAST(NULL AS INTEGER), u_wind FROM ec""",
    num="u_wind",
    ts="starttime",
)
def g01(t):
    second = t.ec.select(F.col("point").alias("grid_id"), "starttime", F.col("forecasttime").cast("double").alias("forecasttime"), "u_wind")
    return t.nwp.select(*RUN, "height", "u_wind").unionByName(second, allowMissingColumns=True)


@query(
    "g02_key_difference",
    "SELECT DISTINCT starttime, CAST(forecasttime AS BIGINT) AS forecasttime FROM ec EXCEPT SELECT starttime, CAST(forecasttime AS BIGINT) FROM nwp",
    ts="starttime",
)
def g02(t):
    key = ["starttime", F.col("forecasttime").cast("bigint").alias("forecasttime")]
    return t.ec.select(*key).subtract(t.nwp.select(*key))


@query(
    "g03_key_intersection",
    "SELECT DISTINCT starttime, CAST(forecasttime AS BIGINT) AS forecasttime FROM ec INTERSECT SELECT starttime, CAST(forecasttime AS BIGINT) FROM nwp",
    ts="starttime",
)
def g03(t):
    key = ["starttime", F.col("forecasttime").cast("bigint").alias("forecasttime")]
    return t.ec.select(*key).intersect(t.nwp.select(*key))


@query(
    "g04_checked_layouts",
    """SELECT station_id, "timestamp", wind_speed, temperature FROM hourly UNION ALL
    SELECT station_id, "timestamp", wind_speed, temperature FROM raw""",
    num="wind_speed temperature",
    ts="timestamp",
)
def g04(t):
    cols = ["station_id", "timestamp", "wind_speed", "temperature"]
    frames = {"hourly": t.hourly.select(*cols), "raw": t.raw.select(*cols)}
    check_layouts({name: df.columns for name, df in frames.items()})
    return frames["hourly"].unionByName(frames["raw"])


@query("g05_distinct_nodes", "SELECT DISTINCT grid_id, latitude, longitude FROM nwp JOIN nodes USING (grid_id)", num="latitude longitude")
def g05(t):
    return t.nwp.select("grid_id").distinct().join(t.nodes, "grid_id")


@query(
    "o01_preprocessor_by_source",
    """SELECT station_id, date_trunc('hour', "timestamp") AS "timestamp", avg(wind_speed) AS wind_speed FROM raw
    WHERE temperature IS NOT NULL GROUP BY ALL""",
    num="wind_speed",
    ts="timestamp",
)
def o01(t):
    rows = t.raw.select("station_id", "timestamp", "wind_speed", "temperature")
    prepared = preprocess.prepare(rows, "data/synth_wind/", temperature="temperature")
    return prepared.filter("wind_speed IS NOT NULL").select("station_id", "timestamp", "wind_speed")
