"""Streams over the given tables, run until all input is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from galeframe.functions.physics import valid_time
from galeframe.plans.registry import query
from galeframe.plans.tables import EPOCH_2024, station_name
from galeframe.session import shared_dir
from galeframe.streaming import series as S


def folder(t, name):
    """A new folder: a query run again has to start from nothing."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(t, name):
    return S.read_table_stream(t.spark, t.sf_dir, name)


@query(
    "l01_streaming_hourly_mean",
    """SELECT * FROM (SELECT station_id, date_trunc('hour', "timestamp") AS "timestamp", avg(wind_speed) AS wind_speed FROM raw GROUP BY 1, 2)
    WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT max("timestamp") - INTERVAL 2 HOUR FROM raw)""",
    num="wind_speed",
    ts="timestamp",
)
def l01(t):
    events = table_stream(t, "events").select(
        station_name(F.col("user_id") % t.n_stations).alias("station_id"), F.col("ts").alias("timestamp"),
        (F.col("value") / 20.0).alias("wind_speed"),
    )
    out = S.run_to_end(S.hourly_means(events, "station_id", "timestamp", ["wind_speed"]), folder(t, "hourly"))
    return t.spark.read.parquet(out)


def run_stream(t):
    start = EPOCH_2024 + (F.col("l_orderkey") % 30) * 86400 + (6 + 3 * (F.col("l_orderkey") % 4)) * 3600
    return table_stream(t, "lineitem").select(
        F.col("l_suppkey").alias("grid_id"),
        F.timestamp_seconds(start).alias("starttime"),
        F.col("l_linenumber").cast("double").alias("forecasttime"),
        ((F.col("l_quantity") - 25.0) / 3.0).alias("u_wind"),
        (F.col("l_discount") * 100.0 - 5.0).alias("v_wind"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
    )


@query(
    "l02_streaming_append",
    """SELECT grid_id, starttime, forecasttime, arg_min(u_wind, (order_key, part_key, u_wind)) AS u_wind,
        arg_min(v_wind, (order_key, part_key, u_wind)) AS v_wind, min(order_key) AS order_key, arg_min(part_key, (order_key, part_key, u_wind)) AS part_key
    FROM nwp_raw GROUP BY ALL""",
    num="u_wind v_wind",
    ts="starttime",
)
def l02(t):
    run, row = ["grid_id", "starttime"], ["forecasttime"]
    stream = run_stream(t)
    store = folder(t, "runs")
    S.run_to_end(stream, folder(t, "append"), sink=S.append_new_runs(store, run, row, 7, ["order_key", "part_key", "u_wind"]))
    return S.read_store(t.spark, store, stream.schema)


@query(
    "l03_streaming_latest_forecast",
    """SELECT grid_id, "timestamp", min(forecasttime) AS forecasttime FROM (
        SELECT grid_id, forecasttime, starttime + to_hours(CAST(forecasttime AS INTEGER)) AS "timestamp" FROM nwp_raw) GROUP BY ALL""",
    num="forecasttime",
    ts="timestamp",
)
def l03(t):
    keys = ["grid_id", "timestamp"]
    runs = run_stream(t).withColumn("timestamp", valid_time("starttime", "forecasttime"))
    latest = S.latest_forecasts(runs, ["grid_id"], "timestamp", ["forecasttime"], "60 days")
    store = folder(t, "newest")
    S.run_to_end(latest, folder(t, "latest"), mode="update", sink=S.keep_newest(store, keys, "timestamp"))
    return S.read_latest(t.spark, store, keys)
