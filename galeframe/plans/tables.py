"""Station, forecast and result tables derived from the given parquet tables.

Each table is one expression per column, written once for Spark and once in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions.physics import level_height, valid_time, wind_speed
from galeframe.operators.ordering import first_rows
from galeframe.operators.reshape import resample_mean

EPOCH_2024 = 1704067200


def _grid_position(key: str) -> list[Column]:
    """Lattice of 41 latitudes; longitude columns are spread over the whole domain."""
    column = F.floor(F.col(key) / 41)
    lat = 47.5 + (F.col(key) % 41) * 0.19 + F.floor(F.col(key) / 15047) * 0.001
    lon = 6.0 + ((column * 100) % 367) * 0.025
    return [lat.alias("latitude"), lon.alias("longitude")]


def _grid_position_sql(key: str) -> str:
    return f"""47.5 + ({key} % 41) * CAST(0.19 AS DOUBLE) + ({key} // 15047) * CAST(0.001 AS DOUBLE) AS latitude,
    6.0 + ((({key} // 41) * 100) % 367) * CAST(0.025 AS DOUBLE) AS longitude"""


def station_name(key: Column) -> Column:
    return F.lpad(key.cast("string"), 5, "0")


class Tables:
    """Lazily built inputs of the registered queries."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # stored without zone; all times here are UTC
        zoned = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
        return df.withColumns(zoned) if zoned else df

    @cached_property
    def stations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            station_name(key).alias("station_id"),
            (47.5 + (key * 37 % 751) / 100.0).alias("latitude"),
            (6.0 + (key * 53 % 907) / 100.0).alias("longitude"),
            (F.abs("s_acctbal") / 4.0).alias("station_height"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("grid_id"), *_grid_position("c_custkey")
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Grid nodes that have forecast runs."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("grid_id"), *_grid_position("s_suppkey")
        )

    @cached_property
    def n_stations(self) -> int:
        return max(1, self.table("supplier").count())

    @cached_property
    def raw(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            station_name(F.col("user_id") % self.n_stations).alias("station_id"),
            F.col("ts").alias("timestamp"),
            (F.col("value") / 20.0).alias("wind_speed"),
            ((F.col("event_id") * 47) % 360).cast("double").alias("wind_direction"),
            F.when(F.col("event_type") != "error", (F.col("event_id") * 31 % 400) / 10.0 - 10.0).alias(
                "temperature"
            ),
            F.col("event_type").alias("channel"),
            F.col("value").alias("reading"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return resample_mean(
            self.raw, ["station_id"], "timestamp", 3600, ["wind_speed", "temperature"]
        )

    @cached_property
    def nwp_raw(self) -> DataFrame:
        day = F.col("l_orderkey") % 30
        upper = F.col("l_partkey") % 2 == 1
        start = EPOCH_2024 + day * 86400 + (6 + 3 * (F.col("l_orderkey") % 4)) * 3600
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("grid_id"),
            F.timestamp_seconds(start).alias("starttime"),
            F.col("l_linenumber").cast("double").alias("forecasttime"),
            F.when(upper, 56.0).otherwise(20.0).alias("toplevel"),
            F.when(upper, 20.0).otherwise(0.0).alias("bottomlevel"),
            ((F.col("l_quantity") - 25.0) / 3.0).alias("u_wind"),
            (F.col("l_discount") * 100.0 - 5.0).alias("v_wind"),
            (273.15 + F.col("l_tax") * 200.0).alias("temperature"),
            (95000.0 + F.col("l_extendedprice") / 10.0).alias("pressure"),
            F.when(F.col("l_tax") < 0.075, F.col("l_quantity") / 10000.0).alias("qs"),
            F.col("l_orderkey").alias("order_key"),
            F.col("l_partkey").alias("part_key"),
        )

    @cached_property
    def nwp(self) -> DataFrame:
        """One row per node, run, lead and level: the last one delivered."""
        newest = ["order_key", "part_key", "pressure", "u_wind", "v_wind", "temperature"]
        rows = first_rows(
            self.nwp_raw,
            ["grid_id", "starttime", "forecasttime", "toplevel"],
            [F.desc(c) for c in newest],
        )
        return rows.drop("order_key", "part_key").withColumns(
            {
                "height": level_height("toplevel", "bottomlevel"),
                "timestamp": valid_time("starttime", "forecasttime"),
                "wind_speed": wind_speed("u_wind", "v_wind"),
            }
        )

    @cached_property
    def ec(self) -> DataFrame:
        """Second forecast model, several deliveries per key."""
        start = EPOCH_2024 + (F.col("o_orderkey") % 31) * 86400 + 43200 * (F.col("o_custkey") % 2)
        return self.table("orders").select(
            (F.col("o_custkey") % 3).alias("point"),
            F.timestamp_seconds(start).alias("starttime"),
            (F.col("o_orderkey") * 7 % 58).alias("forecasttime"),
            (F.col("o_totalprice") / 40000.0 - 3.0).alias("u_wind"),
            (F.col("o_totalprice") / 50000.0 - 4.0).alias("v_wind"),
            F.col("o_orderkey").alias("order_key"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        gt = F.col("l_quantity") / 5.0
        return self.table("lineitem").select(
            station_name(F.col("l_suppkey")).alias("station_id"),
            F.col("l_shipdate").alias("run_time"),
            F.col("l_linenumber").cast("int").alias("horizon"),
            gt.alias("gt"),
            (gt + (F.col("l_discount") - 0.05) * 10.0).alias("pred"),
            (gt + (F.col("l_tax") - 0.04) * 20.0).alias("nwp_ref"),
            F.lit(5.0).alias("pers_ref"),
        )

    @cached_property
    def topo(self) -> DataFrame:
        spread = (F.col("p_size") % 5).cast("double")
        return self.table("part").select(
            F.col("p_partkey").alias("location_id"),
            F.col("p_retailprice").alias("elevation"),
            F.col("p_size").cast("double").alias("slope"),
            (F.col("p_partkey") * 29 % 360).cast("double").alias("aspect"),
            spread.alias("elev_std"),
            F.when(spread > 0, F.col("p_retailprice") / (spread * 100.0)).alias("tdi"),
            F.when(F.col("p_size") > 10, F.col("p_size") * 1.5).alias("dist_coast_km"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        kind = F.col("p_partkey") % 3
        return self.table("part").select(
            station_name(F.col("p_partkey")).alias("station_id"),
            F.when(kind == 0, "static").when(kind == 1, "past").otherwise("future").alias("feature_type"),
            F.col("p_brand").alias("feature_name"),
            (F.col("p_size") / 50.0).alias("avg_weight"),
        )

    @cached_property
    def trials(self) -> DataFrame:
        state = F.col("o_orderstatus")
        return self.table("orders").select(
            F.concat(F.lit("cl_m-tft_out-48_freq-1h_"), F.substring("o_orderpriority", 1, 1)).alias("study_name"),
            F.col("o_orderkey").alias("number"),
            F.when(state == "F", "COMPLETE").when(state == "O", "PRUNED").otherwise("FAIL").alias("state"),
            F.col("o_totalprice").alias("value"),
            F.col("o_orderdate").alias("datetime_complete"),
        )

    @cached_property
    def client_stats(self) -> DataFrame:
        joined = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return joined.groupBy(F.col("c_mktsegment").alias("client_id")).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("o_totalprice").alias("mu"),
            F.var_pop("o_totalprice").alias("var"),
        )


SQL_TABLES = {
    "stations": """
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS station_id,
        47.5 + (s_suppkey * 37 % 751) / 100.0 AS latitude,
        6.0 + (s_suppkey * 53 % 907) / 100.0 AS longitude,
        abs(s_acctbal) / 4.0 AS station_height
    FROM supplier""",
    "grid": f"SELECT c_custkey AS grid_id, {_grid_position_sql('c_custkey')} FROM customer",
    "nodes": f"SELECT s_suppkey AS grid_id, {_grid_position_sql('s_suppkey')} FROM supplier",
    "raw": """
    SELECT event_id, lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 5, '0') AS station_id, ts AS "timestamp",
        value / 20.0 AS wind_speed, CAST(event_id * 47 % 360 AS DOUBLE) AS wind_direction,
        CASE WHEN event_type <> 'error' THEN (event_id * 31 % 400) / 10.0 - 10.0 END AS temperature,
        event_type AS channel, value AS reading
    FROM events""",
    "hourly_filled": """
    SELECT station_id, date_trunc('hour', "timestamp") AS "timestamp",
        avg(wind_speed) AS wind_speed, avg(temperature) AS temperature
    FROM raw GROUP BY ALL""",
    "hourly": """
    SELECT c.station_id, c.ts AS "timestamp", h.wind_speed, h.temperature
    FROM (SELECT station_id, unnest(generate_series(min("timestamp"), max("timestamp"), INTERVAL 1 HOUR)) AS ts
          FROM hourly_filled GROUP BY station_id) c
    LEFT JOIN hourly_filled h ON h.station_id = c.station_id AND h."timestamp" = c.ts""",
    "nwp_raw": """
    SELECT l_suppkey AS grid_id,
        TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey % 30) * 24 + 6 + 3 * (l_orderkey % 4) AS INTEGER)) AS starttime,
        CAST(l_linenumber AS DOUBLE) AS forecasttime,
        CASE WHEN l_partkey % 2 = 1 THEN 56e0 ELSE 20e0 END AS toplevel,
        CASE WHEN l_partkey % 2 = 1 THEN 20e0 ELSE 0e0 END AS bottomlevel,
        (l_quantity - 25e0) / 3e0 AS u_wind, l_discount * 100e0 - 5e0 AS v_wind,
        273.15e0 + l_tax * 200e0 AS temperature, 95000e0 + l_extendedprice / 10e0 AS pressure,
        CASE WHEN l_tax < 0.075e0 THEN l_quantity / 10000e0 END AS qs,
        l_orderkey AS order_key, l_partkey AS part_key
    FROM lineitem""",
    "nwp": """
    SELECT grid_id, starttime, forecasttime, toplevel, bottomlevel, u_wind, v_wind, temperature, pressure, qs,
        CAST(round((toplevel + bottomlevel) / 2) AS INTEGER) AS height,
        starttime + to_hours(CAST(forecasttime AS INTEGER)) AS "timestamp",
        sqrt(u_wind * u_wind + v_wind * v_wind) AS wind_speed
    FROM nwp_raw QUALIFY row_number() OVER (
        PARTITION BY grid_id, starttime, forecasttime, toplevel
        ORDER BY order_key DESC, part_key DESC, pressure DESC, u_wind DESC, v_wind DESC, temperature DESC) = 1""",
    "ec": """
    SELECT o_custkey % 3 AS point,
        TIMESTAMP '2024-01-01' + to_hours(CAST((o_orderkey % 31) * 24 + 12 * (o_custkey % 2) AS INTEGER)) AS starttime,
        o_orderkey * 7 % 58 AS forecasttime,
        o_totalprice / 40000e0 - 3e0 AS u_wind, o_totalprice / 50000e0 - 4e0 AS v_wind,
        o_orderkey AS order_key
    FROM orders""",
    "predictions": """
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS station_id, l_shipdate AS run_time,
        CAST(l_linenumber AS INTEGER) AS horizon, l_quantity / 5e0 AS gt,
        l_quantity / 5e0 + (l_discount - 0.05e0) * 10e0 AS pred,
        l_quantity / 5e0 + (l_tax - 0.04e0) * 20e0 AS nwp_ref, 5e0 AS pers_ref
    FROM lineitem""",
    "topo": """
    SELECT p_partkey AS location_id, p_retailprice AS elevation, CAST(p_size AS DOUBLE) AS slope,
        CAST(p_partkey * 29 % 360 AS DOUBLE) AS aspect, CAST(p_size % 5 AS DOUBLE) AS elev_std,
        CASE WHEN p_size % 5 > 0 THEN p_retailprice / ((p_size % 5) * 100e0) END AS tdi,
        CASE WHEN p_size > 10 THEN p_size * 1.5e0 END AS dist_coast_km
    FROM part""",
    "weights": """
    SELECT lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS station_id,
        CASE p_partkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'past' ELSE 'future' END AS feature_type,
        p_brand AS feature_name, p_size / 50e0 AS avg_weight
    FROM part""",
    "trials": """
    SELECT 'cl_m-tft_out-48_freq-1h_' || substring(o_orderpriority, 1, 1) AS study_name, o_orderkey AS number,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state,
        o_totalprice AS value, o_orderdate AS datetime_complete
    FROM orders""",
    "client_stats": """
    SELECT c_mktsegment AS client_id, count(*) AS n, avg(o_totalprice) AS mu, var_pop(o_totalprice) AS var
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
}
