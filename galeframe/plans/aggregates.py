"""Resampling, pivots and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import reshape as R
from galeframe.operators.neighbours import k_nearest
from galeframe.plans.physics import HAVERSINE_SQL
from galeframe.plans.registry import query

RUN = ["grid_id", "starttime", "forecasttime"]


def nearest_sql(k: int, metric: str = "haversine", targets: str = "stations", nodes: str = "nodes") -> str:
    distance = (
        HAVERSINE_SQL.format(a="s", b="g")
        if metric == "haversine"
        else "sqrt(pow(s.latitude - g.latitude, 2) + pow(s.longitude - g.longitude, 2))"
    )
    return f"""SELECT s.station_id, g.grid_id, {distance} AS distance,
        row_number() OVER (PARTITION BY s.station_id ORDER BY round({distance}, 9), g.grid_id) AS rank
    FROM {targets} s CROSS JOIN {nodes} g QUALIFY rank <= {k}"""


def nearest_nodes(t, k: int, metric: str = "haversine"):
    near = k_nearest(t.stations, t.nodes, k, metric=metric)
    return near.select(
        F.col("target_id").alias("station_id"), F.col("near_id").alias("grid_id"), "rank", "distance"
    )


@query(
    "d01_height_pivot",
    """SELECT grid_id, starttime, forecasttime,
        avg(sqrt(u_wind * u_wind + v_wind * v_wind)) FILTER (toplevel = 20) AS wind_speed_h10,
        avg(sqrt(u_wind * u_wind + v_wind * v_wind)) FILTER (toplevel = 56) AS wind_speed_h38,
        avg(qs) FILTER (toplevel = 20) AS qs_h10, avg(qs) FILTER (toplevel = 56) AS qs_h38
    FROM nwp_raw GROUP BY ALL""",
    num="wind_speed_h10 wind_speed_h38 qs_h10 qs_h38",
    ts="starttime",
)
def d01(t):
    from galeframe.functions.physics import level_height, wind_speed

    rows = t.nwp_raw.select(
        *RUN, level_height("toplevel", "bottomlevel").alias("height"),
        wind_speed("u_wind", "v_wind").alias("wind_speed"), "qs",
    )
    return R.pivot_mean(rows, RUN, "height", [10, 38], {"wind_speed": "wind_speed_h{}", "qs": "qs_h{}"})


@query(
    "d01_height_pivot_first",
    """SELECT grid_id, starttime, forecasttime, min(u_wind) FILTER (height = 10) AS u_h10,
        min(u_wind) FILTER (height = 38) AS u_h38 FROM nwp GROUP BY ALL""",
    num="u_h10 u_h38",
    ts="starttime",
)
def d01_first(t):
    return R.pivot_mean(t.nwp, RUN, "height", [10, 38], {"u_wind": "u_h{}"}, how="first")


STATION_IDS = [f"{i:05d}" for i in range(10)]


@query(
    "d02_station_matrix",
    'SELECT "timestamp", '
    + ", ".join(f"avg(wind_speed) FILTER (station_id = '{s}') AS ws_{s}" for s in STATION_IDS)
    + " FROM hourly GROUP BY ALL",
    num=" ".join(f"ws_{s}" for s in STATION_IDS),
    ts="timestamp",
)
def d02(t):
    return R.pivot_mean(t.hourly, ["timestamp"], "station_id", STATION_IDS, {"wind_speed": "ws_{}"})


@query(
    "d03_melt",
    """SELECT station_id, run_time, horizon, source, value FROM (SELECT station_id, run_time, horizon, pred, nwp_ref, pers_ref FROM predictions)
    UNPIVOT (value FOR source IN (pred, nwp_ref, pers_ref))""",
    num="value",
    ts="run_time",
)
def d03(t):
    return R.melt(
        t.predictions, ["station_id", "run_time", "horizon"], ["pred", "nwp_ref", "pers_ref"], "source", "value"
    )


@query(
    "d04_resample_midnight",
    'SELECT station_id, "timestamp", wind_speed, temperature FROM hourly',
    num="wind_speed temperature",
    ts="timestamp",
)
def d04_midnight(t):
    return t.hourly


@query(
    "d04_resample_from_start",
    """WITH anchored AS (SELECT *, min(epoch_us("timestamp")) OVER (PARTITION BY station_id) AS a FROM raw),
    means AS (SELECT station_id, a, (epoch_us("timestamp") - a) // 3600000000 AS bin, avg(wind_speed) AS wind_speed
        FROM anchored GROUP BY ALL),
    bins AS (SELECT station_id, a, unnest(range(min(bin), max(bin) + 1)) AS bin FROM means GROUP BY station_id, a)
    SELECT b.station_id, make_timestamp(CAST(b.a + b.bin * 3600000000 AS BIGINT)) AS "timestamp", m.wind_speed
    FROM bins b LEFT JOIN means m ON m.station_id = b.station_id AND m.bin = b.bin""",
    num="wind_speed",
    ts="timestamp",
)
def d04_start(t):
    return R.resample_mean(t.raw, ["station_id"], "timestamp", 3600, ["wind_speed"], origin="start")


@query(
    "d05_lead_bins",
    """SELECT grid_id, starttime, CAST(floor(forecasttime / 2) AS BIGINT) AS lead_bin, avg(u_wind) AS u_wind, avg(qs) AS qs
    FROM nwp WHERE floor(forecasttime / 2) BETWEEN 1 AND 3 GROUP BY ALL""",
    num="u_wind qs",
    ts="starttime",
)
def d05(t):
    return R.lead_bins(t.nwp, ["grid_id", "starttime"], "forecasttime", 2.0, ["u_wind", "qs"], 3)


@query(
    "d06_circular_mean",
    """SELECT station_id, date_trunc('hour', "timestamp") AS "hour",
        (degrees(atan2(avg(sin(radians(wind_direction))), avg(cos(radians(wind_direction))))) + 360) % 360 AS direction
    FROM raw GROUP BY ALL""",
    num="direction",
    ts="hour",
)
def d06(t):
    return t.raw.groupBy("station_id", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        R.circular_mean("wind_direction").alias("direction")
    )


@query(
    "d07_idw_of_nodes",
    f"""SELECT station_id, starttime, forecasttime, height,
        CASE WHEN count(wind_speed) < 4 THEN NULL
            WHEN min(distance) = 0 THEN avg(wind_speed) FILTER (distance = 0)
            ELSE sum(wind_speed / nullif(distance, 0)) / sum(1 / nullif(distance, 0)) END AS wind_speed
    FROM ({nearest_sql(4)}) n JOIN nwp USING (grid_id) GROUP BY ALL""",
    num="wind_speed",
    ts="starttime",
)
def d07(t):
    facts = t.nwp.select(*RUN, "height", "wind_speed")
    rows = nearest_nodes(t, 4).join(facts, "grid_id")
    return R.inverse_distance_mean(rows, ["station_id", *RUN[1:], "height"], "distance", ["wind_speed"], 4)


@query(
    "d08_idw_with_floor",
    f"""SELECT station_id, starttime, forecasttime, height,
        CASE WHEN count(qs) = 2 THEN sum(qs / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)) END AS qs
    FROM ({nearest_sql(2, 'degrees')}) n JOIN nwp USING (grid_id) GROUP BY ALL""",
    num="qs",
    ts="starttime",
)
def d08(t):
    facts = t.nwp.select(*RUN, "height", "qs")
    rows = nearest_nodes(t, 2, "degrees").join(facts, "grid_id")
    return R.inverse_distance_mean(rows, ["station_id", *RUN[1:], "height"], "distance", ["qs"], 2, floor=1e-6)


@query(
    "d08_points_as_columns",
    f"""SELECT station_id, starttime, forecasttime, height, avg(u_wind) FILTER (rank = 1) AS u_wind_1,
        avg(u_wind) FILTER (rank = 2) AS u_wind_2, avg(u_wind) FILTER (rank = 3) AS u_wind_3
    FROM ({nearest_sql(3, 'degrees')}) n JOIN nwp USING (grid_id) GROUP BY ALL""",
    num="u_wind_1 u_wind_2 u_wind_3",
    ts="starttime",
)
def d08_concat(t):
    rows = nearest_nodes(t, 3, "degrees").join(t.nwp.select(*RUN, "height", "u_wind"), "grid_id")
    return R.pivot_mean(rows, ["station_id", *RUN[1:], "height"], "rank", [1, 2, 3], {"u_wind": "u_wind_{}"})


TURBINES_SQL = """SELECT p_partkey // 20 AS grid_id, 40e0 + p_size AS hub, (40e0 + (p_size % 7) * 10) / 2 AS r FROM part"""
CAP_SQL = """CASE WHEN {y} <= -r THEN pi() * r * r WHEN {y} >= r THEN 0e0
    ELSE r * r * acos({y} / r) - {y} * sqrt(r * r - {y} * {y}) END"""
SLICES_SQL = f"""SELECT grid_id, h.height, sum(CASE WHEN greatest(h.lo - hub, -r) < r AND least(h.hi - hub, r) > -r
        THEN ({CAP_SQL.format(y='greatest(h.lo - hub, -r)')}) - ({CAP_SQL.format(y='least(h.hi - hub, r)')}) ELSE 0 END)
        / sum(pi() * r * r) AS weight
    FROM ({TURBINES_SQL}) CROSS JOIN (VALUES (10, 0e0, 24e0), (38, 24e0, 1e9)) h(height, lo, hi) GROUP BY ALL"""


def turbines(t):
    size = F.col("p_size")
    return t.table("part").select(
        F.floor(F.col("p_partkey") / 20).alias("grid_id"),
        (40.0 + size).alias("hub_height"),
        (40.0 + (size % 7) * 10).alias("diameter"),
    )


@query("d09_rotor_weights", SLICES_SQL, num="weight")
def d09_weights(t):
    return R.rotor_weights(turbines(t), [10, 38], ["grid_id"])


@query(
    "d09_rotor_equivalent",
    f"""SELECT grid_id, starttime, forecasttime,
        pow(CASE WHEN count(wind_speed) = count(*) THEN sum(weight * pow(wind_speed, 3)) END, 1e0 / 3) AS wind_speed_rotor_eq,
        CASE WHEN count(qs) = count(*) THEN sum(weight * qs) END AS density_rotor_eq
    FROM nwp JOIN ({SLICES_SQL}) w USING (grid_id, height) WHERE weight > 0 GROUP BY ALL""",
    num="wind_speed_rotor_eq density_rotor_eq",
    ts="starttime",
)
def d09(t):
    weights = R.rotor_weights(turbines(t), [10, 38], ["grid_id"])
    return R.rotor_equivalent(t.nwp, weights, ["grid_id", "height"], RUN, "wind_speed", "qs")


@query(
    "d10_mean_upper_heights",
    """SELECT grid_id, starttime, forecasttime, avg(wind_speed) AS wind_speed_mean_height
    FROM nwp WHERE height > 10 GROUP BY ALL""",
    num="wind_speed_mean_height",
    ts="starttime",
)
def d10(t):
    return t.nwp.filter("height > 10").groupBy(*RUN).agg(F.avg("wind_speed").alias("wind_speed_mean_height"))


CHANNELS = ["click", "error", "purchase", "signup", "view"]


def turbine_power(t):
    """Power per station and hour, one column per channel, and the row-wise sum."""
    rows = t.raw.withColumn("hour", F.date_trunc("hour", "timestamp"))
    wide = R.pivot_mean(rows, ["station_id", "hour"], "channel", CHANNELS, {"reading": "power_{}"})
    parts = [F.coalesce(F.col(f"power_{c}"), F.lit(0.0)) for c in CHANNELS]
    return wide.withColumn("power", sum(parts[1:], parts[0]))


POWER_SQL = """SELECT station_id, hour, sum(p) AS power FROM (
    SELECT station_id, date_trunc('hour', "timestamp") AS hour, channel, avg(reading) AS p FROM raw
    WHERE channel IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY ALL) GROUP BY ALL"""


@query(
    "d11_capacity",
    f"""SELECT station_id, max(power) AS capacity, max(power) FILTER (rn <= 500) AS capacity_first
    FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY hour) AS rn FROM ({POWER_SQL})) GROUP BY ALL""",
    num="capacity capacity_first",
)
def d11(t):
    power = turbine_power(t)
    first = R.capacity(power, ["station_id"], "hour", "power", first=500)
    whole = R.capacity(power, ["station_id"], "hour", "power")
    return whole.join(first.withColumnRenamed("capacity", "capacity_first"), "station_id")


@query(
    "d12_mean_per_valid_time",
    """SELECT grid_id, "timestamp", avg(wind_speed) AS wind_speed, avg(qs) AS qs FROM nwp GROUP BY ALL""",
    num="wind_speed qs",
    ts="timestamp",
)
def d12(t):
    return t.nwp.groupBy("grid_id", "timestamp").agg(
        F.avg("wind_speed").alias("wind_speed"), F.avg("qs").alias("qs")
    )


LENGTHS_SQL = """SELECT grid_id, starttime, count(*) AS n_rows, count(DISTINCT forecasttime) AS n_leads
    FROM nwp GROUP BY ALL"""


@query("d13_rows_per_run", LENGTHS_SQL, ts="starttime")
def d13(t):
    return t.nwp.groupBy("grid_id", "starttime").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("forecasttime").alias("n_leads")
    )


@query(
    "d14_modal_run_length",
    f"""SELECT grid_id, arg_max(n_rows, (c, -n_rows)) AS expected
    FROM (SELECT grid_id, n_rows, count(*) AS c FROM ({LENGTHS_SQL}) GROUP BY ALL) GROUP BY ALL""",
)
def d14(t):
    return R.smallest_mode(d13(t), ["grid_id"], "n_rows", "expected")


DESCRIBE_SQL = """SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
    max({c}) AS "max", quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM raw"""


@query(
    "d15_describe",
    " UNION ALL ".join(DESCRIBE_SQL.format(c=c) for c in ("wind_speed", "temperature")),
    num="mean std min max q25 q50 q75",
)
def d15(t):
    return R.describe(t.raw, ["wind_speed", "temperature"])


@query(
    "d16_bins",
    """SELECT event_id, CAST((wind_speed > q.a) AS INTEGER) + CAST((wind_speed > q.b) AS INTEGER) + CAST((wind_speed > q.c) AS INTEGER) AS quartile,
        CASE WHEN wind_speed >= 6 THEN 3 WHEN wind_speed >= 4 THEN 2 WHEN wind_speed >= 2 THEN 1 WHEN wind_speed >= 0 THEN 0 END AS speed_class
    FROM raw CROSS JOIN (SELECT quantile_cont(wind_speed, 0.25) AS a, quantile_cont(wind_speed, 0.5) AS b,
        quantile_cont(wind_speed, 0.75) AS c FROM raw) q""",
)
def d16(t):
    rows = R.quantile_bins(t.raw, "wind_speed", 4, "quartile")
    return rows.select("event_id", "quartile", R.fixed_bins("wind_speed", [0, 2, 4, 6]).alias("speed_class"))


@query(
    "d17_weighted_client_metrics",
    """SELECT station_id, sum(a * n) / sum(n) AS rmse, sum(b * n) / nullif(sum(n) FILTER (b IS NOT NULL), 0) AS mae
    FROM (SELECT station_id, date_trunc('hour', "timestamp") AS h, count(*) AS n, avg(wind_speed) AS a, avg(temperature) AS b
        FROM raw GROUP BY ALL) GROUP BY ALL""",
    num="rmse mae",
)
def d17(t):
    clients = t.raw.groupBy("station_id", F.date_trunc("hour", "timestamp").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("wind_speed").alias("a"), F.avg("temperature").alias("b")
    )
    return clients.groupBy("station_id").agg(
        R.weighted_mean("a", "n").alias("rmse"), R.weighted_mean("b", "n").alias("mae")
    )


@query(
    "d18_merged_moments",
    """SELECT sum(n * mu) / sum(n) AS mean, sqrt(greatest(sum(n * (var + mu * mu)) / sum(n)
        - pow(sum(n * mu) / sum(n), 2), 0)) AS std FROM client_stats""",
    num="mean std",
)
def d18(t):
    return t.client_stats.agg(*[c.alias(k) for k, c in R.merge_moments("n", "mu", "var").items()])


PARAMS_SQL = """SELECT label AS client, 'layer_' || CAST(i % 2 AS VARCHAR) AS "key", i AS idx, CAST(embedding[i + 1] AS DOUBLE) AS value
    FROM (SELECT label, embedding, unnest(range(len(embedding))) AS i FROM embeddings)"""


@query(
    "d19_federated_average",
    f"""SELECT "key", CAST(idx AS INTEGER) AS idx, sum(v * n) / sum(n) AS weighted, avg(v) AS uniform
    FROM (SELECT client, "key", idx, avg(value) AS v, count(*) AS n FROM ({PARAMS_SQL}) GROUP BY ALL) GROUP BY ALL""",
    num="weighted uniform",
)
def d19(t):
    values = t.table("embeddings").select("label", F.posexplode("embedding").alias("idx", "value"))
    clients = values.groupBy(
        F.col("label").alias("client"), F.concat(F.lit("layer_"), (F.col("idx") % 2).cast("string")).alias("key"), "idx"
    ).agg(F.avg(F.col("value").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    keys = ["key", "idx"]
    weighted = R.federated_average(clients, keys, "value", "n").withColumnRenamed("value", "weighted")
    uniform = R.federated_average(clients, keys, "value").withColumnRenamed("value", "uniform")
    return weighted.join(uniform, keys)


@query("d20_correlation", "SELECT horizon, corr(gt, pred) AS r FROM predictions GROUP BY ALL", num="r")
def d20(t):
    return t.predictions.groupBy("horizon").agg(F.corr("gt", "pred").alias("r"))


@query(
    "d21_group_summary",
    """SELECT station_id, horizon, avg(pred) AS mean, stddev_pop(pred) AS std, count(*) AS n
    FROM predictions GROUP BY ALL""",
    num="mean std",
)
def d21(t):
    return t.predictions.groupBy("station_id", "horizon").agg(
        F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("std"), F.count(F.lit(1)).alias("n")
    )


MAE_SQL = "SELECT station_id, avg(abs(pred - gt)) AS mae FROM predictions GROUP BY ALL"


@query(
    "d22_summary_rows",
    f"""WITH m AS ({MAE_SQL}) SELECT * FROM m UNION ALL SELECT 'mean', avg(mae) FROM m
    UNION ALL SELECT 'std', stddev_samp(mae) FROM m""",
    num="mae",
)
def d22(t):
    mae = t.predictions.groupBy("station_id").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    return R.with_summary_rows(mae, "station_id", ["mae"])


@query("d23_value_counts", "SELECT state, count(*) AS n FROM trials GROUP BY ALL")
def d23(t):
    return t.trials.groupBy("state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "state")


@query(
    "d24_drop_sparse_days",
    """SELECT station_id, "timestamp", wind_speed FROM hourly
    QUALIFY sum(CASE WHEN wind_speed IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, date_trunc('day', "timestamp")) <= 5""",
    num="wind_speed",
    ts="timestamp",
)
def d24(t):
    rows = R.drop_sparse_days(t.hourly, ["station_id"], "timestamp", "wind_speed", 5)
    return rows.select("station_id", "timestamp", "wind_speed")
