"""Joins of stations, grid nodes, runs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import forecasts as FC
from galeframe.operators import kriging as K
from galeframe.operators import neighbours as N
from galeframe.operators import ordering as O
from galeframe.operators import sequences as S
from galeframe.plans.aggregates import RUN, nearest_nodes, nearest_sql, turbine_power, POWER_SQL
from galeframe.plans.physics import HAVERSINE_SQL
from galeframe.plans.registry import query
from galeframe.plans.series import FILLED_SQL, station_runs


def station_forecast(t):
    """Rows of each station's nearest node, all levels."""
    facts = t.nwp.select(*RUN, "height", "timestamp", F.col("wind_speed").alias("nwp_speed"))
    return nearest_nodes(t, 1).select("station_id", "grid_id").join(facts, "grid_id")


STATION_FORECAST_SQL = f"""SELECT k.station_id, grid_id, n.starttime, n.forecasttime, n.height, n."timestamp", n.wind_speed AS nwp_speed
    FROM ({nearest_sql(1)}) k JOIN nwp n USING (grid_id)"""


@query(
    "c01_forecast_with_measurement",
    f"""SELECT f.station_id, f.starttime, f.forecasttime, f.height, f.nwp_speed, h.wind_speed FROM ({STATION_FORECAST_SQL}) f
    LEFT JOIN hourly h ON h.station_id = f.station_id AND h."timestamp" = f."timestamp" """,
    num="nwp_speed wind_speed",
    ts="starttime",
)
def c01(t):
    joined = station_forecast(t).join(t.hourly, ["station_id", "timestamp"], "left")
    return joined.select("station_id", "starttime", "forecasttime", "height", "nwp_speed", "wind_speed")


@query(
    "c02_forecast_with_power",
    f"""SELECT f.station_id, f.starttime, f.forecasttime, f.height, f.nwp_speed, p.power FROM ({STATION_FORECAST_SQL}) f
    JOIN ({POWER_SQL}) p ON p.station_id = f.station_id AND p.hour = f."timestamp" """,
    num="nwp_speed power",
    ts="starttime",
)
def c02(t):
    power = turbine_power(t).select("station_id", F.col("hour").alias("timestamp"), "power")
    joined = station_forecast(t).join(power, ["station_id", "timestamp"])
    return joined.select("station_id", "starttime", "forecasttime", "height", "nwp_speed", "power")


@query(
    "c03_full_outer_merge",
    """SELECT grid_id, starttime, forecasttime, a.wind_speed AS wind_speed_h10, b.wind_speed AS wind_speed_h38
    FROM (SELECT * FROM nwp WHERE height = 10) a FULL OUTER JOIN (SELECT * FROM nwp WHERE height = 38) b
        USING (grid_id, starttime, forecasttime)""",
    num="wind_speed_h10 wind_speed_h38",
    ts="starttime",
)
def c03(t):
    def level(h):
        return t.nwp.filter(F.col("height") == h).select(*RUN, F.col("wind_speed").alias(f"wind_speed_h{h}"))

    return level(10).join(level(38), RUN, "full_outer")


@query(
    "c04_second_model_as_of",
    """WITH e AS (SELECT point, starttime, forecasttime, arg_min(sqrt(u_wind * u_wind + v_wind * v_wind), order_key) AS v FROM ec GROUP BY ALL),
    k AS (SELECT grid_id, starttime, forecasttime, height, date_trunc('day', starttime) + to_hours(CASE WHEN hour(starttime) >= 12 THEN 12 ELSE 0 END) AS s
        FROM nwp),
    l AS (SELECT *, CAST(date_diff('hour', s, starttime) + forecasttime AS BIGINT) AS lead FROM k)
    SELECT l.grid_id, l.starttime, l.forecasttime, l.height, e0.v AS ecmwf_wind_speed_h10_0, e1.v AS ecmwf_wind_speed_h10_1, e2.v AS ecmwf_wind_speed_h10_2
    FROM l LEFT JOIN e e0 ON e0.point = 0 AND e0.starttime = l.s AND e0.forecasttime = l.lead
        LEFT JOIN e e1 ON e1.point = 1 AND e1.starttime = l.s AND e1.forecasttime = l.lead
        LEFT JOIN e e2 ON e2.point = 2 AND e2.starttime = l.s AND e2.forecasttime = l.lead""",
    num="ecmwf_wind_speed_h10_0 ecmwf_wind_speed_h10_1 ecmwf_wind_speed_h10_2",
    ts="starttime",
)
def c04(t):
    runs = t.nwp.select(*RUN, "height")
    return FC.join_second_model(runs, t.ec.withColumnRenamed("point", "rank"), [0, 1, 2])


RUNS_SQL = """SELECT lpad(CAST(grid_id AS VARCHAR), 5, '0') AS station_id, starttime, avg(u_wind) AS u_wind FROM nwp GROUP BY ALL"""


@query(
    "c05_as_of_backward",
    f"""SELECT r.event_id, n.starttime, n.u_wind FROM raw r ASOF LEFT JOIN ({RUNS_SQL}) n
        ON r.station_id = n.station_id AND r."timestamp" >= n.starttime""",
    num="u_wind",
    ts="starttime",
)
def c05(t):
    runs = t.nwp.groupBy(F.lpad(F.col("grid_id").cast("string"), 5, "0").alias("station_id"), "starttime").agg(
        F.avg("u_wind").alias("u_wind")
    )
    left = t.raw.select("event_id", "station_id", "timestamp")
    out = O.latest_before(left, runs, ["station_id"], "timestamp", "starttime", ["u_wind"], lambda c: F.date_trunc("hour", c))
    return out.select("event_id", "starttime", "u_wind")


@query(
    "c06_nearest_in_time",
    """WITH r AS (SELECT DISTINCT starttime, starttime - INTERVAL 4 HOUR AS goal FROM nwp), e AS (SELECT DISTINCT starttime AS other FROM ec),
    b AS (SELECT r.starttime, e.other FROM r JOIN e ON abs(date_diff('second', goal, other)) <= 10800
        QUALIFY row_number() OVER (PARTITION BY r.starttime ORDER BY abs(date_diff('second', goal, other)), other) = 1)
    SELECT r.starttime, b.other FROM r LEFT JOIN b ON r.starttime = b.starttime""",
    ts="starttime other",
)
def c06(t):
    goal = F.timestamp_seconds(F.unix_timestamp("starttime") - 4 * 3600)
    runs = t.nwp.select("starttime").distinct().withColumn("goal", goal)
    other = t.ec.select(F.col("starttime").alias("other")).distinct()
    return S.nearest_in_time(runs, other, [], "goal", "other", 3 * 3600).select("starttime", "other")


@query(
    "c07_latest_forecast",
    """WITH l AS (SELECT grid_id, height, "timestamp", wind_speed FROM nwp
        QUALIFY row_number() OVER (PARTITION BY grid_id, height, "timestamp" ORDER BY forecasttime, starttime DESC) = 1),
    v AS (SELECT DISTINCT height FROM nwp),
    j AS (SELECT h.station_id, v.height, h."timestamp", l.wind_speed FROM hourly h CROSS JOIN v LEFT JOIN l
        ON h.station_id = lpad(CAST(l.grid_id AS VARCHAR), 5, '0') AND h."timestamp" = l."timestamp" AND l.height = v.height)
    SELECT station_id, height, "timestamp", coalesce(last_value(wind_speed IGNORE NULLS) OVER f, first_value(wind_speed IGNORE NULLS) OVER b) AS forecast
    FROM j WINDOW f AS (PARTITION BY station_id, height ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY station_id, height ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    num="forecast",
    ts="timestamp",
)
def c07(t):
    runs = t.nwp.select(
        F.lpad(F.col("grid_id").cast("string"), 5, "0").alias("station_id"), "height", "timestamp", "starttime", "forecasttime",
        F.col("wind_speed").alias("forecast"),
    )
    key = ["station_id", "height"]
    newest = FC.latest_forecast(runs, key).select(*key, "timestamp", "forecast")
    slots = t.hourly.select("station_id", F.explode(F.array(F.lit(10), F.lit(38))).alias("height"), "timestamp")
    joined = slots.join(newest, [*key, "timestamp"], "left")
    return O.fill(joined, key, ["timestamp"], ["forecast"], O.day_chunk("timestamp"))


@query(
    "c07_latest_of_interpolated_runs",
    """WITH o AS (SELECT grid_id, toplevel, "timestamp", forecasttime, starttime, qs,
            row_number() OVER (PARTITION BY grid_id, toplevel ORDER BY "timestamp", forecasttime, starttime) AS p FROM nwp),
    k AS (SELECT *, CASE WHEN qs IS NOT NULL THEN {'p': p, 'v': qs} END AS k FROM o),
    n AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY grid_id, toplevel ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
        first_value(k IGNORE NULLS) OVER (PARTITION BY grid_id, toplevel ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
    SELECT grid_id, toplevel, "timestamp", forecasttime, coalesce(qs, a.v + (b.v - a.v) * (p - a.p) / (b.p - a.p), a.v, b.v) AS qs FROM n
    QUALIFY row_number() OVER (PARTITION BY grid_id, toplevel, "timestamp" ORDER BY forecasttime, starttime DESC) = 1""",
    num="toplevel forecasttime qs",
    ts="timestamp",
)
def c07_interpolated(t):
    out = FC.filled_latest_forecast(t.nwp, ["grid_id", "toplevel"], ["qs"])
    return out.select("grid_id", "toplevel", "timestamp", "forecasttime", "qs")


@query(
    "c08_nearest_grid_points",
    f"SELECT station_id, grid_id, CAST(rank AS INTEGER) AS rank, distance FROM ({nearest_sql(5, nodes='grid')})",
    num="distance",
)
def c08(t):
    near = N.k_nearest(t.stations, t.grid, 5)
    return near.withColumnsRenamed({"target_id": "station_id", "near_id": "grid_id"})


@query(
    "c09_nearest_in_degrees_with_facts",
    f"""SELECT k.station_id, grid_id, CAST(k.rank AS INTEGER) AS rank, n.starttime, n.forecasttime, n.height, n.u_wind
    FROM ({nearest_sql(2, 'degrees')}) k JOIN nwp n USING (grid_id)""",
    num="u_wind",
    ts="starttime",
)
def c09(t):
    facts = t.nwp.select(*RUN, "height", "u_wind")
    return nearest_nodes(t, 2, "degrees").drop("distance").join(facts, "grid_id")


@query("c10_enclosing_quad", num="rel_lat rel_lon")
def c10(t):
    return N.enclosing_labels(t.stations, t.grid, 4)


@query("c10_twelve_labels", num="rel_lat rel_lon")
def c10_twelve(t):
    return N.enclosing_labels(t.stations, t.nodes, 12)


@query(
    "c10_relative_position",
    """WITH a AS (SELECT list_sort(list(DISTINCT latitude)) AS lats, list_sort(list(DISTINCT longitude)) AS lons FROM grid),
    i AS (SELECT s.*, lats, lons, least(greatest(len(list_filter(lats, lambda x: x < s.latitude)), 1), len(lats) - 1) AS a,
        least(greatest(len(list_filter(lons, lambda x: x < s.longitude)), 1), len(lons) - 1) AS b FROM stations s CROSS JOIN a)
    SELECT station_id, (latitude - lats[a]) / (lats[a + 1] - lats[a]) AS rel_lat,
        (longitude - lons[b]) / (lons[b + 1] - lons[b]) AS rel_lon FROM i""",
    num="rel_lat rel_lon",
)
def c10_position(t):
    out = N.enclosing_labels(t.stations, t.grid, 4).filter("label = 'NW'")
    return out.select(F.col("target_id").alias("station_id"), "rel_lat", "rel_lon")


@query(
    "c11_quadrant_labels",
    f"""SELECT station_id, grid_id, label || CASE WHEN seen > 1 THEN CAST(seen AS VARCHAR) ELSE '' END AS label FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, label ORDER BY rank) AS seen FROM (
        SELECT k.station_id, k.grid_id, k.rank, CASE WHEN abs(g.latitude - s.latitude) < 0.01 AND abs(g.longitude - s.longitude) < 0.01 THEN 'C'
            WHEN g.latitude >= s.latitude AND g.longitude >= s.longitude THEN 'NE' WHEN g.latitude >= s.latitude THEN 'NW'
            WHEN g.longitude >= s.longitude THEN 'SE' ELSE 'SW' END AS label
        FROM ({nearest_sql(6, 'degrees', nodes='grid')}) k JOIN stations s USING (station_id) JOIN grid g USING (grid_id)))""",
)
def c11(t):
    near = N.k_nearest(t.stations, t.grid, 6, metric="degrees")
    out = N.quadrant_labels(near, t.stations, t.grid, "station_id", "grid_id")
    return out.select(F.col("target_id").alias("station_id"), F.col("near_id").alias("grid_id"), "label")


def measured(t):
    return t.stations.join(t.hourly.select("station_id").distinct(), "station_id", "left_semi")


MEASURED_SQL = "SELECT * FROM stations WHERE station_id IN (SELECT station_id FROM hourly)"
STATION_NEAR_SQL = f"""SELECT a.station_id, b.station_id AS near_id, {HAVERSINE_SQL.format(a='a', b='b')} AS distance,
    row_number() OVER (PARTITION BY a.station_id ORDER BY round({HAVERSINE_SQL.format(a='a', b='b')}, 9), b.station_id) AS rank
    FROM ({MEASURED_SQL}) a JOIN ({MEASURED_SQL}) b ON a.station_id <> b.station_id"""


@query(
    "c12_neighbour_series",
    f"""SELECT k.station_id, h."timestamp", max(wind_speed) FILTER (rank = 1) AS wind_speed_next_1,
        max(wind_speed) FILTER (rank = 2) AS wind_speed_next_2
    FROM (SELECT * FROM ({STATION_NEAR_SQL}) WHERE rank <= 2) k JOIN hourly h ON h.station_id = k.near_id GROUP BY ALL""",
    num="wind_speed_next_1 wind_speed_next_2",
    ts="timestamp",
)
def c12(t):
    pool = measured(t)
    near = N.k_nearest(pool, pool, 2, candidate_key="station_id", exclude_self=True)
    return N.neighbour_series(t.hourly, near, ["wind_speed"], 2)


@query(
    "c13_nearest_to_group",
    f"""SELECT c.station_id AS near_id, min({HAVERSINE_SQL.format(a='a', b='c')}) AS distance
    FROM stations a JOIN stations c ON a.station_height > 2000 AND c.station_height <= 2000
    GROUP BY ALL HAVING min({HAVERSINE_SQL.format(a='a', b='c')}) <= 120 ORDER BY round(distance, 9), near_id LIMIT 15""",
    num="distance",
)
def c13(t):
    high = F.col("station_height") > 2000
    return N.nearest_to_group(t.stations.filter(high), t.stations.filter(~high), 120.0, 15)


@query(
    "c14_coordinate_match",
    """SELECT s.station_id, b.grid_id FROM stations s LEFT JOIN (
        SELECT s.station_id, g.grid_id FROM stations s JOIN grid g
            ON sqrt(pow(s.latitude - g.latitude, 2) + pow(s.longitude - g.longitude, 2)) <= 0.08
        QUALIFY row_number() OVER (PARTITION BY s.station_id ORDER BY
            round(sqrt(pow(s.latitude - g.latitude, 2) + pow(s.longitude - g.longitude, 2)), 9), g.grid_id) = 1) b USING (station_id)""",
)
def c14(t):
    hits = N.match_coordinates(t.stations, t.grid, 0.08, "station_id", "grid_id")
    return hits.select(F.col("target_id").alias("station_id"), F.col("near_id").alias("grid_id"))


@query(
    "c15_missing_keys",
    """SELECT DISTINCT grid_id, starttime, forecasttime FROM nwp_raw ANTI JOIN (
        SELECT grid_id, starttime, forecasttime FROM nwp GROUP BY ALL HAVING count(*) = 2) USING (grid_id, starttime, forecasttime)""",
    ts="starttime",
)
def c15(t):
    stored = t.nwp.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return t.nwp_raw.select(*RUN).distinct().join(stored, RUN, "left_anti")


PAIR_SV_SQL = f"""WITH p AS (SELECT a.station_id AS i, b.station_id AS j, {HAVERSINE_SQL.format(a='a', b='b')} AS distance
        FROM stations a JOIN stations b ON a.station_id < b.station_id),
    v AS (SELECT p.i, p.j, p.distance, 0.5 * avg(pow(x.wind_speed - y.wind_speed, 2)) AS semivariance
        FROM p JOIN hourly x ON x.station_id = p.i JOIN hourly y ON y.station_id = p.j AND y."timestamp" = x."timestamp"
        WHERE p.distance <= 500 GROUP BY ALL HAVING count(x.wind_speed + y.wind_speed) > 0)"""


@query(
    "c16_station_pairs",
    f"{PAIR_SV_SQL} SELECT i, j, distance, semivariance FROM v",
    num="distance semivariance",
)
def c16(t):
    pairs = K.station_pairs(t.stations, 500.0)
    return K.pair_semivariance(t.hourly, pairs, "wind_speed", stations=t.stations).select("i", "j", "distance", "semivariance")


@query(
    "c17_model_chain",
    """WITH m AS (SELECT station_id, run_time, avg(pred) AS a, avg(nwp_ref) AS b FROM predictions GROUP BY ALL),
    h AS (SELECT station_id, date_trunc('day', "timestamp") AS run_time, avg(wind_speed) AS c FROM hourly GROUP BY ALL)
    SELECT m.station_id, m.run_time, m.a AS model_a, m.b AS model_b, h.c AS model_c
    FROM m LEFT JOIN h ON m.station_id = h.station_id AND date_trunc('day', m.run_time) = h.run_time""",
    num="model_a model_b model_c",
    ts="run_time",
)
def c17(t):
    keys = ["station_id", "run_time"]

    def model(col, name):
        return t.predictions.groupBy(*keys).agg(F.avg(col).alias(name))

    day = F.date_trunc("day", "timestamp").cast(t.predictions.schema["run_time"].dataType)
    measured_days = t.hourly.groupBy("station_id", day.alias("run_time")).agg(F.avg("wind_speed").alias("model_c"))
    return model("pred", "model_a").join(model("nwp_ref", "model_b"), keys, "left").join(measured_days, keys, "left")


@query(
    "c18_merged_metrics",
    """SELECT a.station_id, a.mae AS mae_model, b.mae AS mae_nwp FROM
    (SELECT station_id, avg(abs(pred - gt)) AS mae FROM predictions GROUP BY ALL) a JOIN
    (SELECT station_id, avg(abs(nwp_ref - gt)) AS mae FROM predictions GROUP BY ALL) b USING (station_id)""",
    num="mae_model mae_nwp",
)
def c18(t):
    from galeframe.operators.metrics import mae

    rows = t.predictions.groupBy("station_id")
    left = rows.agg(mae("gt", "pred").alias("mae_model"))
    return left.join(rows.agg(mae("gt", "nwp_ref").alias("mae_nwp")), "station_id")
