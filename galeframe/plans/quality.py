"""Completeness audits and store maintenance."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from galeframe.operators import quality as Q
from galeframe.operators.neighbours import k_nearest
from galeframe.operators.ordering import first_rows, group_ranks
from galeframe.plans.aggregates import nearest_nodes, nearest_sql
from galeframe.plans.registry import query

RUN = ["grid_id", "starttime"]
SIZES_SQL = "SELECT grid_id, starttime, count(*) AS n_rows FROM nwp GROUP BY ALL"


def day(n: int) -> datetime:
    return datetime(2024, 1, n, tzinfo=timezone.utc)


@query(
    "n01_null_report",
    " UNION ALL ".join(
        f"""SELECT station_id, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
        min("timestamp") FILTER ({c} IS NULL) AS first_null FROM hourly GROUP BY ALL""" for c in ("wind_speed", "temperature")
    ),
    ts="first_null",
)
def n01(t):
    return Q.null_report(t.hourly, ["station_id"], ["wind_speed", "temperature"], "timestamp")


@query(
    "n02_null_by_node",
    f"""WITH g AS (SELECT grid_id, count(*) AS n_rows, count(*) - count(qs) AS null_qs FROM nwp GROUP BY ALL)
    SELECT k.station_id, grid_id, g.n_rows, g.null_qs FROM ({nearest_sql(1)}) k LEFT JOIN g USING (grid_id)""",
)
def n02(t):
    nodes = t.nwp.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count("qs")).alias("null_qs")
    )
    return nearest_nodes(t, 1).select("station_id", "grid_id").join(nodes, "grid_id", "left")


@query(
    "n02_null_by_run",
    "SELECT starttime, count(*) - count(qs) AS null_qs, count(*) - count(u_wind) AS null_u_wind FROM nwp GROUP BY ALL",
    ts="starttime",
)
def n02_runs(t):
    return Q.null_counts(t.nwp, ["starttime"], ["qs", "u_wind"])


@query(
    "n04_missing_runs",
    """SELECT g.grid_id, d.d + to_hours(h.h) AS starttime FROM (SELECT DISTINCT grid_id FROM nwp) g
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d) d
    CROSS JOIN (SELECT unnest([6, 9, 12, 15]) AS h) h ANTI JOIN nwp n ON n.grid_id = g.grid_id AND n.starttime = d.d + to_hours(h.h)""",
    ts="starttime",
)
def n04(t):
    return Q.missing_runs(t.nwp, ["grid_id"], day(1), day(30), [6, 9, 12, 15])


@query("n05_incomplete_runs", f"SELECT * FROM ({SIZES_SQL}) WHERE n_rows <> 14", ts="starttime")
def n05(t):
    return Q.incomplete_runs(t.nwp, RUN, 14)


@query(
    "n06_missing_leads",
    """SELECT grid_id, starttime, CAST(len(l) AS INTEGER) AS n_missing, array_to_string(l[1:5], ',') AS first_missing FROM (
        SELECT grid_id, starttime, list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(list(CAST(forecasttime AS INTEGER)), x)) AS l
        FROM nwp GROUP BY ALL) WHERE len(l) > 0""",
    ts="starttime",
)
def n06(t):
    out = Q.missing_leads(t.nwp, RUN, range(1, 8))
    return out.withColumn("first_missing", F.array_join(F.col("first_missing").cast("array<string>"), ","))


@query(
    "n07_null_rows",
    """SELECT grid_id, starttime, count(*) FILTER (CASE WHEN forecasttime % 2 = 0 THEN qs IS NULL OR u_wind IS NULL ELSE u_wind IS NULL END) AS n_null_rows
    FROM nwp GROUP BY ALL HAVING count(*) = 12 AND n_null_rows > 0""",
    ts="starttime",
)
def n07(t):
    # leads in half hours, so that every second row lies between full hours
    rows = t.nwp.withColumn("forecasttime", F.col("forecasttime") / 2.0)
    return Q.null_rows(rows, RUN, 12, ["qs", "u_wind"], ["u_wind"])


@query(
    "n08_null_counts_per_run",
    "SELECT grid_id, starttime, count(*) - count(qs) AS null_qs, count(*) - count(pressure) AS null_pressure FROM nwp GROUP BY ALL",
    ts="starttime",
)
def n08(t):
    return Q.null_counts(t.nwp, RUN, ["qs", "pressure"])


@query(
    "n09_station_status",
    f"""WITH z AS (SELECT grid_id, starttime, count(*) AS n FROM nwp GROUP BY ALL),
    e AS (SELECT grid_id, string_agg(strftime(starttime, '%Y-%m-%d %H'), ',' ORDER BY starttime) AS examples FROM (
        SELECT * FROM z WHERE n <> 14 QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY starttime) <= 5) GROUP BY ALL),
    s AS (SELECT grid_id, count(*) AS total, count(*) FILTER (n <> 14) AS incomplete FROM z GROUP BY ALL)
    SELECT g.grid_id, CASE WHEN s.total IS NULL THEN 'ERROR' WHEN s.incomplete > 0 THEN 'INCOMPLETE' ELSE 'OK' END AS status,
        coalesce(s.total, 0) AS total, coalesce(s.incomplete, 0) AS incomplete, e.examples FROM grid g LEFT JOIN s USING (grid_id) LEFT JOIN e USING (grid_id)""",
)
def n09(t):
    return Q.station_status(t.grid, t.nwp, "grid_id", 14)


@query(
    "n10_station_mapping",
    f"""SELECT station_id, grid_id, distance, CAST(rank() OVER (PARTITION BY grid_id ORDER BY round(distance, 6)) AS INTEGER) AS rank,
        count(*) OVER (PARTITION BY grid_id) AS n_stations FROM ({nearest_sql(6, nodes='grid')})""",
    num="distance",
)
def n10(t):
    near = k_nearest(t.stations, t.grid, 6).select(
        F.col("target_id").alias("station_id"), F.col("near_id").alias("grid_id"), "distance", F.round("distance", 6).alias("d")
    )
    out = group_ranks(near, ["grid_id"], "d", F.floor("d"), total="n_stations")
    return out.withColumn("rank", F.col("rank").cast("int")).drop("d")


@query(
    "n11_grid_summary",
    f"""WITH a AS (SELECT z.starttime, n.latitude, n.longitude FROM ({SIZES_SQL}) z JOIN nodes n USING (grid_id) WHERE n_rows < 8),
    m AS (SELECT k.station_id, k.distance, n.latitude, n.longitude FROM ({nearest_sql(3)}) k JOIN nodes n USING (grid_id))
    SELECT i.lat, i.lon, n_runs, first_run, n_stations, nearest_station FROM (
        SELECT round(latitude, 4) AS lat, round(longitude, 4) AS lon, count(*) AS n_runs, min(starttime) AS first_run FROM a GROUP BY ALL) i
    LEFT JOIN (SELECT round(latitude, 4) AS lat, round(longitude, 4) AS lon, count(*) AS n_stations,
        arg_min(station_id, (round(distance, 6), station_id)) AS nearest_station FROM m GROUP BY ALL) s ON i.lat = s.lat AND i.lon = s.lon""",
    num="lat lon",
    ts="first_run",
)
def n11(t):
    audit = Q.run_sizes(t.nwp, RUN).filter("n_rows < 8").join(t.nodes, "grid_id")
    mapping = nearest_nodes(t, 3).join(t.nodes, "grid_id")
    return Q.grid_summary(audit, mapping)


KEY = ["grid_id", "starttime", "forecasttime"]
VALUES = ["u_wind", "v_wind", "qs"]


def store_and_source(t):
    """Two incomplete deliveries of the runs, the first with gaps."""
    newest = [F.desc(c) for c in ("order_key", "part_key", "pressure", "u_wind", "v_wind", "temperature")]
    rows = t.nwp_raw
    store = first_rows(rows.filter("v_wind <= 2.5"), KEY, newest).select(*KEY, *VALUES)
    return store, rows.filter("v_wind >= -2.5").select(*KEY, *VALUES)


STORE_SQL = """store AS (SELECT grid_id, starttime, forecasttime, u_wind, v_wind, qs FROM nwp_raw WHERE v_wind <= 2.5
        QUALIFY row_number() OVER (PARTITION BY grid_id, starttime, forecasttime
            ORDER BY order_key DESC, part_key DESC, pressure DESC, u_wind DESC, v_wind DESC, temperature DESC) = 1),
    source AS (SELECT grid_id, starttime, forecasttime, u_wind, v_wind, qs FROM nwp_raw WHERE v_wind >= -2.5),
    clean AS (SELECT * FROM source WHERE qs IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY grid_id, starttime, forecasttime ORDER BY u_wind, v_wind, qs) = 1),
    sizes AS (SELECT grid_id, starttime, coalesce(a.n, 0) AS n_store, coalesce(b.n, 0) AS n_source, a.h FROM
        (SELECT grid_id, starttime, count(*) AS n, bool_or(qs IS NULL) AS h FROM store GROUP BY ALL) a FULL OUTER JOIN
        (SELECT grid_id, starttime, count(*) AS n FROM clean GROUP BY ALL) b USING (grid_id, starttime)),
    log AS (SELECT *, CASE WHEN n_store = 0 THEN CASE WHEN n_source = 7 THEN 'added' ELSE 'skipped' END
        WHEN n_source = 7 AND (n_store < 7 OR h) THEN 'replaced' WHEN n_store < 7 AND n_source > n_store THEN 'merged' ELSE 'kept' END AS action FROM sizes)"""


@query(
    "n12_patched_store",
    f"""WITH {STORE_SQL}
    SELECT store.* FROM store JOIN log USING (grid_id, starttime) WHERE action <> 'replaced'
    UNION ALL SELECT clean.* FROM clean JOIN log USING (grid_id, starttime) WHERE action IN ('added', 'replaced')
    UNION ALL SELECT clean.* FROM clean JOIN log USING (grid_id, starttime) ANTI JOIN store USING (grid_id, starttime, forecasttime) WHERE action = 'merged'""",
    num="u_wind v_wind qs",
    ts="starttime",
)
def n12(t):
    return Q.patch_store(*store_and_source(t), RUN, ["forecasttime"], 7)[0]


@query("n12_patch_log", f"WITH {STORE_SQL} SELECT action, count(*) AS n FROM log GROUP BY ALL")
def n12_log(t):
    log = Q.patch_store(*store_and_source(t), RUN, ["forecasttime"], 7)[1]
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n13_appended_runs",
    f"""WITH {STORE_SQL} SELECT * FROM store UNION ALL SELECT clean.* FROM clean ANTI JOIN store USING (grid_id, starttime)""",
    num="u_wind v_wind qs",
    ts="starttime",
)
def n13(t):
    store, source = store_and_source(t)
    clean = first_rows(source.na.drop("any"), KEY, VALUES)
    return Q.append_missing_runs(store, clean, RUN)


@query(
    "n14_upsert",
    f"""WITH {STORE_SQL} SELECT grid_id, starttime, forecasttime, coalesce(a.u_wind, b.u_wind) AS u_wind, coalesce(a.v_wind, b.v_wind) AS v_wind,
        coalesce(a.qs, b.qs) AS qs FROM store a FULL OUTER JOIN clean b USING (grid_id, starttime, forecasttime)""",
    num="u_wind v_wind qs",
    ts="starttime",
)
def n14(t):
    store, source = store_and_source(t)
    clean = first_rows(source.na.drop("any"), KEY, VALUES)
    return Q.upsert(store, clean, KEY, VALUES)


@query(
    "n15_grid_point_analysis",
    f"""SELECT n.grid_id, count(*) AS n_rows, min(n.starttime) AS first_run, max(n.starttime) AS last_run, count(DISTINCT n.starttime) AS n_runs, min(d.km) AS km
    FROM nwp n JOIN (SELECT station_id AS g, distance AS km FROM ({nearest_sql(1, targets='(SELECT grid_id AS station_id, latitude, longitude FROM nodes)',
        nodes='(SELECT station_id AS grid_id, latitude, longitude FROM stations)')})) d ON d.g = n.grid_id GROUP BY ALL""",
    num="km",
    ts="first_run last_run",
)
def n15(t):
    near = k_nearest(t.nodes, t.stations, 1, "grid_id", "station_id")
    facts = t.nwp.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("starttime").alias("first_run"), F.max("starttime").alias("last_run"),
        F.count_distinct("starttime").alias("n_runs"),
    )
    return facts.join(near.select(F.col("target_id").alias("grid_id"), F.col("distance").alias("km")), "grid_id")


@query(
    "n16_study_overview",
    """SELECT study_name, regexp_extract(study_name, '_m-([^_]+)', 1) AS model, substring(study_name, 1, 2) AS setting, count(*) AS n_trials,
        count(*) FILTER (state = 'COMPLETE') AS n_completed, count(*) FILTER (state = 'PRUNED') AS n_pruned,
        min(value) FILTER (state = 'COMPLETE') AS best_value, arg_min(number, (value, number)) FILTER (state = 'COMPLETE') AS best_trial,
        max(datetime_complete) FILTER (state = 'COMPLETE') AS last_trial FROM trials GROUP BY ALL""",
    num="best_value",
    ts="last_trial",
)
def n16(t):
    done = F.col("state") == "COMPLETE"
    best = F.when(done, F.struct("value", "number"))
    return t.trials.groupBy("study_name").agg(
        F.first(F.regexp_extract("study_name", "_m-([^_]+)", 1)).alias("model"),
        F.first(F.substring("study_name", 1, 2)).alias("setting"),
        F.count(F.lit(1)).alias("n_trials"), F.count_if(done).alias("n_completed"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"), F.min(F.when(done, F.col("value"))).alias("best_value"),
        F.min_by("number", best).alias("best_trial"), F.max(F.when(done, F.col("datetime_complete"))).alias("last_trial"),
    )


@query(
    "n17_load_attrition",
    """WITH s AS (SELECT starttime, grid_id, max(CASE WHEN qs IS NULL THEN 1 ELSE 0 END) AS q, max(CASE WHEN u_wind IS NULL THEN 1 ELSE 0 END) AS u FROM nwp GROUP BY ALL),
    r AS (SELECT starttime, count(*) AS f FROM s GROUP BY ALL), g AS (SELECT grid_id, count(*) AS f FROM s GROUP BY ALL),
    c AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM s) AS ns)
    SELECT metric, item, CAST(n AS BIGINT) AS n FROM (
    SELECT 'slots' AS metric, 'all' AS item, nr * ng AS n FROM c UNION ALL SELECT 'filled', 'all', ns FROM c UNION ALL SELECT 'missing', 'all', nr * ng - ns FROM c
    UNION ALL SELECT 'complete_runs', 'all', (SELECT count(*) FROM r, c WHERE f = ng) UNION ALL SELECT 'incomplete_runs', 'all', (SELECT count(*) FROM r, c WHERE f <> ng)
    UNION ALL SELECT 'null_slots_by_feature', 'qs', sum(q) FROM s UNION ALL SELECT 'null_slots_by_feature', 'u_wind', sum(u) FROM s
    UNION ALL (SELECT 'missing_by_node', CAST(grid_id AS VARCHAR), nr - f FROM g, c ORDER BY nr - f DESC, grid_id LIMIT 15)
    UNION ALL SELECT 'incomplete_runs_by_hour', CAST(hour(starttime) AS VARCHAR), count(*) FROM r, c WHERE f <> ng GROUP BY ALL)""",
)
def n17(t):
    return Q.attrition(t.nwp, "grid_id", ["qs", "u_wind"])


@query(
    "f03_worst_missing_counts",
    """SELECT "column", station_id, n_null, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n_null DESC, station_id) AS INTEGER) AS rank FROM (
        SELECT 'wind_speed' AS "column", station_id, count(*) - count(wind_speed) AS n_null FROM hourly GROUP BY ALL
        UNION ALL SELECT 'temperature', station_id, count(*) - count(temperature) FROM hourly GROUP BY ALL) QUALIFY rank <= 5""",
)
def f03(t):
    return Q.worst_null_counts(t.hourly, "station_id", ["wind_speed", "temperature"], 5)
