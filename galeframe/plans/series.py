"""Lags, windows, fills and other order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import ordering as O
from galeframe.operators import sequences as S
from galeframe.operators.neighbours import within
from galeframe.plans.aggregates import nearest_nodes, nearest_sql
from galeframe.plans.physics import HAVERSINE_SQL
from galeframe.plans.registry import query

STATION = ["station_id"]


def numbered(t, series=None):
    """Hourly rows with their running number; the hourly series has no missing rows."""
    rows = t.hourly if series is None else series
    first = rows.groupBy("station_id").agg(F.min(O.slot("timestamp")).alias("_first"))
    return rows.join(first, "station_id").withColumn("pos", O.slot("timestamp") - F.col("_first") + 1).drop("_first")


LAG_SQL = 'lag(wind_speed, {n}) OVER (PARTITION BY station_id ORDER BY "timestamp") AS wind_speed_lag_{n}'


@query(
    "e01_lag_features",
    f"""SELECT station_id, "timestamp", {', '.join(LAG_SQL.format(n=n) for n in (2, 4, 6))} FROM hourly""",
    num="wind_speed_lag_2 wind_speed_lag_4 wind_speed_lag_6",
    ts="timestamp",
)
def e01(t):
    out = S.lag_features(numbered(t), STATION, "pos", "wind_speed", S.lag_steps(2, 6))
    return out.drop("pos", "wind_speed", "temperature")


@query(
    "e01_lag_features_of_runs",
    """WITH m AS (SELECT grid_id, height, "timestamp", avg(wind_speed) AS w FROM nwp GROUP BY ALL),
    l AS (SELECT grid_id, height, "timestamp", lag(w, 3) OVER o AS lag_3, lag(w, 4) OVER o AS lag_4 FROM m
        WINDOW o AS (PARTITION BY grid_id, height ORDER BY "timestamp"))
    SELECT n.grid_id, n.height, n.starttime, n.forecasttime, l.lag_3 AS wind_speed_lag_3, l.lag_4 AS wind_speed_lag_4
    FROM nwp n JOIN l ON n.grid_id = l.grid_id AND n.height = l.height AND n."timestamp" = l."timestamp" """,
    num="wind_speed_lag_3 wind_speed_lag_4",
    ts="starttime",
)
def e01_runs(t):
    runs = t.nwp.select("grid_id", "height", "starttime", "forecasttime", "timestamp", "wind_speed")
    lags = S.lag_steps(3, 4, every_row=True)
    out = S.run_lag_features(runs, ["grid_id", "height"], "timestamp", "wind_speed", lags, O.day_chunk("timestamp"))
    return out.drop("timestamp", "wind_speed")


@query(
    "e02_persistence",
    """SELECT station_id, "timestamp", wind_speed,
        lag(wind_speed, 5) OVER (PARTITION BY station_id ORDER BY "timestamp") AS persistence FROM hourly""",
    num="wind_speed persistence",
    ts="timestamp",
)
def e02(t):
    out = S.lag_features(numbered(t), STATION, "pos", "wind_speed", [5])
    return out.select("station_id", "timestamp", "wind_speed", F.col("wind_speed_lag_5").alias("persistence"))


@query(
    "e03_lead_columns",
    """SELECT * FROM (SELECT station_id, "timestamp", lead(wind_speed, 1) OVER o AS wind_speed_t1,
        lead(wind_speed, 2) OVER o AS wind_speed_t2, lead(wind_speed, 3) OVER o AS wind_speed_t3
    FROM hourly WINDOW o AS (PARTITION BY station_id ORDER BY "timestamp"))
    WHERE wind_speed_t1 IS NOT NULL AND wind_speed_t2 IS NOT NULL AND wind_speed_t3 IS NOT NULL""",
    num="wind_speed_t1 wind_speed_t2 wind_speed_t3",
    ts="timestamp",
)
def e03(t):
    out = S.lead_columns(numbered(t), STATION, "pos", "wind_speed", 3)
    return out.drop("pos", "wind_speed", "temperature")


WINDOW_SQL = """SELECT station_id, "timestamp", rn, len(w) AS n, w FROM (SELECT station_id, "timestamp",
        row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS rn,
        list(wind_speed) OVER (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING) AS w
    FROM hourly)"""


@query(
    "e04_sliding_windows",
    f"""SELECT station_id, "timestamp" AS window_start, w[1] AS first_value, w[6] AS last_value, list_sum(w) AS total,
        CAST(len(list_filter(w, lambda x: x IS NULL)) AS INTEGER) AS n_missing
    FROM ({WINDOW_SQL.format(last=5)}) WHERE n = 6 AND (rn - 1) % 4 = 0""",
    num="first_value last_value total",
    ts="window_start",
)
def e04(t):
    out = S.sliding_windows(numbered(t), STATION, "pos", "timestamp", ["wind_speed"], 6, 4, block=256)
    w = F.col("wind_speed")
    values = F.filter(w, lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "station_id", "window_start", w[0].alias("first_value"), w[5].alias("last_value"),
        F.when(F.size(values) > 0, total).alias("total"), (F.size(w) - F.size(values)).alias("n_missing"),
    )


@query(
    "e05_history_future_windows",
    f"""SELECT station_id, "timestamp" + INTERVAL 5 HOUR AS forecast_start, list_sum(w) AS known_total,
        list_sum(w[1:5]) AS observed_total, list_sum(w[6:8]) AS y_total, w[6] AS y_first
    FROM ({WINDOW_SQL.format(last=7)}) WHERE n = 8""",
    num="known_total observed_total y_total y_first",
    ts="forecast_start",
)
def e05(t):
    out = S.history_future_windows(
        numbered(t), STATION, "pos", "timestamp", ["wind_speed"], ["wind_speed"], "wind_speed", 5, 3
    )

    def total(c):
        values = F.filter(c, lambda x: x.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))

    return out.select(
        "station_id", "forecast_start", total("known_wind_speed").alias("known_total"),
        total("observed_wind_speed").alias("observed_total"), total("y").alias("y_total"), F.col("y")[0].alias("y_first"),
    )


def filled_hourly(t):
    return O.fill(t.hourly, STATION, ["timestamp"], ["wind_speed", "temperature"], O.day_chunk("timestamp"))


FILLED_SQL = """SELECT station_id, "timestamp",
        coalesce(last_value(wind_speed IGNORE NULLS) OVER f, first_value(wind_speed IGNORE NULLS) OVER b) AS wind_speed,
        coalesce(last_value(temperature IGNORE NULLS) OVER f, first_value(temperature IGNORE NULLS) OVER b) AS temperature
    FROM hourly WINDOW f AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def run_frame(t):
    """Forecast at a station (mean of its two nearest nodes) next to the measured value."""
    facts = t.nwp.select("grid_id", "starttime", "forecasttime", "timestamp", "wind_speed")
    nwp = nearest_nodes(t, 2).join(facts, "grid_id").groupBy(
        "station_id", "starttime", "forecasttime", "timestamp"
    ).agg(F.avg("wind_speed").alias("nwp_speed"))
    return nwp.join(filled_hourly(t).select("station_id", "timestamp", "wind_speed"), ["station_id", "timestamp"])


RUN_FRAME_SQL = f"""SELECT n.*, h.wind_speed FROM (
        SELECT station_id, starttime, forecasttime, "timestamp", avg(wind_speed) AS nwp_speed
        FROM ({nearest_sql(2)}) k JOIN nwp USING (grid_id) GROUP BY ALL) n
    JOIN ({FILLED_SQL}) h ON n.station_id = h.station_id AND n."timestamp" = h."timestamp" """


@query(
    "e06_run_sequences",
    f"""WITH f AS ({RUN_FRAME_SQL}),
    r AS (SELECT station_id, starttime, count(*) AS n, min("timestamp") AS t0, sum(nwp_speed) AS k, sum(wind_speed) AS y
        FROM f WHERE forecasttime <= 6 GROUP BY ALL HAVING count(*) = 6),
    o AS (SELECT station_id, "timestamp" AS ts, arg_min(wind_speed, (starttime, forecasttime)) AS w FROM f GROUP BY ALL)
    SELECT r.station_id, r.starttime, r.k + p.k AS known_total, sum(o.w) AS observed_total, r.y AS y_total
    FROM r JOIN r p ON p.station_id = r.station_id AND p.starttime = r.starttime - INTERVAL 6 HOUR
    JOIN o ON o.station_id = r.station_id AND o.ts >= r.t0 - INTERVAL 6 HOUR AND o.ts < r.t0
    GROUP BY r.station_id, r.starttime, r.k, p.k, r.y HAVING count(*) = 6""",
    num="known_total observed_total y_total",
    ts="starttime",
)
def e06(t):
    out = S.run_sequences(run_frame(t), STATION, "nwp_speed", "wind_speed", "wind_speed", 6, 6)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return out.select(
        "station_id", "starttime", total("known").alias("known_total"),
        total("observed").alias("observed_total"), total("y").alias("y_total"),
    )


def station_runs(t):
    """Runs of the node that carries the station's number."""
    return t.nwp.select(
        F.lpad(F.col("grid_id").cast("string"), 5, "0").alias("station_id"), "starttime"
    ).distinct()


PAIRS_SQL = """WITH runs AS (SELECT DISTINCT lpad(CAST(grid_id AS VARCHAR), 5, '0') AS station_id, starttime FROM nwp),
    span AS (SELECT station_id, min("timestamp") AS a, max("timestamp") AS b FROM hourly GROUP BY ALL),
    hist AS (SELECT r.station_id, r.starttime, h.starttime AS history_run FROM runs r JOIN runs h ON r.station_id = h.station_id
        AND abs(date_diff('second', h.starttime, r.starttime - INTERVAL 6 HOUR)) <= 10800
        QUALIFY row_number() OVER (PARTITION BY r.station_id, r.starttime
            ORDER BY abs(date_diff('second', h.starttime, r.starttime - INTERVAL 6 HOUR)), h.starttime) = 1),
    seen AS (SELECT r.station_id, r.starttime, count(h.wind_speed) AS n,
        count(*) FILTER (h."timestamp" = r.starttime) AS at_start
        FROM runs r JOIN hourly h ON h.station_id = r.station_id
            AND h."timestamp" >= r.starttime - INTERVAL 6 HOUR AND h."timestamp" < r.starttime + INTERVAL 4 HOUR GROUP BY ALL)
    SELECT r.station_id, r.starttime, hist.history_run, CASE WHEN coalesce(seen.at_start, 0) = 0 THEN 'no_timestamp'
        WHEN span.a > r.starttime - INTERVAL 6 HOUR OR span.b < r.starttime + INTERVAL 3 HOUR THEN 'bounds'
        WHEN hist.history_run IS NULL THEN 'no_history' WHEN coalesce(seen.n, 0) < 10 THEN 'missing' ELSE 'valid' END AS reason
    FROM runs r JOIN span USING (station_id) LEFT JOIN hist USING (station_id, starttime) LEFT JOIN seen USING (station_id, starttime)"""


def run_pairs(t, series=None):
    return S.run_pairs(station_runs(t), series or t.hourly, STATION, "wind_speed", 6, 4)


FILLED_PAIRS_SQL = PAIRS_SQL.replace("JOIN hourly h ON", f"JOIN ({FILLED_SQL}) h ON")


@query("e07_run_pairs", f"SELECT station_id, starttime, history_run FROM ({FILLED_PAIRS_SQL}) WHERE reason = 'valid'",
       ts="starttime history_run")
def e07(t):
    return run_pairs(t, filled_hourly(t)).filter("reason = 'valid'").drop("reason")


@query("n03_run_pair_attrition", f"SELECT reason, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY ALL")
def n03(t):
    return run_pairs(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("e08_fill_both_ways", FILLED_SQL, num="wind_speed temperature", ts="timestamp")
def e08(t):
    return filled_hourly(t)


@query(
    "e09_linear_interpolation",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS p FROM hourly),
    s AS (SELECT station_id, "timestamp", p, temperature AS v,
        last_value(CASE WHEN temperature IS NOT NULL THEN p END IGNORE NULLS) OVER f AS p0, last_value(temperature IGNORE NULLS) OVER f AS v0,
        first_value(CASE WHEN temperature IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p1, first_value(temperature IGNORE NULLS) OVER b AS v1
        FROM r WINDOW f AS (PARTITION BY station_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            b AS (PARTITION BY station_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT station_id, "timestamp", coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1) AS temperature FROM s""",
    num="temperature",
    ts="timestamp",
)
def e09(t):
    out = O.interpolate_linear(numbered(t), STATION, "pos", ["temperature"], block=200)
    return out.select("station_id", "timestamp", "temperature")


@query("e10_cubic_interpolation", num="wind_speed", ts="timestamp")
def e10(t):
    return S.interpolate_cubic(numbered(t), STATION, "pos", "wind_speed").select("station_id", "timestamp", "wind_speed")


@query(
    "e11_rank_and_group_size",
    f"""SELECT grid_id, station_id, CAST(rank() OVER (PARTITION BY grid_id ORDER BY round(d, 6)) AS INTEGER) AS rank,
        count(*) OVER (PARTITION BY grid_id) AS n_stations
    FROM (SELECT g.grid_id, s.station_id, {HAVERSINE_SQL.format(a='g', b='s')} AS d FROM nodes g CROSS JOIN stations s)
    WHERE d <= 100""",
)
def e11(t):
    pairs = within(t.nodes, t.stations, 100.0, "grid_id", "station_id")
    rows = pairs.select(
        F.col("target_id").alias("grid_id"), F.col("near_id").alias("station_id"), F.round("distance", 6).alias("d")
    )
    out = O.group_ranks(rows, ["grid_id"], "d", F.floor("d"), total="n_stations", crowded=False)
    return out.withColumn("rank", F.col("rank").cast("int")).drop("d")


@query(
    "e12_keep_last",
    "SELECT grid_id, starttime, forecasttime, height, u_wind, pressure FROM nwp",
    num="u_wind pressure",
    ts="starttime",
)
def e12(t):
    return t.nwp.select("grid_id", "starttime", "forecasttime", "height", "u_wind", "pressure")


@query(
    "e13_most_important_feature",
    """SELECT station_id, feature_type, feature_name, avg_weight FROM weights
    QUALIFY row_number() OVER (PARTITION BY feature_name, feature_type ORDER BY avg_weight DESC, station_id) = 1""",
    num="avg_weight",
)
def e13(t):
    return O.first_rows(t.weights, ["feature_name", "feature_type"], [F.desc("avg_weight"), "station_id"]).select(
        "station_id", "feature_type", "feature_name", "avg_weight"
    )


ISLANDS_SQL = """SELECT station_id, min("timestamp") AS gap_start, max("timestamp") AS gap_end, count(*) AS hours FROM (
    SELECT station_id, "timestamp", epoch("timestamp") // 3600 - row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS g
    FROM hourly WHERE wind_speed IS NULL) GROUP BY station_id, g"""


@query("e14_gaps", ISLANDS_SQL, ts="gap_start gap_end")
def e14(t):
    missing = t.hourly.filter("wind_speed IS NULL").select("station_id", O.slot("timestamp").alias("slot"))
    runs = O.islands(missing, STATION, "slot", F.floor(F.col("slot") / 24))
    return runs.select(
        "station_id",
        F.timestamp_seconds(F.col("first_index") * 3600).alias("gap_start"),
        F.timestamp_seconds(F.col("last_index") * 3600).alias("gap_end"),
        F.col("length").alias("hours"),
    )


@query(
    "e15_segments",
    """SELECT "timestamp", ntile(7) OVER (ORDER BY "timestamp") - 1 AS segment FROM (SELECT DISTINCT "timestamp" FROM hourly)""",
    ts="timestamp",
)
def e15(t):
    return O.segments(t.hourly.select("timestamp").distinct(), "timestamp", 7, O.day_chunk)


@query(
    "e16_trial_trend",
    """SELECT study_name, -regr_slope(value, p) AS improvement_per_trial FROM (
        SELECT study_name, value, row_number() OVER (PARTITION BY study_name ORDER BY number) AS p FROM trials
        WHERE state = 'COMPLETE') GROUP BY ALL""",
    num="improvement_per_trial",
)
def e16(t):
    done = t.trials.filter("state = 'COMPLETE'")
    placed = O.positions(done, ["study_name"], ["number"], F.floor(F.col("number") / 1000))
    return placed.groupBy("study_name").agg((-F.regr_slope("value", "pos")).alias("improvement_per_trial"))


@query(
    "e17_delta_to_reference",
    """WITH m AS (SELECT station_id, horizon, avg(abs(pred - gt)) AS mae FROM predictions GROUP BY ALL)
    SELECT m.station_id, m.horizon, m.mae, m.mae - r.mae AS delta, (m.mae - r.mae) / nullif(r.mae, 0) AS relative_delta
    FROM m JOIN m r ON m.station_id = r.station_id AND r.horizon = 1""",
    num="mae delta relative_delta",
)
def e17(t):
    from galeframe.operators.metrics import delta_to_reference

    mae = t.predictions.groupBy("station_id", "horizon").agg(F.avg(F.abs(F.col("pred") - F.col("gt"))).alias("mae"))
    return delta_to_reference(mae, ["station_id"], F.col("horizon") == 1, "mae")
