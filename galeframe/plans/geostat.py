"""Geostatistics and station graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions.geo import bearing_degrees
from galeframe.functions.physics import wind_components
from galeframe.operators import graph as G
from galeframe.operators import kriging as K
from galeframe.operators import metrics as M
from galeframe.operators.forecasts import forecast_at_stations
from galeframe.operators.neighbours import k_nearest, within
from galeframe.operators.ordering import day_chunk, segments
from galeframe.operators.quantiles import quantile_columns
from galeframe.operators.reshape import melt
from galeframe.plans.aggregates import nearest_nodes, nearest_sql
from galeframe.plans.joins import PAIR_SV_SQL, STATION_NEAR_SQL, measured
from galeframe.plans.physics import BEARING_SQL, HAVERSINE_SQL
from galeframe.plans.registry import query
from galeframe.plans.series import FILLED_SQL, filled_hourly

MAX_KM = 500.0
LAGS = 10

PAIRS_SQL = f"""SELECT a.station_id AS i, b.station_id AS j, {HAVERSINE_SQL.format(a='a', b='b')} AS distance,
    ({BEARING_SQL.format(a='a', b='b')}) AS bearing FROM stations a JOIN stations b ON a.station_id < b.station_id"""


@query(
    "k01_pairwise_distances",
    f"""WITH p AS (SELECT i, j, distance FROM ({PAIRS_SQL}) WHERE distance <= 200)
    SELECT i AS target_id, j AS near_id, distance FROM p UNION ALL SELECT j, i, distance FROM p""",
    num="distance",
)
def k01(t):
    return within(t.stations, t.stations, 200.0).filter("target_id <> near_id")


ALL_NEAR_SQL = f"""SELECT a.station_id AS target_id, b.station_id AS near_id, {HAVERSINE_SQL.format(a='a', b='b')} AS distance,
    row_number() OVER (PARTITION BY a.station_id ORDER BY round({HAVERSINE_SQL.format(a='a', b='b')}, 9), b.station_id) AS rank
    FROM stations a JOIN stations b ON a.station_id <> b.station_id"""


def near_stations(t, k):
    return k_nearest(t.stations, t.stations, k, candidate_key="station_id", exclude_self=True)


@query(
    "k02_nearest_stations",
    f"SELECT target_id, near_id, CAST(rank AS INTEGER) AS rank, distance FROM ({ALL_NEAR_SQL}) WHERE rank <= 6",
    num="distance",
)
def k02(t):
    return near_stations(t, 6)


BIN_SQL = "CAST(least(greatest(ceil(distance / 50) - 1, 0), 9) AS INTEGER)"


def pair_values(t, by=()):
    pairs = K.station_pairs(t.stations, MAX_KM)
    return K.pair_semivariance(t.hourly, pairs, "wind_speed", by=by, stations=t.stations)


@query(
    "k03_semivariogram",
    f"""{PAIR_SV_SQL} SELECT {BIN_SQL} AS lag_bin, avg(semivariance) AS semivariance, count(*) AS n_pairs,
        ({BIN_SQL} + 0.5e0) * 50 AS lag_km FROM v GROUP BY ALL""",
    num="semivariance lag_km",
)
def k03(t):
    return K.bin_semivariance(pair_values(t), MAX_KM, LAGS)


@query(
    "k03_semivariogram_without_trend",
    f"""WITH h AS (SELECT station_id, "timestamp", wind_speed - avg(wind_speed) OVER (PARTITION BY station_id) AS z FROM hourly),
    v AS (SELECT p.i, p.j, p.distance, 0.5 * avg(pow(x.z - y.z, 2)) AS semivariance FROM ({PAIRS_SQL}) p
        JOIN h x ON x.station_id = p.i JOIN h y ON y.station_id = p.j AND y."timestamp" = x."timestamp"
        WHERE p.distance <= 500 GROUP BY ALL HAVING count(x.z + y.z) > 0)
    SELECT {BIN_SQL} AS lag_bin, avg(semivariance) AS semivariance, count(*) AS n_pairs, ({BIN_SQL} + 0.5e0) * 50 AS lag_km FROM v GROUP BY ALL""",
    num="semivariance lag_km",
)
def k03_detrended(t):
    pairs = K.station_pairs(t.stations, MAX_KM)
    series = K.detrend(t.hourly, "wind_speed")
    return K.bin_semivariance(K.pair_semivariance(series, pairs, "wind_speed", stations=t.stations), MAX_KM, LAGS)


AZIMUTHS = [0, 45, 90, 135]
TURN_SQL = "abs((degrees(bearing) + 360) % 180 - az)"
IN_SQL = f"least({TURN_SQL}, 180 - {TURN_SQL}) <= 22.5"


def with_bearing(pairs, t):
    ends = [
        t.stations.select(F.col("station_id").alias(e), F.col("latitude").alias(f"lat_{e}"), F.col("longitude").alias(f"lon_{e}"))
        for e in ("i", "j")
    ]
    rows = pairs.join(ends[0], "i").join(ends[1], "j")
    bearing = bearing_degrees("lat_i", "lon_i", "lat_j", "lon_j")
    return rows.withColumn("bearing", bearing).drop("lat_i", "lon_i", "lat_j", "lon_j")


def by_direction(rows):
    azimuth = F.explode(F.array(*[F.lit(float(a)) for a in AZIMUTHS]))
    near = K.in_direction(F.col("bearing"), F.col("azimuth"), 22.5)
    return rows.withColumn("azimuth", azimuth).filter(near)


@query(
    "k04_directional_semivariogram",
    f"""{PAIR_SV_SQL}, b AS (SELECT v.*, p.bearing FROM v JOIN ({PAIRS_SQL}) p USING (i, j))
    SELECT CAST(az AS DOUBLE) AS azimuth, {BIN_SQL} AS lag_bin, avg(semivariance) AS semivariance, count(*) AS n_pairs, ({BIN_SQL} + 0.5e0) * 50 AS lag_km
    FROM b CROSS JOIN (SELECT unnest([0, 45, 90, 135]) AS az) WHERE {IN_SQL} GROUP BY ALL""",
    num="azimuth semivariance lag_km",
)
def k04(t):
    rows = by_direction(with_bearing(pair_values(t), t))
    return K.bin_semivariance(rows, MAX_KM, LAGS, ["azimuth"])


BAND_SQL = ", ".join(
    f"count(*) FILTER (distance >= {a} AND distance < {b}) AS band_{a}" for a, b in ((0, 10), (10, 50), (50, 100), (100, 200), (200, 300))
)


@query(
    "k05_distance_distribution",
    f"""SELECT CAST(az AS DOUBLE) AS azimuth, count(*) AS n, min(distance) AS d_min, avg(distance) AS d_mean, max(distance) AS d_max,
        quantile_cont(distance, 0.1) AS p10, quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.9) AS p90, {BAND_SQL}
    FROM ({PAIRS_SQL}) CROSS JOIN (SELECT unnest([0, 45, 90, 135]) AS az) WHERE distance <= 500 AND {IN_SQL} GROUP BY ALL""",
    num="azimuth d_min d_mean d_max p10 p50 p90",
)
def k05(t):
    rows = by_direction(with_bearing(K.station_pairs(t.stations, MAX_KM).rows(), t))
    d = F.col("distance")
    bands = [F.count_if((d >= a) & (d < b)).alias(f"band_{a}") for a, b in ((0, 10), (10, 50), (50, 100), (100, 200), (200, 300))]
    base = rows.groupBy("azimuth").agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("d_min"), F.avg(d).alias("d_mean"), F.max(d).alias("d_max"), *bands
    )
    marks = quantile_columns(rows, ["azimuth"], "distance", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return base.join(marks, "azimuth")


def segmented(t, n=3):
    return segments(t.hourly.select("station_id", "timestamp", "wind_speed"), "timestamp", n, day_chunk)


def fitted(t):
    rows = segmented(t)
    pairs = K.station_pairs(t.stations, MAX_KM)
    values = K.pair_semivariance(rows, pairs, "wind_speed", by=["segment"], stations=t.stations)
    return K.fit_variograms(K.bin_semivariance(values, MAX_KM, LAGS, ["segment"]), "exponential", ["segment"])


@query("k06_variogram_fit", num="nugget psill range")
def k06(t):
    return fitted(t)


@query("k15_flat_variograms", num="nugget psill range")
def k15(t):
    return K.flat_variograms(fitted(t))


def fixed_model(t):
    """An exponential model with nugget 0.1, partial sill 2 and range 150 km."""
    return t.stations.agg(F.lit(0.1).alias("nugget"), F.lit(2.0).alias("psill"), F.lit(150.0).alias("range"))


def measured_weights(t, k, model=None):
    pool = measured(t)
    near = k_nearest(pool, pool, k, candidate_key="station_id", exclude_self=True)
    cells = pool.select(F.col("station_id").alias("target_id"))
    return K.kriging_weights(near, pool, cells, model if model is not None else fixed_model(t), model="exponential")


GAMMA = "(CASE WHEN {d} = 0 THEN 0 ELSE 0.1e0 + 2 * (1 - exp(-{d} / 150)) END)"
TWO_SQL = f"""SELECT x.station_id AS target_id, x.near_id AS a, y.near_id AS b, x.distance AS da, y.distance AS db,
    0.5 + ({GAMMA.format(d='y.distance')} - {GAMMA.format(d='x.distance')}) / (2 * {GAMMA.format(d=f"({HAVERSINE_SQL.format(a='s', b='u')})")}) AS wa
    FROM ({STATION_NEAR_SQL}) x JOIN ({STATION_NEAR_SQL}) y ON x.station_id = y.station_id AND x.rank = 1 AND y.rank = 2
    JOIN stations s ON s.station_id = x.near_id JOIN stations u ON u.station_id = y.near_id"""


@query(
    "k07_kriging_weights_two_neighbours",
    f"""WITH w AS ({TWO_SQL}) SELECT target_id, a AS near_id, 1 AS rank, da AS distance, wa AS weight FROM w
    UNION ALL SELECT target_id, b, 2, db, 1 - wa FROM w""",
    num="distance weight",
)
def k07_two(t):
    return measured_weights(t, 2)


def _three_sql() -> str:
    """Weights of three neighbours: the Lagrange multiplier and the third weight go, two equations stay (Cramer)."""
    def gamma(p: str, q: str) -> str:
        return GAMMA.format(d=f"({HAVERSINE_SQL.format(a=p, b=q)})")

    near = ", ".join(f"n{i}.near_id AS i{i}, n{i}.distance AS d{i}, {GAMMA.format(d=f'n{i}.distance')} AS r{i}" for i in (1, 2, 3))
    joins = " ".join(
        f"JOIN ({STATION_NEAR_SQL}) n{i} ON n{i}.station_id = t.station_id AND n{i}.rank = {i} JOIN stations s{i} ON s{i}.station_id = n{i}.near_id"
        for i in (1, 2, 3)
    )
    pairs = ", ".join(f"{gamma(f's{a}', f's{b}')} AS g{a}{b}" for a, b in ((1, 2), (1, 3), (2, 3)))
    return f"""SELECT target_id, i1, i2, i3, d1, d2, d3, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a21) AS w1,
        (a11 * b2 - a21 * b1) / (a11 * a22 - a12 * a21) AS w2, 1 - (b1 * a22 - b2 * a12 + a11 * b2 - a21 * b1) / (a11 * a22 - a12 * a21) AS w3
    FROM (SELECT *, -2 * g13 AS a11, g12 - g23 - g13 AS a12, g12 - g13 - g23 AS a21, -2 * g23 AS a22,
            r1 - r3 - g13 AS b1, r2 - r3 - g23 AS b2
        FROM (SELECT t.station_id AS target_id, {near}, {pairs} FROM (SELECT DISTINCT station_id FROM ({STATION_NEAR_SQL})) t {joins}))"""


THREE_SQL = _three_sql()
THREE_ROWS_SQL = " UNION ALL ".join(f"SELECT target_id, i{i} AS near_id, {i} AS rank, d{i} AS distance, w{i} AS weight FROM w" for i in (1, 2, 3))


@query("k07_kriging_weights_three_neighbours", f"WITH w AS ({THREE_SQL}) {THREE_ROWS_SQL}", num="distance weight")
def k07_three(t):
    return measured_weights(t, 3)


@query("k07_kriging_weights", num="distance weight")
def k07(t):
    near = near_stations(t, 8)
    cells = t.stations.select(F.col("station_id").alias("target_id"))
    return K.kriging_weights(near, t.stations, cells, fixed_model(t), model="exponential")


@query(
    "k08_ordinary_kriging",
    f"""WITH w AS ({TWO_SQL}) SELECT w.target_id AS station_id, x."timestamp", wa * x.wind_speed + (1 - wa) * y.wind_speed AS ok_pred
    FROM w JOIN hourly x ON x.station_id = w.a JOIN hourly y ON y.station_id = w.b AND y."timestamp" = x."timestamp"
    JOIN hourly o ON o.station_id = w.target_id AND o."timestamp" = x."timestamp"
    WHERE x.wind_speed IS NOT NULL AND y.wind_speed IS NOT NULL AND o.wind_speed IS NOT NULL""",
    num="ok_pred",
    ts="timestamp",
)
def k08(t):
    out = K.leave_one_out(t.hourly, measured_weights(t, 2), "wind_speed", 2, places=t.stations)
    return out.select("station_id", "timestamp", "ok_pred")


@query(
    "k09_inverse_distance",
    f"""SELECT k.station_id, h."timestamp", sum(h.wind_speed / pow(distance, 2)) / sum(1 / pow(distance, 2)) AS idw_pred
    FROM ({STATION_NEAR_SQL}) k JOIN hourly h ON h.station_id = k.near_id WHERE rank <= 4 AND h.wind_speed IS NOT NULL
    GROUP BY ALL""",
    num="idw_pred",
    ts="timestamp",
)
def k09(t):
    pool = measured(t)
    near = k_nearest(pool, pool, 4, candidate_key="station_id", exclude_self=True)
    rows = K.neighbour_values(t.hourly, near, ["wind_speed"])
    out = rows.groupBy(F.col("target_id").alias("station_id"), "timestamp").agg(
        K.idw_prediction(F.col("wind_speed"), F.col("distance")).alias("idw_pred")
    )
    return out.filter("idw_pred IS NOT NULL")


@query(
    "k10_regression_kriging_three_neighbours",
    f"""WITH w AS ({THREE_SQL}), e AS ({THREE_ROWS_SQL}), h AS ({FILLED_SQL}),
    p AS (SELECT e.target_id AS station_id, o."timestamp", o.wind_speed AS observed, o.temperature AS x0, sum(weight * n.wind_speed) AS ok_pred,
        sum(n.wind_speed / pow(distance, 2)) / sum(1 / pow(distance, 2)) AS idw_pred, sum(weight * n.temperature) AS wx,
        avg(n.wind_speed) AS mz, avg(n.temperature) AS mx, count(n.wind_speed) AS nz, count(n.temperature) AS nx,
        CASE WHEN max(n.temperature) - min(n.temperature) > 1e-6 THEN regr_slope(n.wind_speed, n.temperature) ELSE 0 END AS b
        FROM e JOIN h n ON n.station_id = e.near_id JOIN h o ON o.station_id = e.target_id AND o."timestamp" = n."timestamp"
        WHERE o.wind_speed IS NOT NULL GROUP BY ALL)
    SELECT station_id, "timestamp", observed, idw_pred, ok_pred, round(CASE WHEN nx = 3 AND x0 IS NOT NULL
        THEN mz + b * (x0 - mx) + ok_pred - mz - b * (wx - mx) ELSE ok_pred END + 1.7e-5, 3) AS rk_pred FROM p WHERE nz = 3""",
    num="observed idw_pred ok_pred rk_pred",
    ts="timestamp",
)
def k10_three(t):
    """Three digits, because nearly equal covariates amplify the last bits."""
    out = K.leave_one_out(filled_hourly(t), measured_weights(t, 3), "wind_speed", 3, covariate="temperature", places=t.stations)
    return out.withColumn("rk_pred", F.round(F.col("rk_pred") + 1.7e-5, 3))


@query("k10_regression_kriging", num="observed idw_pred ok_pred rk_pred", ts="timestamp")
def k10(t):
    return K.leave_one_out(filled_hourly(t), measured_weights(t, 5), "wind_speed", 5, covariate="temperature", places=t.stations)


@query("k10_regression_kriging_many", num="observed rk_pred", ts="timestamp")
def k10_many(t):
    rows = filled_hourly(t).join(t.stations.select("station_id", "station_height"), "station_id")
    return K.regression_kriging(rows, measured_weights(t, 6), "wind_speed", ["temperature", "station_height"], 6, places=t.stations)


@query("k11_leave_one_out_run", num="observed idw_pred ok_pred rk_pred", ts="timestamp")
def k11(t):
    rows = segments(filled_hourly(t), "timestamp", 3, day_chunk)
    return K.interpolate_stations(
        rows, measured(t), "wind_speed", 5, MAX_KM, LAGS, "exponential", covariate="temperature", segment="segment"
    )


@query("k11_anisotropic_run", num="observed idw_pred ok_pred rk_pred", ts="timestamp")
def k11_anisotropic(t):
    return K.interpolate_stations(
        filled_hourly(t), measured(t), "wind_speed", 4, MAX_KM, LAGS, "exponential", detrended=True, anisotropy=(135.0, 0.6)
    )


COMPONENTS_SQL = """SELECT station_id, date_trunc('hour', "timestamp") AS ts, avg(wind_speed) AS s,
    avg(-wind_speed * sin(radians(wind_direction))) AS u, avg(-wind_speed * cos(radians(wind_direction))) AS v FROM raw GROUP BY 1, 2"""


@query(
    "k11_wind_components",
    f"""WITH w AS ({TWO_SQL}), h AS ({COMPONENTS_SQL}),
    p AS (SELECT w.target_id AS station_id, o.ts, o.s AS observed, wa * x.s + (1 - wa) * y.s AS ok_pred, wa * x.u + (1 - wa) * y.u AS u, wa * x.v + (1 - wa) * y.v AS v
        FROM w JOIN h x ON x.station_id = w.a JOIN h y ON y.station_id = w.b AND y.ts = x.ts JOIN h o ON o.station_id = w.target_id AND o.ts = x.ts)
    SELECT station_id, ts AS "timestamp", observed, ok_pred, u AS u_ok_pred, v AS v_ok_pred, sqrt(u * u + v * v) AS uv_ok_pred FROM p""",
    num="observed ok_pred u_ok_pred v_ok_pred uv_ok_pred",
    ts="timestamp",
)
def k11_components(t):
    u, v = wind_components("wind_speed", "wind_direction")
    hour = F.date_trunc("hour", "timestamp").alias("timestamp")
    series = t.raw.groupBy("station_id", hour).agg(
        F.avg("wind_speed").alias("wind_speed"), F.avg(u).alias("u"), F.avg(v).alias("v")
    )
    out = K.leave_one_out_components(series, measured_weights(t, 2), "wind_speed", "u", "v", 2, places=t.stations)
    return out.select("station_id", "timestamp", "observed", "ok_pred", "u_ok_pred", "v_ok_pred", "uv_ok_pred")


@query(
    "k10_regression_kriging_two_neighbours",
    f"""WITH w AS ({TWO_SQL}), h AS ({FILLED_SQL}),
    p AS (SELECT w.target_id AS station_id, o."timestamp", o.temperature AS xo, x.temperature AS xa, y.temperature AS xb,
        x.wind_speed AS za, y.wind_speed AS zb, wa * x.wind_speed + (1 - wa) * y.wind_speed AS ok
        FROM w JOIN h x ON x.station_id = w.a JOIN h y ON y.station_id = w.b AND y."timestamp" = x."timestamp"
        JOIN h o ON o.station_id = w.target_id AND o."timestamp" = x."timestamp")
    SELECT station_id, "timestamp", round(CASE WHEN abs(xa - xb) / 2 > 1e-9 * ((abs(xa) + abs(xb)) / 2 + 1e-9)
        THEN za + (zb - za) / (xb - xa) * (xo - xa) ELSE ok END + 1.7e-5, 3) AS rk_pred FROM p""",
    num="rk_pred",
    ts="timestamp",
)
def k10_two(t):
    """A line through two neighbours leaves no residual, unless their covariates are equal.

    Close covariates amplify the last bits, hence three digits.
    """
    out = K.leave_one_out(filled_hourly(t), measured_weights(t, 2), "wind_speed", 2, covariate="temperature", places=t.stations)
    return out.select("station_id", "timestamp", F.round(F.col("rk_pred") + 1.7e-5, 3).alias("rk_pred"))


SEEN = "g.z - mz - slope * (g.x - mx)"


@query(
    "k12_global_trend_two_neighbours",
    f"""WITH w AS ({TWO_SQL}), e AS (SELECT target_id, a AS near_id, wa AS wt FROM w UNION ALL SELECT target_id, b, 1 - wa FROM w),
    f AS (SELECT station_id, "timestamp" AS ts, wind_speed AS z, temperature AS x FROM hourly),
    c AS (SELECT f.station_id, f.ts, f.z, f.x, avg(o.z) FILTER (o.x IS NOT NULL) AS mz, avg(o.x) FILTER (o.z IS NOT NULL) AS mx,
        CASE WHEN max(o.x) FILTER (o.z IS NOT NULL) - min(o.x) FILTER (o.z IS NOT NULL) > 1e-6 THEN regr_slope(o.z, o.x) ELSE 0 END AS slope
        FROM f LEFT JOIN f o ON o.ts = f.ts AND o.station_id <> f.station_id GROUP BY ALL),
    r AS (SELECT c.station_id, c.ts, sum(wt * ({SEEN})) / nullif(sum(wt) FILTER ({SEEN} IS NOT NULL), 0) AS r
        FROM c JOIN e ON e.target_id = c.station_id JOIN f g ON g.station_id = e.near_id AND g.ts = c.ts GROUP BY ALL)
    SELECT c.station_id, c.ts AS "timestamp", c.z AS observed, mz + slope * (c.x - mx) + coalesce(r.r, 0) AS rk_pred FROM c LEFT JOIN r USING (station_id, ts)""",
    num="observed rk_pred",
    ts="timestamp",
)
def k12_two(t):
    return K.global_trend_kriging(t.hourly, measured_weights(t, 2), "wind_speed", "temperature", places=t.stations)


@query(
    "k12_global_trend_three_neighbours",
    f"""WITH w AS ({THREE_SQL}), e AS ({THREE_ROWS_SQL}),
    f AS (SELECT station_id, "timestamp" AS ts, wind_speed AS z, temperature AS x FROM hourly),
    c AS (SELECT f.station_id, f.ts, f.z, f.x, avg(o.z) FILTER (o.x IS NOT NULL) AS mz, avg(o.x) FILTER (o.z IS NOT NULL) AS mx,
        CASE WHEN max(o.x) FILTER (o.z IS NOT NULL) - min(o.x) FILTER (o.z IS NOT NULL) > 1e-6 THEN regr_slope(o.z, o.x) ELSE 0 END AS slope
        FROM f LEFT JOIN f o ON o.ts = f.ts AND o.station_id <> f.station_id GROUP BY ALL),
    r AS (SELECT c.station_id, c.ts, sum(weight * ({SEEN})) / nullif(sum(weight) FILTER ({SEEN} IS NOT NULL), 0) AS r
        FROM c JOIN e ON e.target_id = c.station_id JOIN f g ON g.station_id = e.near_id AND g.ts = c.ts GROUP BY ALL)
    SELECT c.station_id, c.ts AS "timestamp", c.z AS observed, mz + slope * (c.x - mx) + coalesce(r.r, 0) AS rk_pred FROM c LEFT JOIN r USING (station_id, ts)""",
    num="observed rk_pred",
    ts="timestamp",
)
def k12_three(t):
    return K.global_trend_kriging(t.hourly, measured_weights(t, 3), "wind_speed", "temperature", places=t.stations)


@query("k12_global_trend_kriging", num="observed rk_pred", ts="timestamp")
def k12(t):
    return K.global_trend_kriging(t.hourly, measured_weights(t, 5), "wind_speed", "temperature", places=t.stations)


@query(
    "k13_scores_per_method",
    f"""WITH p AS (SELECT o.station_id, o.wind_speed AS gt, sum(h.wind_speed / pow(distance, 2)) / sum(1 / pow(distance, 2)) AS idw,
        avg(h.wind_speed) AS mean_near FROM ({STATION_NEAR_SQL}) k JOIN ({FILLED_SQL}) h ON h.station_id = k.near_id
        JOIN hourly o ON o.station_id = k.station_id AND o."timestamp" = h."timestamp"
        WHERE rank <= 3 AND o.wind_speed IS NOT NULL GROUP BY o.station_id, o."timestamp", o.wind_speed),
    s AS (SELECT station_id, 'idw' AS method, sqrt(avg(pow(idw - gt, 2))) AS rmse, avg(abs(idw - gt)) AS mae FROM p GROUP BY ALL
        UNION ALL SELECT station_id, 'mean_near', sqrt(avg(pow(mean_near - gt, 2))), avg(abs(mean_near - gt)) FROM p GROUP BY ALL)
    SELECT * FROM s UNION ALL SELECT 'mean', method, avg(rmse), avg(mae) FROM s GROUP BY ALL""",
    num="rmse mae",
)
def k13(t):
    pool = measured(t)
    near = k_nearest(pool, pool, 3, candidate_key="station_id", exclude_self=True)
    rows = K.neighbour_values(filled_hourly(t), near, ["wind_speed"])
    preds = rows.groupBy(F.col("target_id").alias("station_id"), "timestamp").agg(
        K.idw_prediction(F.col("wind_speed"), F.col("distance")).alias("idw"), F.avg("wind_speed").alias("mean_near")
    )
    truth = t.hourly.select("station_id", "timestamp", F.col("wind_speed").alias("gt")).filter("gt IS NOT NULL")
    long = melt(preds.join(truth, ["station_id", "timestamp"]), ["station_id", "gt"], ["idw", "mean_near"], "method", "pred")
    scores = long.groupBy("station_id", "method").agg(M.rmse("gt", "pred").alias("rmse"), M.mae("gt", "pred").alias("mae"))
    means = scores.groupBy("method").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    return scores.unionByName(means.select(F.lit("mean").alias("station_id"), "method", "rmse", "mae"))


@query(
    "k14_forecast_at_stations",
    f"""SELECT k.station_id, n."timestamp", n.starttime, n.wind_speed AS nwp_ref FROM ({nearest_sql(1)}) k JOIN nwp n USING (grid_id)
    WHERE n.forecasttime > 0 QUALIFY row_number() OVER (PARTITION BY k.station_id, n."timestamp" ORDER BY abs(n.height - 30), n.height, n.forecasttime) = 1""",
    num="nwp_ref",
    ts="timestamp starttime",
)
def k14(t):
    return forecast_at_stations(nearest_nodes(t, 1), t.nwp, "wind_speed", 30.0)


EDGE_SQL = f"""SELECT least(target_id, near_id) AS a, greatest(target_id, near_id) AS b, min(distance) AS distance
    FROM ({ALL_NEAR_SQL}) WHERE rank <= 4 GROUP BY ALL"""
EDGES_SQL = f"SELECT a AS src, b AS dst, distance FROM ({EDGE_SQL}) UNION ALL SELECT b, a, distance FROM ({EDGE_SQL})"


@query("k16_nearest_edges", EDGES_SQL, num="distance")
def k16(t):
    return G.nearest_edges(t.stations, 4)


@query(
    "k17_radius_edges",
    f"SELECT near_id AS src, target_id AS dst, distance FROM ({ALL_NEAR_SQL}) WHERE distance <= 150 AND rank <= 8",
    num="distance",
)
def k17(t):
    return G.radius_edges(t.stations, 150.0, cap=8)


@query(
    "k18_grid_edges",
    f"SELECT grid_id AS src, station_id AS dst, distance FROM ({nearest_sql(4, nodes='grid')})",
    num="distance",
)
def k18(t):
    return G.grid_edges(t.stations, t.grid, 4)


@query(
    "k19_edge_features",
    f"""SELECT e.src, e.dst, e.distance / (max(e.distance) OVER () + 1e-8) AS dist_norm, sin({BEARING_SQL.format(a='a', b='b')}) AS sin_brg,
        cos({BEARING_SQL.format(a='a', b='b')}) AS cos_brg, CASE WHEN a.station_height IS NOT NULL AND b.station_height IS NOT NULL
            THEN greatest(-1, least(1, (b.station_height - a.station_height) / 3000)) END AS d_alt,
        b.latitude - a.latitude AS d_latitude
    FROM ({EDGES_SQL}) e JOIN stations a ON a.station_id = e.src JOIN stations b ON b.station_id = e.dst""",
    num="dist_norm sin_brg cos_brg d_alt d_latitude",
)
def k19(t):
    dim = t.stations.withColumnRenamed("station_id", "id")
    return G.edge_features(G.nearest_edges(t.stations, 4), dim, dim, "station_height", ["latitude"])


@query(
    "k20_induced_subgraph",
    f"""WITH m AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS n FROM stations WHERE station_height < 1500)
    SELECT e.src, e.dst, e.distance, a.n AS src_index, b.n AS dst_index FROM ({EDGES_SQL}) e JOIN m a ON a.station_id = e.src JOIN m b ON b.station_id = e.dst""",
    num="distance",
)
def k20(t):
    members = t.stations.filter("station_height < 1500")
    return G.induced_subgraph(G.nearest_edges(t.stations, 4), members, F.substring("station_id", 1, 4))


ROLE_SQL = "CASE WHEN station_height < 1500 THEN 'train' WHEN station_height < 2000 THEN 'val' ELSE 'test' END"


def _pool_sql(bound: float) -> str:
    pool = f"(SELECT * FROM stations WHERE station_height < {bound})"
    d = HAVERSINE_SQL.format(a="a", b="b")
    return f"""SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT a.station_id AS x, b.station_id AS y FROM {pool} a
        JOIN {pool} b ON a.station_id <> b.station_id QUALIFY row_number() OVER (PARTITION BY a.station_id ORDER BY round({d}, 9), b.station_id) <= 3)"""


@query(
    "k21_edge_roles",
    f"""WITH tr AS ({_pool_sql(1500)}), tv AS ({_pool_sql(2000)}), al AS ({_pool_sql(1e9)})
    SELECT a, b, 'train' AS edge_role FROM tr UNION ALL (SELECT a, b, 'val' FROM tv ANTI JOIN tr USING (a, b))
    UNION ALL (SELECT a, b, 'test' FROM al ANTI JOIN tv USING (a, b))""",
)
def k21(t):
    h = F.col("station_height")
    role = F.when(h < 1500, "train").when(h < 2000, "val").otherwise("test")
    return G.edge_roles(t.stations.withColumn("role", role), 3)


NORM_SQL = f"""SELECT e.src, e.dst, e.distance / (max(e.distance) OVER () + 1e-8) AS d, {BEARING_SQL.format(a='a', b='b')} AS brg
    FROM ({EDGES_SQL}) e JOIN stations a ON a.station_id = e.src JOIN stations b ON b.station_id = e.dst"""


def features(t):
    dim = t.stations.withColumnRenamed("station_id", "id")
    return G.edge_features(G.nearest_edges(t.stations, 4), dim, dim)


@query(
    "k22_gaussian_weights",
    f"SELECT src, dst, exp(-(d * d) / 0.04e0) AS weight FROM ({NORM_SQL})",
    num="weight",
)
def k22(t):
    return features(t).select("src", "dst", G.gaussian_weight("dist_norm").alias("weight"))


@query(
    "k22_wind_weights",
    f"""SELECT n.src, n.dst, r.event_id, exp(-d) * greatest(cos(radians(r.wind_direction + 180) - brg), 0) AS weight
    FROM ({NORM_SQL}) n JOIN raw r ON r.station_id = n.src""",
    num="weight",
)
def k22_wind(t):
    flow = t.raw.select("event_id", F.col("station_id").alias("src"), (F.col("wind_direction") + 180.0).alias("flow"))
    rows = features(t).join(flow, "src")
    weight = G.wind_weight("dist_norm", "flow", "sin_brg", "cos_brg")
    return rows.select("src", "dst", "event_id", weight.alias("weight"))


POOL_EDGES_SQL = f"""SELECT DISTINCT src, dst, exp(-distance / 200) AS weight FROM (
    SELECT station_id AS src, near_id AS dst, distance FROM ({STATION_NEAR_SQL}) WHERE rank <= 3
    UNION SELECT near_id, station_id, distance FROM ({STATION_NEAR_SQL}) WHERE rank <= 3)"""


@query(
    "k23_signal_diffusion",
    f"""WITH e AS (SELECT src, dst, weight / greatest(sum(weight) OVER (PARTITION BY src), 1e-8) AS p FROM ({POOL_EDGES_SQL})),
    x AS (SELECT station_id, "timestamp" AS ts, wind_speed AS v FROM ({FILLED_SQL})),
    a AS (SELECT e.dst AS station_id, ts, sum(p * v) AS v FROM x JOIN e ON e.src = x.station_id GROUP BY ALL),
    b AS (SELECT e.dst AS station_id, ts, sum(p * v) AS v FROM a JOIN e ON e.src = a.station_id GROUP BY ALL)
    SELECT x.station_id, x.ts AS "timestamp", x.v AS wind_speed_hop_0, coalesce(a.v, 0) AS wind_speed_hop_1, coalesce(b.v, 0) AS wind_speed_hop_2
    FROM x LEFT JOIN a USING (station_id, ts) LEFT JOIN b USING (station_id, ts)""",
    num="wind_speed_hop_0 wind_speed_hop_1 wind_speed_hop_2",
    ts="timestamp",
)
def k23(t):
    edges = G.nearest_edges(measured(t), 3).select("src", "dst", F.exp(-F.col("distance") / 200.0).alias("weight"))
    return G.diffuse(filled_hourly(t), edges, "wind_speed", 2)
