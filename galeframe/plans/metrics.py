"""Forecast scores and model comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import metrics as M
from galeframe.operators.quantiles import quantile_columns
from galeframe.operators.reshape import fixed_bins, melt
from galeframe.plans.aggregates import POWER_SQL, turbine_power
from galeframe.plans.joins import STATION_FORECAST_SQL, measured, station_forecast
from galeframe.plans.registry import query
from galeframe.plans.series import FILLED_SQL

R2_SQL = "CASE WHEN count(*) >= 2 AND var_pop({y}) > 0 THEN 1 - avg(pow({p} - {y}, 2)) / var_pop({y}) END"
SCORE_SQL = f"""CASE WHEN count(*) >= 2 THEN sqrt(avg(pow(pred - gt, 2))) END AS rmse,
    CASE WHEN count(*) >= 2 THEN avg(abs(pred - gt)) END AS mae, {R2_SQL.format(y='gt', p='pred')} AS r2, count(*) AS n_samples"""


def scored_forecasts(t):
    """Forecast, measurement, persistence and second model per station, run and lead."""
    wind = t.hourly.select("station_id", "timestamp", F.col("wind_speed").alias("gt"))
    rows = station_forecast(t).withColumnRenamed("nwp_speed", "pred").join(wind, ["station_id", "timestamp"])
    before = F.timestamp_seconds(F.unix_timestamp("timestamp") + 3600)
    last = t.hourly.select("station_id", before.alias("starttime"), F.col("wind_speed").alias("pers_ref"))
    from galeframe.operators.forecasts import join_second_model

    rows = rows.join(last, ["station_id", "starttime"], "left")
    second = t.ec.withColumnRenamed("point", "rank")
    return join_second_model(rows, second, [0, 1, 2], speed="second")


SCORED_SQL = f"""SELECT f.station_id, f.starttime, f.forecasttime, f.height, f.nwp_speed AS pred, h.wind_speed AS gt, b.wind_speed AS pers_ref,
        e.v0 AS second_0, e.v1 AS second_1, e.v2 AS second_2
    FROM ({STATION_FORECAST_SQL}) f JOIN hourly h ON h.station_id = f.station_id AND h."timestamp" = f."timestamp"
    LEFT JOIN hourly b ON b.station_id = f.station_id AND b."timestamp" = f.starttime - INTERVAL 1 HOUR
    LEFT JOIN (SELECT starttime, forecasttime, {', '.join(f"arg_min(sqrt(u_wind * u_wind + v_wind * v_wind), order_key) FILTER (point = {p}) AS v{p}" for p in range(3))}
        FROM ec GROUP BY ALL) e
        ON e.starttime = date_trunc('day', f.starttime) + to_hours(CASE WHEN hour(f.starttime) >= 12 THEN 12 ELSE 0 END)
        AND e.forecasttime = date_diff('hour', e.starttime, f.starttime) + CAST(f.forecasttime AS BIGINT)"""


@query(
    "m06_station_skill",
    f"""SELECT station_id, height, CASE WHEN count(gt) >= 2 THEN sqrt(avg(pow(pred - gt, 2))) END AS rmse,
        CASE WHEN count(gt) >= 2 THEN avg(abs(pred - gt)) END AS mae,
        CASE WHEN count(gt) >= 2 AND var_pop(gt) > 0 THEN 1 - avg(pow(pred - gt, 2)) / var_pop(gt) END AS r2, count(gt) AS n_samples,
        1 - sqrt(avg(pow(pred - gt, 2))) / nullif(sqrt(avg(pow(pers_ref - gt, 2))), 0) AS skill,
        {', '.join(f"1 - sqrt(avg(pow(pred - gt, 2))) / nullif(sqrt(avg(pow(second_{p} - gt, 2))), 0) AS skill_second_{p}" for p in range(3))}
    FROM ({SCORED_SQL}) GROUP BY ALL""",
    num="rmse mae r2 skill skill_second_0 skill_second_1 skill_second_2",
)
def m06(t):
    second = {f"skill_second_{p}": f"second_{p}" for p in range(3)}
    return M.score(scored_forecasts(t), ["station_id", "height"], skill="pers_ref", **second)


@query("m01_pooled_scores", f"SELECT {SCORE_SQL} FROM predictions", num="rmse mae r2")
def m01(t):
    return M.score(t.predictions, [])


@query(
    "m02_detailed_scores",
    """SELECT station_id, avg(sqrt(mse)) AS mean_step_rmse, 1 - sum(mse * n) / nullif(sum(v * n), 0) AS weighted_r2 FROM (
        SELECT station_id, horizon, avg(pow(pred - gt, 2)) AS mse, var_pop(gt) AS v, count(*) AS n FROM predictions GROUP BY ALL) GROUP BY ALL""",
    num="mean_step_rmse weighted_r2",
)
def m02(t):
    return M.detailed(t.predictions, ["station_id"], "horizon")


@query("m03_scores_per_horizon", f"SELECT horizon, {SCORE_SQL} FROM predictions GROUP BY ALL", num="rmse mae r2")
def m03(t):
    return M.score(t.predictions, ["horizon"])


@query(
    "m04_skill",
    """SELECT station_id, 1 - sqrt(avg(pow(pred - gt, 2))) / nullif(sqrt(avg(pow(pers_ref - gt, 2))), 0) AS skill,
        1 - sqrt(avg(pow(pred - gt, 2))) / nullif(sqrt(avg(pow(nwp_ref - gt, 2))), 0) AS skill_nwp FROM predictions GROUP BY ALL""",
    num="skill skill_nwp",
)
def m04(t):
    return t.predictions.groupBy("station_id").agg(
        M.skill("gt", "pred", "pers_ref").alias("skill"), M.skill("gt", "pred", "nwp_ref").alias("skill_nwp")
    )


@query(
    "m05_persistence_reference",
    f"SELECT station_id, starttime, forecasttime, height, gt, pers_ref FROM ({SCORED_SQL})",
    num="gt pers_ref",
    ts="starttime",
)
def m05(t):
    return scored_forecasts(t).select("station_id", "starttime", "forecasttime", "height", "gt", "pers_ref")


@query(
    "m07_r2_per_run_and_station",
    f"SELECT run_time, station_id, {R2_SQL.format(y='gt', p='pred')} AS r2 FROM predictions GROUP BY ALL",
    num="r2",
    ts="run_time",
)
def m07(t):
    # one row per station: as columns, stations would have to be known and few
    return t.predictions.groupBy("run_time", "station_id").agg(M.r2("gt", "pred").alias("r2"))


@query(
    "m08_pooled_and_station_mean",
    """SELECT (SELECT sqrt(avg(pow(pred - gt, 2))) FROM predictions) AS pooled_rmse, avg(r) AS station_rmse
    FROM (SELECT sqrt(avg(pow(pred - gt, 2))) AS r FROM predictions GROUP BY station_id)""",
    num="pooled_rmse station_rmse",
)
def m08(t):
    pooled = t.predictions.agg(M.rmse("gt", "pred").alias("r")).scalar()
    stations = t.predictions.groupBy("station_id").agg(M.rmse("gt", "pred").alias("r"))
    return stations.agg(F.avg("r").alias("station_rmse")).select(pooled.alias("pooled_rmse"), "station_rmse")


CLASS_SQL = "CASE WHEN gt >= 8 THEN 4 WHEN gt >= 6 THEN 3 WHEN gt >= 4 THEN 2 WHEN gt >= 2 THEN 1 WHEN gt >= 0 THEN 0 END"


@query(
    "m09_stratified_scores",
    f"""SELECT CAST(month(run_time) AS INTEGER) AS "month", {CLASS_SQL} AS speed_class, horizon, {SCORE_SQL} FROM predictions GROUP BY ALL""",
    num="rmse mae r2",
)
def m09(t):
    rows = t.predictions.withColumns(
        {"month": F.month("run_time"), "speed_class": fixed_bins("gt", [0, 2, 4, 6, 8])}
    )
    return M.score(rows, ["month", "speed_class", "horizon"])


@query(
    "m10_bias_and_correlation",
    """SELECT station_id, horizon, avg(pred - gt) AS bias, corr(gt, pred) AS r, count(*) AS n FROM predictions GROUP BY ALL HAVING count(*) >= 10""",
    num="bias r",
)
def m10(t):
    out = t.predictions.groupBy("station_id", "horizon").agg(
        M.bias("gt", "pred").alias("bias"), F.corr("gt", "pred").alias("r"), M.samples("gt", "pred").alias("n")
    )
    return out.filter("n >= 10")


@query(
    "m11_error_box_statistics",
    f"""SELECT {CLASS_SQL} AS speed_class, quantile_cont(abs(pred - gt), 0.25) AS q25, quantile_cont(abs(pred - gt), 0.5) AS q50,
        quantile_cont(abs(pred - gt), 0.75) AS q75 FROM predictions GROUP BY ALL""",
    num="q25 q50 q75",
)
def m11(t):
    rows = t.predictions.select(
        fixed_bins("gt", [0, 2, 4, 6, 8]).alias("speed_class"), F.abs(F.col("pred") - F.col("gt")).alias("error")
    )
    return quantile_columns(rows, ["speed_class"], "error", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


@query(
    "m12_pinball_loss",
    """SELECT horizon, avg(greatest((0.1e0 - 1) * (gt - pred), 0.1e0 * (gt - pred))) AS q10,
        avg(greatest((0.9e0 - 1) * (gt - pred), 0.9e0 * (gt - pred))) AS q90 FROM predictions GROUP BY ALL""",
    num="q10 q90",
)
def m12(t):
    return t.predictions.groupBy("horizon").agg(
        M.pinball("gt", "pred", 0.1).alias("q10"), M.pinball("gt", "pred", 0.9).alias("q90")
    )


@query(
    "m13_horizon_weighted_loss",
    """SELECT station_id, avg(w * e * e) AS weighted_mse, avg(w * abs(e)) AS weighted_mae,
        avg(w * CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END) AS weighted_huber FROM (
        SELECT station_id, pred - gt AS e, 7 * pow(0.9e0, horizon - 1) / (SELECT sum(pow(0.9e0, i)) FROM range(7) r(i)) AS w FROM predictions) GROUP BY ALL""",
    num="weighted_mse weighted_mae weighted_huber",
)
def m13(t):
    return M.horizon_weighted(t.predictions, ["station_id"], "horizon", 7, 0.9)


@query(
    "m14_regression_persistence",
    """WITH l AS (SELECT station_id, "timestamp", wind_speed AS y, lag(wind_speed, 2) OVER (PARTITION BY station_id ORDER BY "timestamp") AS x FROM hourly),
    m AS (SELECT station_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE "timestamp" < TIMESTAMP '2024-01-20' GROUP BY ALL)
    SELECT l.station_id, l."timestamp", m.a + m.b * l.x AS pred FROM l JOIN m USING (station_id) WHERE l."timestamp" >= TIMESTAMP '2024-01-20' AND l.x IS NOT NULL AND l.y IS NOT NULL""",
    num="pred",
    ts="timestamp",
)
def m14(t):
    from galeframe.operators.regression import fit_line
    from galeframe.operators.sequences import lag_features
    from galeframe.plans.series import numbered
    from galeframe.plans.splits import at

    rows = lag_features(numbered(t), ["station_id"], "pos", "wind_speed", [2]).na.drop(subset=["wind_speed", "wind_speed_lag_2"])
    early = F.col("timestamp") < F.lit(at(20)).cast("timestamp")
    line = fit_line(rows.filter(early), ["station_id"], "wind_speed", "wind_speed_lag_2")
    out = rows.filter(~early).join(line, "station_id")
    return out.select("station_id", "timestamp", (F.col("intercept") + F.col("slope") * F.col("wind_speed_lag_2")).alias("pred"))


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _lags_sql() -> str:
    """Normal equations of three lags, solved by determinants."""
    cov = [[f"v{min(i, j)}{max(i, j)}" for j in (1, 2, 3)] for i in (1, 2, 3)]
    own = [f"c{i}" for i in (1, 2, 3)]
    swap = lambda k: [[own[i] if j == k else cov[i][j] for j in range(3)] for i in range(3)]
    slopes = ", ".join(f"{_det(swap(k))} / {_det(cov)} AS b{k + 1}" for k in range(3))
    moments = ", ".join(f"covar_pop(x{i}, x{j}) AS v{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    moments += "".join(f", covar_pop(x{i}, y) AS c{i}, avg(x{i}) AS m{i}" for i in (1, 2, 3))
    lags = ", ".join(f'lag(wind_speed, {n}) OVER (PARTITION BY station_id ORDER BY "timestamp") AS x{n}' for n in (1, 2, 3))
    return f"""WITH l AS (SELECT station_id, "timestamp", wind_speed AS y, {lags} FROM ({FILLED_SQL})),
    k AS (SELECT * FROM l WHERE x1 + x2 + x3 + y IS NOT NULL),
    m AS (SELECT station_id, avg(y) AS my, {moments} FROM k WHERE "timestamp" < TIMESTAMP '2024-01-20' GROUP BY ALL),
    b AS (SELECT *, {slopes} FROM m)
    SELECT k.station_id, k."timestamp", round(my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3) + 1.7e-5, 3) AS pred
    FROM k JOIN b USING (station_id) WHERE k."timestamp" >= TIMESTAMP '2024-01-20'"""


@query("m14_regression_on_several_lags", _lags_sql(), num="pred", ts="timestamp")
def m14_many(t):
    from galeframe.operators.regression import fit_predict
    from galeframe.operators.sequences import lag_features
    from galeframe.plans.series import filled_hourly, numbered
    from galeframe.plans.splits import at

    lags = [1, 2, 3]
    names = [f"wind_speed_lag_{n}" for n in lags]
    rows = lag_features(numbered(t, filled_hourly(t)), ["station_id"], "pos", "wind_speed", lags).na.drop(subset=["wind_speed", *names])
    early = F.col("timestamp") < F.lit(at(20)).cast("timestamp")
    out = fit_predict(rows.filter(early), rows.filter(~early), ["station_id"], "wind_speed", names)
    return out.select("station_id", "timestamp", F.round(F.col("prediction") + 1.7e-5, 3).alias("pred"))


@query(
    "m15_physical_persistence",
    f"""SELECT p.station_id, sqrt(avg(pow(h.wind_speed / 5 - least(greatest(power / c, 0), 1), 2))) AS rmse,
        avg(abs(h.wind_speed / 5 - least(greatest(power / c, 0), 1))) AS mae
    FROM (SELECT *, max(power) OVER (PARTITION BY station_id) AS c FROM ({POWER_SQL})) p
    JOIN hourly h ON h.station_id = p.station_id AND h."timestamp" = p.hour GROUP BY ALL""",
    num="rmse mae",
)
def m15(t):
    from galeframe.functions.physics import scaled_power
    from galeframe.operators.reshape import capacity

    power = turbine_power(t)
    sized = power.join(capacity(power, ["station_id"], "hour", "power"), "station_id")
    physical = sized.select("station_id", F.col("hour").alias("timestamp"), scaled_power("power", "capacity").alias("pred"))
    rows = t.hourly.join(physical, ["station_id", "timestamp"]).withColumn("gt", F.col("wind_speed") / 5.0)
    return rows.groupBy("station_id").agg(M.rmse("gt", "pred").alias("rmse"), M.mae("gt", "pred").alias("mae"))


def station_rmse(t, pred, name="rmse"):
    return t.predictions.groupBy("station_id").agg(M.rmse("gt", pred).alias(name))


RMSE_SQL = "SELECT station_id, sqrt(avg(pow({p} - gt, 2))) AS rmse FROM predictions GROUP BY ALL"


@query(
    "m16_model_deltas",
    f"""WITH b AS (SELECT station_id, a.rmse AS model, r.rmse AS reference, a.rmse - r.rmse AS delta, (a.rmse - r.rmse) / nullif(r.rmse, 0) AS relative_delta
        FROM ({RMSE_SQL.format(p='pred')}) a JOIN ({RMSE_SQL.format(p='nwp_ref')}) r USING (station_id))
    SELECT * FROM b UNION ALL SELECT 'mean', avg(model), avg(reference), avg(delta), avg(delta) / nullif(avg(reference), 0) FROM b
    UNION ALL SELECT 'std', stddev_samp(model), stddev_samp(reference), stddev_samp(delta), stddev_samp(relative_delta) FROM b""",
    num="model reference delta relative_delta",
)
def m16(t):
    return M.model_deltas(station_rmse(t, "pred"), station_rmse(t, "nwp_ref"), "station_id", "rmse")


@query(
    "m17_model_disagreement",
    """SELECT station_id, run_time, round((abs(a - b) + abs(b - c) + abs(a - c)) / 3, 9) AS diff FROM (
        SELECT station_id, run_time, avg(pred) AS a, avg(nwp_ref) AS b, avg(pers_ref) AS c FROM predictions GROUP BY ALL)
    ORDER BY diff DESC, station_id, run_time LIMIT 20""",
    num="diff",
    ts="run_time",
)
def m17(t):
    runs = t.predictions.groupBy("station_id", "run_time").agg(
        F.avg("pred").alias("a"), F.avg("nwp_ref").alias("b"), F.avg("pers_ref").alias("c")
    )
    return M.disagreement(runs, ["a", "b", "c"]).orderBy(F.desc("diff"), "station_id", "run_time").select(
        "station_id", "run_time", "diff").limit(20)


DELTA_SQL = "SELECT station_id, horizon, round(avg(abs(pred - gt)) - avg(abs(nwp_ref - gt)), 6) AS d FROM predictions GROUP BY ALL"


@query(
    "m18_signed_rank",
    f"""WITH d AS (SELECT d, abs(d) AS m FROM ({DELTA_SQL}) WHERE d <> 0),
    r AS (SELECT d, m, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2e0 AS k, count(*) OVER (PARTITION BY m) AS c FROM d),
    s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_plus, sum(pow(c, 2) - 1) AS ties FROM r),
    z AS (SELECT n, w_plus, (w_plus - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0) AS z FROM s),
    t AS (SELECT *, 1 / (1 + 0.2316419e0 * abs(z)) AS t FROM z),
    q AS (SELECT *, t * (0.31938153e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * (-1.821255978e0 + t * 1.330274429e0)))) * exp(-z * z / 2) / sqrt(2 * pi()) AS q FROM t)
    SELECT n, w_plus, z, CASE WHEN z >= 0 THEN q ELSE 1 - q END AS p_value FROM q""",
    num="w_plus z p_value",
)
def m18(t):
    delta = t.predictions.groupBy("station_id", "horizon").agg(
        F.round(M.mae("gt", "pred") - M.mae("gt", "nwp_ref"), 6).alias("d")
    )
    return M.signed_rank(delta, "d", lambda m: F.floor(m * 1000)).drop("exact")


LEAD_SQL = """SELECT horizon, avg(abs(pred - gt)) AS y, avg(abs(nwp_ref - gt)) AS x FROM predictions GROUP BY ALL"""


@query(
    "m18_signed_rank_exact",
    f"""WITH l AS ({LEAD_SQL}), d AS (SELECT 'absolute' AS kind, round(y - x, 6) AS d FROM l UNION ALL SELECT 'relative', round(y / x - 1, 6) FROM l),
    r AS (SELECT kind, d, CAST(rank() OVER (PARTITION BY kind ORDER BY abs(d)) AS INTEGER) AS k FROM d),
    s AS (SELECT kind, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w FROM r GROUP BY kind),
    m AS (SELECT unnest(generate_series(0, 127)) AS m),
    e AS (SELECT m, list_sum(list_transform(generate_series(0, 6), lambda i: CASE WHEN (m >> i) % 2 = 1 THEN i + 1 ELSE 0 END)) AS w FROM m)
    SELECT kind, n, CAST(s.w AS DOUBLE) AS w_plus, (SELECT avg(CASE WHEN e.w >= s.w THEN 1e0 ELSE 0e0 END) FROM e) AS p_value, true AS exact FROM s""",
    num="w_plus p_value",
)
def m18_exact(t):
    leads = t.predictions.groupBy("horizon").agg(M.mae("gt", "pred").alias("y"), M.mae("gt", "nwp_ref").alias("x"))
    out = []
    for kind, delta in (("absolute", F.col("y") - F.col("x")), ("relative", F.col("y") / F.col("x") - 1)):
        tested = M.signed_rank(leads.select(F.round(delta, 6).alias("d")), "d", lambda m: F.floor(m * 1000))
        out.append(tested.select(F.lit(kind).alias("kind"), "n", "w_plus", "p_value", "exact"))
    return out[0].unionByName(out[1])


@query(
    "m19_win_share",
    f"""SELECT avg(CASE WHEN a.rmse < r.rmse THEN 1e0 ELSE 0e0 END) AS better, count(*) AS n
    FROM ({RMSE_SQL.format(p='pred')}) a JOIN ({RMSE_SQL.format(p='nwp_ref')}) r USING (station_id)""",
    num="better",
)
def m19(t):
    both = station_rmse(t, "pred", "a").join(station_rmse(t, "nwp_ref", "b"), "station_id")
    return both.agg(F.avg((F.col("a") < F.col("b")).cast("double")).alias("better"), F.count(F.lit(1)).alias("n"))


@query(
    "m20_feature_weights",
    """SELECT feature_type, feature_name, avg_weight, CAST(row_number() OVER (PARTITION BY feature_type ORDER BY round(avg_weight, 9) DESC, feature_name) AS INTEGER) AS rank
    FROM (SELECT feature_type, feature_name, avg(avg_weight) AS avg_weight FROM weights GROUP BY ALL)""",
    num="avg_weight",
)
def m20(t):
    from galeframe.operators.ordering import ranked

    # one row per feature name is left, a short list
    means = t.weights.groupBy("feature_type", "feature_name").agg(F.avg("avg_weight").alias("avg_weight"))
    best_first = [F.round("avg_weight", 9).desc(), "feature_name"]
    return ranked(means, ["feature_type"], best_first, "rank")


@query(
    "m21_consolidated_results",
    """WITH m AS (SELECT station_id AS "key", horizon AS output_dim, sqrt(avg(pow(pred - gt, 2))) AS rmse FROM predictions GROUP BY ALL),
    p AS (SELECT station_id AS "key", horizon AS output_dim, sqrt(avg(pow(pers_ref - gt, 2))) AS rmse_p FROM predictions GROUP BY ALL)
    SELECT output_dim, avg(rmse) AS rmse, avg(1 - rmse / nullif(rmse_p, 0)) AS skill FROM m LEFT JOIN p USING ("key", output_dim) GROUP BY ALL""",
    num="rmse skill",
)
def m21(t):
    keys = ["key", "output_dim"]
    rows = t.predictions.withColumnsRenamed({"station_id": "key", "horizon": "output_dim"})
    results = rows.groupBy(*keys).agg(M.rmse("gt", "pred").alias("rmse"))
    persistence = rows.groupBy(*keys).agg(M.rmse("gt", "pers_ref").alias("rmse"))
    return M.consolidate(results, persistence, keys, ["output_dim"])


@query(
    "m22_metrics_on_the_map",
    f"""SELECT s.station_id, s.latitude, s.longitude, s.station_height, m.rmse FROM ({RMSE_SQL.format(p='pred')}) m JOIN stations s USING (station_id)""",
    num="latitude longitude station_height rmse",
)
def m22(t):
    return station_rmse(t, "pred").join(t.stations, "station_id")


@query(
    "m23_in_sample_means",
    f"""SELECT CASE WHEN station_id IN (SELECT station_id FROM raw) THEN 'in_sample' ELSE 'out_of_sample' END AS seen,
        avg(rmse) AS rmse, count(*) AS n FROM ({RMSE_SQL.format(p='pred')}) GROUP BY ALL""",
    num="rmse",
)
def m23(t):
    train = t.raw.select("station_id").distinct().withColumn("_in", F.lit(True))
    rows = station_rmse(t, "pred").join(train, "station_id", "left")
    seen = F.when(F.col("_in"), "in_sample").otherwise("out_of_sample")
    return rows.groupBy(seen.alias("seen")).agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(
    "m24_prediction_table",
    """SELECT grid_id, height, starttime, CAST(forecasttime AS INTEGER) AS horizon,
        starttime + to_hours(CAST(forecasttime AS INTEGER)) AS valid_time, u_wind AS pred, v_wind AS gt FROM nwp""",
    num="pred gt",
    ts="starttime valid_time",
)
def m24(t):
    step = F.struct("forecasttime", "u_wind", "v_wind")
    keys = ["grid_id", "height", "starttime"]
    runs = t.nwp.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("s"))
    runs = runs.select(*keys, F.col("s.forecasttime").alias("leads"), F.col("s.u_wind").alias("pred"), F.col("s.v_wind").alias("gt"))
    return M.prediction_table(runs, keys, "leads", ["pred", "gt"])
