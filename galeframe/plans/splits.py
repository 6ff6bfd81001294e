"""Splits and folds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from galeframe.operators import forecasts as FC
from galeframe.operators import splits as SP
from galeframe.operators.ordering import day_chunk, minute_chunk
from galeframe.plans.registry import query

STATION = ["station_id"]


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, tzinfo=timezone.utc)


@query(
    "j01_split_at",
    """SELECT event_id, CASE WHEN "timestamp" <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE THEN 'train'
        WHEN "timestamp" >= TIMESTAMP '2024-01-20' AND "timestamp" <= TIMESTAMP '2024-01-28' THEN 'test' END AS role FROM raw""",
)
def j01(t):
    return t.raw.select("event_id", SP.split_at("timestamp", at(20), at(28)).alias("role"))


@query(
    "j01_split_by_fraction",
    """WITH p AS (SELECT station_id, "timestamp", row_number() OVER o AS p, count(*) OVER (PARTITION BY station_id) AS n
        FROM hourly WINDOW o AS (PARTITION BY station_id ORDER BY "timestamp")),
    b AS (SELECT station_id, date_trunc('day', "timestamp") + INTERVAL 6 HOUR AS test_start FROM p WHERE p = floor(n * 0.75))
    SELECT h.station_id, h."timestamp", CASE WHEN h."timestamp" <= test_start - INTERVAL 15 MINUTE THEN 'train' ELSE 'test' END AS role
    FROM hourly h JOIN b USING (station_id)""",
    ts="timestamp",
)
def j01_fraction(t):
    edge = SP.fraction_boundary(t.hourly, STATION, "timestamp", 0.75, day_chunk("timestamp"), hour=6)
    role = SP.split_at("timestamp", F.col("test_start"))
    return t.hourly.join(edge, "station_id").select("station_id", "timestamp", role.alias("role"))


@query(
    "j01_split_runs",
    """SELECT grid_id, starttime, CASE WHEN starttime < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS role, count(*) AS n
    FROM nwp GROUP BY ALL""",
    ts="starttime",
)
def j01_runs(t):
    role = SP.split_runs_at("starttime", at(20)).alias("role")
    return t.nwp.groupBy("grid_id", "starttime", role).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j02_history_before_test",
    """SELECT DISTINCT starttime, starttime - INTERVAL 36 HOUR AS data_start FROM nwp""",
    ts="starttime data_start",
)
def j02(t):
    return t.nwp.select("starttime", SP.history_start("starttime", 36).alias("data_start")).distinct()


FOLD_SQL = """SELECT *, CASE WHEN p - 1 - (n - {k} * (n // {k1})) >= 0
    THEN CAST((p - 1 - (n - {k} * (n // {k1}))) // (n // {k1}) AS INTEGER) END AS val_fold FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS p, count(*) OVER (PARTITION BY {by}) AS n FROM {source})"""
ROLES_SQL = """SELECT s.{key}, f.fold, CASE WHEN s.val_fold = f.fold THEN 'val' ELSE 'train' END AS role
    FROM ({folds}) s CROSS JOIN (SELECT CAST(unnest(range({k})) AS INTEGER) AS fold) f WHERE coalesce(s.val_fold, 0) <= f.fold"""
TIME_ORDER = 'station_id, "timestamp", event_id'


@query(
    "j03_time_series_folds",
    ROLES_SQL.format(key="event_id", k=4, folds=FOLD_SQL.format(
        k=4, k1=5, by="station_id", order='"timestamp", event_id', source="raw")),
)
def j03(t):
    folds = SP.time_series_folds(t.raw, STATION, ["timestamp", "event_id"], 4, day_chunk("timestamp"))
    return SP.fold_roles(folds, 4).select("event_id", "fold", "role")


@query(
    "j04_folds_after_training_block",
    f"""SELECT event_id, val_fold FROM ({FOLD_SQL.format(k=3, k1=4, by='station_id', order='"timestamp"',
        source="(SELECT * FROM raw WHERE \"timestamp\" > TIMESTAMP '2024-01-10')")})
    UNION ALL SELECT event_id, NULL FROM raw WHERE "timestamp" <= TIMESTAMP '2024-01-10'""",
    num="val_fold",
)
def j04(t):
    out = SP.folds_with_training_block(t.raw, STATION, "timestamp", at(10), 3, day_chunk("timestamp"))
    return out.select("event_id", "val_fold")


@query(
    "j05_holdout_station_folds",
    """SELECT event_id, CASE WHEN least((p - 1) // (n // 5), 4) >= 1 THEN least((p - 1) // (n // 5), 4) - 1 END AS val_fold FROM (
        SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS p, count(*) OVER () AS n FROM raw
        WHERE station_id IN (SELECT station_id FROM stations WHERE station_height < 1200))""",
    num="val_fold",
)
def j05(t):
    held = t.raw.join(t.stations.filter("station_height < 1200"), "station_id", "left_semi")
    return SP.holdout_folds(held, ["timestamp", "event_id"], 4, minute_chunk("timestamp")).select("event_id", "val_fold")


@query(
    "j06_duration_folds",
    """SELECT event_id, CASE WHEN f BETWEEN 0 AND 2 THEN f END AS val_fold FROM (SELECT event_id,
        floor((epoch_us("timestamp") // 1000000 - epoch(TIMESTAMP '2024-01-02')) * 4 / (23 * 86400)) - 1 AS f FROM raw)""",
    num="val_fold",
)
def j06(t):
    return t.raw.select("event_id", SP.duration_fold("timestamp", at(2), at(25), 3).alias("val_fold"))


@query(
    "j07_fraction_holdout",
    """SELECT event_id, CASE WHEN p <= floor(n * (1 - 0.2e0)) THEN 'train' ELSE 'val' END AS role FROM (SELECT event_id,
        row_number() OVER (PARTITION BY station_id ORDER BY "timestamp", event_id) AS p, count(*) OVER (PARTITION BY station_id) AS n FROM raw)""",
)
def j07(t):
    out = SP.fraction_holdout(t.raw, STATION, ["timestamp", "event_id"], 0.2, day_chunk("timestamp"))
    return out.select("event_id", "role")


@query(
    "j08_retrain_periods",
    """WITH r AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', INTERVAL 1 HOUR)) AS ts),
    p AS (SELECT ts, 6 - ntile(7) OVER (ORDER BY ts DESC) + 1 AS period FROM r)
    SELECT h.station_id, h."timestamp", p.period FROM hourly h LEFT JOIN p ON p.ts = h."timestamp" """,
    num="period",
    ts="timestamp",
)
def j08(t):
    period = SP.retrain_period("timestamp", at(5), at(25), 3600, 7)
    return t.hourly.select("station_id", "timestamp", period.alias("period"))


CLIENT_SQL = """(SELECT r.*, 'client_' || CAST(CAST(floor(latitude) AS INTEGER) % 3 AS VARCHAR) AS client_id FROM raw r JOIN stations USING (station_id))"""


@query(
    "j09_client_folds",
    f"""SELECT event_id, client_id, val_fold FROM ({FOLD_SQL.format(k=3, k1=4, by='client_id',
        order='"timestamp", event_id', source=CLIENT_SQL)})""",
    num="val_fold",
)
def j09(t):
    client = F.concat(F.lit("client_"), (F.floor("latitude") % 3).cast("string"))
    clients = t.stations.select("station_id", client.alias("client_id"))
    out = SP.client_folds(t.raw, clients, ["timestamp", "event_id"], 3, minute_chunk("timestamp"))
    return out.select("event_id", "client_id", "val_fold")


@query(
    "j10_complete_runs",
    """SELECT grid_id, starttime, forecasttime, height, u_wind FROM nwp
    WHERE (grid_id, starttime) IN (SELECT (grid_id, starttime) FROM nwp GROUP BY grid_id, starttime HAVING count(DISTINCT forecasttime) = 7)""",
    num="u_wind",
    ts="starttime",
)
def j10(t):
    runs = FC.complete_runs(t.nwp, ["grid_id", "starttime"], 7, lead="forecasttime")
    return runs.select("grid_id", "starttime", "forecasttime", "height", "u_wind")


@query(
    "j10_modal_runs",
    """WITH s AS (SELECT grid_id, starttime, count(*) AS n FROM nwp GROUP BY ALL),
    g AS (SELECT grid_id, n, count(*) AS c FROM s GROUP BY ALL),
    c AS (SELECT grid_id, n FROM g QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY c DESC, n) = 1)
    SELECT s.grid_id, s.starttime, s.n FROM s JOIN c ON s.grid_id = c.grid_id AND s.n = c.n""",
    ts="starttime",
)
def j10_modal(t):
    runs = FC.modal_runs(t.nwp, ["grid_id", "starttime"], ["grid_id"])
    return runs.groupBy("grid_id", "starttime").agg(F.count(F.lit(1)).alias("n"))


DRAW_SQL = "CAST('0x' || substring(md5('{seed}|' || r), 1, 15) AS BIGINT)"
STEPS_SQL = ", ".join(DRAW_SQL.format(seed=9 + i) + " % size" for i in range(16))
MASK_SQL = f"""WITH u AS (SELECT DISTINCT strftime(starttime, '%Y-%m-%d %H:%M:%S') AS r FROM nwp), s AS (SELECT count(*) AS size FROM stations),
    c AS (SELECT station_id, row_number() OVER (ORDER BY md5('7|' || station_id), station_id) - 1 AS p FROM stations),
    w AS (SELECT r, size, 2 + {DRAW_SQL.format(seed=7)} % 4 AS n, {DRAW_SQL.format(seed=8)} % size AS a,
        coalesce(list_filter([{STEPS_SQL}], lambda x: gcd(x, size) = 1)[1], 1) AS step FROM u CROSS JOIN s),
    i AS (SELECT *, unnest(range(least(n + 6, size))) AS i FROM w)
    SELECT r AS starttime, station_id, CASE WHEN i < n THEN 'target' ELSE 'neighbour' END AS role FROM i JOIN c ON c.p = (a + i * step) % size"""


@query("j11_masked_targets", MASK_SQL)
def j11(t):
    runs = t.nwp.select(F.date_format("starttime", "yyyy-MM-dd HH:mm:ss").alias("starttime")).distinct()
    return SP.mask_targets(runs, t.stations, "starttime", 2, 5, 6, seed=7)


TARGETS_SQL = MASK_SQL.replace("least(n + 6, size)", "least(n, size)")


@query(
    "j11_masked_targets_and_nearest",
    f"""WITH t AS ({TARGETS_SQL}), d AS (SELECT t.starttime, s.station_id, min(sqrt(pow(s.latitude - x.latitude, 2) + pow(s.longitude - x.longitude, 2))) AS d
        FROM t JOIN stations x ON x.station_id = t.station_id CROSS JOIN stations s
        WHERE (t.starttime, s.station_id) NOT IN (SELECT (starttime, station_id) FROM t) GROUP BY ALL)
    SELECT * FROM t UNION ALL SELECT starttime, station_id, 'neighbour' FROM d
    QUALIFY row_number() OVER (PARTITION BY starttime ORDER BY round(d, 9), station_id) <= 6""",
)
def j11_nearest(t):
    runs = t.nwp.select(F.date_format("starttime", "yyyy-MM-dd HH:mm:ss").alias("starttime")).distinct()
    return SP.mask_targets_and_nearest(runs, t.stations, "starttime", 2, 5, 6, seed=7)


@query(
    "j12_turbine_assignment",
    """SELECT s.station_id, p.p_partkey AS number, 40e0 + p.p_size AS hub_height FROM (
        SELECT station_id, CAST('0x' || substring(md5('11|' || station_id), 1, 15) AS BIGINT) % (SELECT count(*) FROM part) AS k FROM stations) s
    JOIN part p ON p.p_partkey = s.k""",
    num="hub_height",
)
def j12(t):
    turbines = t.table("part").select(F.col("p_partkey").alias("number"), (40.0 + F.col("p_size")).alias("hub_height"))
    return SP.assign_turbines(t.stations, turbines, 11).select("station_id", "number", "hub_height")


@query(
    "j13_fold_table",
    """SELECT event_id, fold, role FROM raw JOIN (VALUES
        (0, 'train', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08'), (0, 'val', TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-12'),
        (1, 'train', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16'), (1, 'val', TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-20'))
        f(fold, role, a, b) ON "timestamp" >= a AND "timestamp" <= b""",
)
def j13(t):
    folds = [(0, at(1), at(8), at(9), at(12)), (1, at(1), at(16), at(17), at(20))]
    rows = t.raw.select("event_id", F.explode(SP.fold_table("timestamp", folds)).alias("f"))
    return rows.select("event_id", F.col("f.fold").alias("fold"), F.col("f.role").alias("role"))
