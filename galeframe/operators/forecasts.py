"""Joins between forecast runs, a second model and measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.ordering import day_chunk, first_rows, interpolate_linear, positions


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run start, one row."""
    return runs.agg(F.max("starttime").alias("starttime"))


def half_day_run(start: Column | str) -> Column:
    """Newest 00 or 12 UTC run at or before ``start``."""
    start = F.col(start) if isinstance(start, str) else start
    return F.timestamp_seconds(F.floor(F.unix_timestamp(start) / 43200) * 43200)


def join_second_model(
    runs: DataFrame, second: DataFrame, ranks: Sequence[int], speed: str = "ecmwf_wind_speed_h10"
) -> DataFrame:
    """Left join of the second model's newest run at each row's valid time.

    ``second`` has ``rank, starttime, forecasttime, u_wind, v_wind, order_key``; of
    repeated keys the first delivery counts. The run is known from the start time, so
    the as-of join is an equi-join on (run, lead); ranks become columns beforehand and
    one join serves them all.
    """
    key = ["rank", "starttime", "forecasttime"]
    unique = second.groupBy(*key).agg(
        F.min_by(F.sqrt(F.col("u_wind") * F.col("u_wind") + F.col("v_wind") * F.col("v_wind")), "order_key").alias("_v")
    )
    wide = unique.groupBy(
        F.col("starttime").alias("_start"), F.col("forecasttime").cast("bigint").alias("_lead")
    ).agg(*[F.max(F.when(F.col("rank") == r, F.col("_v"))).alias(f"{speed}_{r}") for r in ranks])
    start = half_day_run("starttime")
    valid = F.unix_timestamp("starttime") + F.col("forecasttime") * 3600
    lead = F.floor((valid - F.unix_timestamp("_start")) / 3600)
    keyed = runs.withColumn("_start", start).withColumn("_lead", lead)
    return keyed.join(wide, ["_start", "_lead"], "left").drop("_start", "_lead")


def latest_forecast(runs: DataFrame, by: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """The row with the shortest lead (the newest run) per key and valid time."""
    return first_rows(runs, [*by, ts], ["forecasttime", F.desc("starttime")])


def complete_runs(
    runs: DataFrame, by: Sequence[str], expected: int, lead: str | None = None
) -> DataFrame:
    """Rows of the runs with exactly ``expected`` rows, or distinct leads if ``lead`` is given."""
    size = F.count_distinct(lead) if lead else F.count(F.lit(1))
    whole = runs.groupBy(*by).agg(size.alias("_size")).filter(F.col("_size") == expected)
    return runs.join(whole.drop("_size"), [*by], "left_semi")


def modal_runs(runs: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows of the runs whose length is the most frequent one among ``within``."""
    from galeframe.operators.reshape import smallest_mode

    sizes = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    expected = smallest_mode(sizes, within, "_size", "_expected")
    whole = sizes.join(expected, [*within]).filter(F.col("_size") == F.col("_expected"))
    return runs.join(whole.select(*by), [*by], "left_semi")


def nearest_level(heights: Sequence[float], height: Column | str, target: float) -> Column:
    """Whether ``height`` is the available level closest to ``target`` (lower one on ties)."""
    best = min(heights, key=lambda h: (abs(h - target), h))
    height = F.col(height) if isinstance(height, str) else height
    return F.abs(height - best) <= 0.01


def forecast_at_stations(
    nearest: DataFrame, runs: DataFrame, value: str, target_height: float
) -> DataFrame:
    """Forecast value per station and valid time: nearest node, nearest level, shortest positive lead.

    ``nearest`` maps ``station_id`` to ``grid_id``.
    """
    rows = runs.filter("forecasttime > 0").join(nearest.select("station_id", "grid_id"), "grid_id")
    gap = F.abs(F.col("height") - target_height)
    best = first_rows(rows, ["station_id", "timestamp"], [gap, "height", "forecasttime"])
    return best.select("station_id", "timestamp", "starttime", F.col(value).alias("nwp_ref"))


def filled_latest_forecast(
    runs: DataFrame, by: Sequence[str], cols: Sequence[str], valid: str = "timestamp", start: str = "starttime",
    lead: str = "forecasttime", chunk: Column | None = None,
) -> DataFrame:
    """Shortest-lead row per key and valid time, after gaps of ``cols`` are filled along all runs of a key.

    The rows of a key stand in the order of valid time, lead and start. A gap is interpolated by row position between the
    values around it, whichever run they are from, and the ends repeat the nearest value; then the shortest lead wins (of
    equal ones the newest run). A key may be of any size: positions and neighbours are carried from chunk to chunk.
    """
    placed = positions(runs, by, [valid, lead, start], day_chunk(valid) if chunk is None else chunk, "_pos")
    filled = interpolate_linear(placed, by, "_pos", cols).drop("_pos")
    return first_rows(filled, [*by, valid], [lead, F.desc(start)])
