"""Plan properties that matter at scale."""

import os

import pytest
from pyspark.sql import functions as F

from galeframe.operators import forecasts as FC
from galeframe.operators import neighbours as N
from galeframe.operators import ordering as O
from galeframe.operators import scale as SC
from galeframe.plans.registry import load_all
from galeframe.plans.tables import Tables

FOLDER = f"/root/testdata/sf{os.environ.get('GALEFRAME_TEST_SF', '0.001')}"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    load_all()
    return Tables(spark, FOLDER)


def test_fills_and_as_of_joins_never_window_a_whole_station(tables):
    """Windows run inside a chunk, or over one summary row per chunk."""
    filled = O.fill(tables.hourly, ["station_id"], ["timestamp"], ["wind_speed"], O.day_chunk("timestamp"))
    runs = tables.nwp_raw.select(F.lit("00001").alias("station_id"), "starttime").distinct()
    as_of = O.latest_before(tables.raw, runs, ["station_id"], "timestamp", "starttime", [])
    placed = O.positions(tables.raw, ["station_id"], ["timestamp"], O.day_chunk("timestamp"))
    for plan in map(physical, (filled, as_of, placed)):
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert len(windows) == 2 and all("_chunk" in line for line in windows)


def test_top_rows_are_trimmed_before_the_shuffle(tables):
    for df in (FC.latest_forecast(tables.nwp, ["grid_id"]), N.k_nearest(tables.stations, tables.grid, 3)):
        assert "WindowGroupLimit" in physical(df) and "Partial" in physical(df)


def test_scalers_aggregate_partially(tables):
    plan = physical(SC.fit_scaler(tables.raw, ["wind_speed"]))
    assert "partial_avg" in plan and "partial_stddev_pop" in plan


def test_no_broadcast_hints_and_no_collects():
    import pathlib

    for path in pathlib.Path(__file__).resolve().parents[1].joinpath("galeframe").rglob("*.py"):
        text = path.read_text()
        for word in ("F.broadcast(", ".collect()", ".toPandas()", "crossJoin", "localCheckpoint", ".rdd"):
            assert word not in text, f"{word} in {path.name}"
