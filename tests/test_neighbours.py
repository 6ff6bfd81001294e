"""Cell joins equal brute force, on even, clustered and duplicated points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.operators import neighbours as N
from galeframe.operators.kriging import _haversine

RNG = np.random.default_rng(11)


def points(kind: str, n: int) -> pd.DataFrame:
    if kind == "even":
        lat, lon = RNG.uniform(47, 55, n), RNG.uniform(6, 15, n)
    elif kind == "clustered":  # a third within a few hundred metres, the rest over the globe
        lat = np.where(np.arange(n) % 3 == 0, 50 + RNG.normal(0, 1e-3, n), RNG.uniform(-89, 89, n))
        lon = np.where(np.arange(n) % 3 == 0, 8 + RNG.normal(0, 1e-3, n), RNG.uniform(-180, 180, n))
    else:  # few positions, many points each; poles and the date line included
        spots = np.array([[90, 0], [-90, 10], [0, 180], [0, -179.9], [50, 8], [50.2, 8]])
        lat, lon = spots[RNG.integers(0, len(spots), n)].T
    return pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon})


def brute(targets, candidates, k, metric, exclude):
    out = {}
    for t in targets.itertuples():
        if metric == "haversine":
            d = _haversine(t.latitude, t.longitude, candidates["latitude"].to_numpy(), candidates["longitude"].to_numpy())
        else:
            d = np.hypot(t.latitude - candidates["latitude"], t.longitude - candidates["longitude"]).to_numpy()
        ids = candidates["id"].to_numpy()
        order = [i for i in np.lexsort((ids, d.round(9))) if not (exclude and ids[i] == t.id)]
        out[t.id] = d[order[:k]]
    return out


@pytest.mark.parametrize("kind", ["even", "clustered", "piled"])
@pytest.mark.parametrize("metric", ["haversine", "degrees"])
@pytest.mark.parametrize("exclude", [False, True])
def test_k_nearest(spark, kind, metric, exclude):
    candidates = points(kind, 90)
    targets = candidates.iloc[:40] if exclude else points(kind, 40)
    got = N.k_nearest(spark.createDataFrame(targets), spark.createDataFrame(candidates), 5, "id", "id", metric, exclude).toPandas()
    want = brute(targets, candidates, 5, metric, exclude)
    assert len(got) == 5 * len(targets)
    for key, rows in got.sort_values("rank").groupby("target_id"):
        assert list(rows["rank"]) == [1, 2, 3, 4, 5]
        np.testing.assert_allclose(rows["distance"], want[key], atol=1e-6)
        assert not exclude or key not in set(rows["near_id"])


def test_fewer_candidates_than_wanted(spark):
    few = points("even", 3)
    got = N.k_nearest(spark.createDataFrame(points("even", 4)), spark.createDataFrame(few), 5, "id", "id").toPandas()
    assert (got.groupby("target_id").size() == 3).all()


@pytest.mark.parametrize("kind", ["even", "clustered", "piled"])
def test_within(spark, kind):
    pdf = points(kind, 120)
    df = spark.createDataFrame(pdf)
    got = {(r[0], r[1]) for r in N.within(df, df, 150.0, "id", "id").collect()}
    lat, lon = pdf["latitude"].to_numpy(), pdf["longitude"].to_numpy()
    d = _haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    assert got == set(zip(*np.nonzero(d <= 150.0)))
    once = N.within(df, df, 150.0, "id", "id", once=True).count()
    assert once == (len(got) - len(pdf)) // 2


def reference_labels(station, grid, n):
    lats, lons = sorted(set(grid["latitude"])), sorted(set(grid["longitude"]))
    margin = 1 if n == 4 else 2
    i = int(np.clip(np.searchsorted(lats, station.latitude), margin, len(lats) - margin))
    j = int(np.clip(np.searchsorted(lons, station.longitude), margin, len(lons) - margin))
    labels = N.INNER_LABELS if n == 4 else N.INNER_LABELS | N.OUTER_LABELS
    used, out = set(), {}
    for name, (a, b) in labels.items():
        lat, lon = lats[int(np.clip(i + a, 0, len(lats) - 1))], lons[int(np.clip(j + b, 0, len(lons) - 1))]
        free = grid[~grid["id"].isin(used)]
        d = _haversine(lat, lon, free["latitude"].to_numpy(), free["longitude"].to_numpy()).round(9)
        if len(free):
            out[name] = free["id"].to_numpy()[np.lexsort((free["id"].to_numpy(), d))[0]]
            used.add(out[name])
    return out


@pytest.mark.parametrize("n", [4, 12])
def test_enclosing_labels(spark, n):
    lattice = [(a, b) for a in np.arange(48, 52, 0.5) for b in np.arange(7, 11, 0.5)]
    grid = pd.DataFrame(lattice, columns=["latitude", "longitude"]).assign(id=range(len(lattice)))
    grid = grid[RNG.random(len(grid)) > 0.3].reset_index(drop=True)  # holes in the lattice
    stations = pd.concat([points("even", 12), pd.DataFrame({"id": [100], "latitude": [49.0], "longitude": [8.5]})])
    got = N.enclosing_labels(spark.createDataFrame(stations), spark.createDataFrame(grid), n, "id", "id").toPandas()
    for s in stations.itertuples():
        rows = got[got["target_id"] == s.id]
        assert dict(zip(rows["label"], rows["near_id"])) == reference_labels(s, grid, n)
    on_grid = got[got["target_id"] == 100].iloc[0]
    assert (on_grid["rel_lat"], on_grid["rel_lon"]) == (1.0, 1.0)


def test_match_and_group_distance(spark):
    a = spark.createDataFrame(pd.DataFrame({"station_id": ["x", "y"], "latitude": [50.0, 52.0], "longitude": [8.0, 9.0]}))
    g = spark.createDataFrame(pd.DataFrame({"grid_id": [1, 2], "latitude": [50.01, 50.02], "longitude": [8.0, 8.0]}))
    got = {r["target_id"]: r["near_id"] for r in N.match_coordinates(a, g, 0.02, "station_id", "grid_id").collect()}
    assert got == {"x": 1, "y": None}


@pytest.mark.parametrize("metric", ["haversine", "degrees"])
def test_a_crowded_cell_does_not_meet_itself(spark, metric):
    n = 20_000
    lat, lon = 50 + RNG.normal(0, 3e-3, n), 8 + RNG.normal(0, 3e-3, n)
    lat[:30], lon[:30] = RNG.uniform(49, 51, 30), RNG.uniform(7, 9, 30)
    candidates = pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon})
    targets = candidates.iloc[:200]
    spark_candidates = spark.createDataFrame(candidates)
    assert N._lowest_level(N._points(spark_candidates, "id", "near", metric), list(N._axes(metric)), metric, 256) < -2
    got = N.k_nearest(spark.createDataFrame(targets), spark_candidates, 4, "id", "id", metric).toPandas()
    want = brute(targets, candidates, 4, metric, False)
    for key, rows in got.sort_values("rank").groupby("target_id"):
        np.testing.assert_allclose(rows["distance"], want[key], atol=1e-6)
    assert len(got) == 800


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_k_nearest_on_the_ellipsoid(spark, kind):
    from galeframe.functions.geo import inverse_geodesic

    candidates, targets = points(kind, 400), points(kind, 40)
    got = N.k_nearest(spark.createDataFrame(targets), spark.createDataFrame(candidates), 6, "id", "id", "geodesic").toPandas()
    assert len(got) == 240
    for t in targets.itertuples():
        rows = got[got["target_id"] == t.id].sort_values("rank")
        lat, lon = candidates["latitude"].to_numpy(), candidates["longitude"].to_numpy()
        km = inverse_geodesic(np.full(400, t.latitude), np.full(400, t.longitude), lat, lon)[0]
        order = np.argsort(km)[:6]
        assert rows["near_id"].tolist() == candidates["id"].to_numpy()[order].tolist()
        np.testing.assert_allclose(rows["distance"], km[order], rtol=1e-9)


def test_ring_is_bounded_where_points_are_dense(spark):
    n = 4000
    lat, lon = RNG.uniform(50, 50.4, n), RNG.uniform(8, 8.6, n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon}))
    pairs = N._ring_pairs(df, df, 3, "id", "id", "haversine", True)
    assert pairs.count() < 120 * n  # over 1000 a point with the cells of level 0 alone


def test_neighbours_of_repeated_ids(spark):
    spots = [("a", 50.0, 8.0)] * 5 + [("b", 50.3, 8.0), ("c", 50.6, 8.0), ("d", 49.0, 8.0)]
    df = spark.createDataFrame(spots, "station_id string, latitude double, longitude double")
    got = N.k_nearest(df, df, 2, candidate_key="station_id", exclude_self=True).filter("target_id = 'b'").collect()
    assert [r["near_id"] for r in got] == ["a", "a"]
    got = N.k_nearest(df.distinct(), df, 1, candidate_key="station_id", exclude_self=True).filter("target_id = 'a'").collect()
    assert [r["near_id"] for r in got] == ["b"]


def test_radius_join_is_spread_over_tasks(spark):
    df = spark.createDataFrame(points("even", 300)).coalesce(1)
    pairs = N.within(df, df, 400.0, "id", "id")
    assert pairs.rdd.getNumPartitions() >= N.spread(pairs)
    cells = N._blocks(spark.createDataFrame(points("piled", 3000)), "id", "near", "haversine", F.lit(400.0))
    assert cells.agg(F.max(F.size("_near"))).first()[0] < 2 * N.BLOCK


def test_pairs_are_bounded_where_candidates_gather_far_from_targets(spark):
    lat = np.add.outer(50 + 0.2 * np.arange(4), np.linspace(0, 0.02, 160)).ravel()
    candidates = pd.DataFrame({"id": np.arange(640), "latitude": lat, "longitude": 8.0})
    targets = pd.DataFrame({"id": np.arange(6), "latitude": 50.09 + 0.2 * (np.arange(6) % 3), "longitude": 8.01 + 0.001 * np.arange(6)})
    sides = spark.createDataFrame(targets), spark.createDataFrame(candidates)
    pairs = N._ring_pairs(*sides, 3, "id", "id", "haversine", False)
    assert pairs.count() < 150 * 6  # each of the clumps has 160 points
    got = N.k_nearest(*sides, 3, "id", "id").toPandas().sort_values(["target_id", "rank"])
    for key, want in brute(targets, candidates, 3, "haversine", False).items():
        np.testing.assert_allclose(got.loc[got["target_id"] == key, "distance"], want, rtol=1e-9)


@pytest.mark.parametrize("cells", [N.CELLS, 0])
def test_targets_stay_in_their_tasks_while_cells_are_opened(spark, monkeypatch, capsys, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    candidates, targets = points("clustered", 900), points("clustered", 60)
    sides = spark.createDataFrame(targets), spark.createDataFrame(candidates)
    N._ring_pairs(*sides, 3, "id", "id", "haversine", False).explain()
    dealt = capsys.readouterr().out.count("Exchange hashpartitioning(target_id")
    assert not cells or dealt <= 2  # the distinct targets and their tasks, no more for a level
    got = N.k_nearest(*sides, 3, "id", "id").toPandas().sort_values(["target_id", "rank"])
    for key, want in brute(targets, candidates, 3, "haversine", False).items():
        np.testing.assert_allclose(got.loc[got["target_id"] == key, "distance"], want, rtol=1e-9, atol=1e-6)


def test_blocks_grow_with_the_points(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 10)
    rng = np.random.default_rng(5)
    spots = [(f"{i:03d}", float(47 + rng.uniform(0, 0.5)), float(8 + rng.uniform(0, 0.5))) for i in range(2600)]
    few, many = (spark.createDataFrame(spots[:n], "station_id string, latitude double, longitude double") for n in (60, 2600))
    edge = F.lit(1e5)  # one cell
    sizes = [[len(r[0]) for r in N._blocks(df, "station_id", "near", "haversine", edge).select("_near").collect()] for df in (few, many)]
    assert [sum(s) for s in sizes] == [60, 2600]
    assert len(sizes[0]) <= 6 and len(sizes[1]) <= N.BLOCKS + 2  # 260 blocks of ten points before
    near = N.within(many, few, 5.0).collect()
    lat, lon = np.array([s[1:] for s in spots]).T
    assert len(near) == (_haversine(lat[:, None], lon[:, None], lat[:60], lon[:60]) <= 5.0).sum() > 1000
