"""Operators without SQL, and invariants, on small fixtures."""

import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo, physics
from galeframe.operators import columns as C
from galeframe.operators import graph as G
from galeframe.operators import impute as I
from galeframe.operators import kriging as K
from galeframe.operators import quality as Q
from galeframe.operators import scale as SC
from galeframe.operators import sequences as S
from galeframe.operators import splits as SP
from galeframe.operators.neighbours import k_nearest
from galeframe.operators.ordering import positions

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hours(n):
    return [T0 + timedelta(hours=i) for i in range(n)]


# -- functions -----------------------------------------------------------------


def test_geodesic_known_line():
    km, bearing = geo.inverse_geodesic(
        np.array([-(37 + 57 / 60 + 3.7203 / 3600)]), np.array([144 + 25 / 60 + 29.5244 / 3600]),
        np.array([-(37 + 39 / 60 + 10.1561 / 3600)]), np.array([143 + 55 / 60 + 35.3839 / 3600]),
    )
    assert km[0] == pytest.approx(54.972271, abs=1e-5)
    assert bearing[0] == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-4)
    assert geo.inverse_geodesic(*np.array([[50.0], [8.0], [50.0], [8.0]]))[0][0] == 0


def test_utm_on_the_meridian(spark):
    east, north = geo.utm(F.lit(50.0), F.lit(9.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert row["e"] == pytest.approx(500000, abs=1e-6)
    assert row["n"] == pytest.approx(0.9996 * 5540847.0416, abs=1e-2)


def test_isotropic_ratio_is_planar_distance(spark):
    d = geo.anisotropic_km(F.lit(0.0), F.lit(0.0), F.lit(3000.0), F.lit(4000.0), 30.0, 1.0)
    assert spark.range(1).select(d).first()[0] == pytest.approx(5.0)


def test_wind_round_trip(spark):
    u, v = physics.wind_components(F.lit(5.0), F.lit(210.0))
    s, c = physics.direction_encoding(u, v)
    row = spark.range(1).select(physics.wind_speed(u, v), physics.degrees_from_sin_cos(s, c)).first()
    assert row[0] == pytest.approx(5.0) and row[1] == pytest.approx(210.0)


def test_density_of_dry_and_moist_air(spark):
    dry = physics.air_density(F.lit(288.15), F.lit(101325.0), F.lit(0.0), F.lit(1700.0))
    wet = physics.air_density(F.lit(288.15), F.lit(101325.0), F.lit(1.0), F.lit(1700.0))
    a, b = spark.range(1).select(dry, wet).first()
    assert a == pytest.approx(1.225, abs=1e-3) and b < a


def test_feature_names():
    cols = ["wind_speed", "wind_speed_h10_1", "wind_speed_h10_2", "wind_speed_next_1", "known_pca_1", "wind_speed_rotor_eq_1"]
    assert C.matching_columns(cols, "wind_speed") == ["wind_speed"]
    assert C.matching_columns(cols, "wind_speed_h10") == cols[1:3]
    known, observed = C.resolve_roles(cols, ["wind_speed_nwp"], ["wind_speed", "wind_speed_next"])
    assert known == ["known_pca_1", "wind_speed_h10_1", "wind_speed_h10_2", "wind_speed_rotor_eq_1"]
    assert observed == ["wind_speed", "wind_speed_next_1"]
    with pytest.raises(ValueError):
        C.features_of_mode(["u_10m"], "absolute")


def test_layout_check():
    Q.check_layouts({"a": ["x", "y"], "b": ["x", "y"]})
    with pytest.raises(ValueError, match="order"):
        Q.check_layouts({"a": ["x", "y"], "b": ["y", "x"]})
    with pytest.raises(ValueError, match="missing"):
        Q.check_layouts({"a": ["x", "y"], "b": ["x"]})


# -- sequences -----------------------------------------------------------------


def natural(x, y, at):
    """Whole-series not-a-knot spline by dense linear algebra on polynomial pieces."""
    n = len(x) - 1
    rows, right = [], []
    def piece(i, powers, value):
        row = np.zeros(4 * n)
        row[4 * i : 4 * i + 4] = powers
        return row, value
    for i in range(n):
        h = x[i + 1] - x[i]
        rows += [piece(i, [1, 0, 0, 0], 0)[0], piece(i, [1, h, h**2, h**3], 0)[0]]
        right += [y[i], y[i + 1]]
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        for p, q in (([0, 1, 2 * h, 3 * h**2], [0, 1, 0, 0]), ([0, 0, 2, 6 * h], [0, 0, 2, 0])):
            row = np.zeros(4 * n)
            row[4 * i : 4 * i + 4], row[4 * i + 4 : 4 * i + 8] = p, -np.array(q, float)
            rows.append(row)
            right.append(0)
    for i in (0, n - 2):
        row = np.zeros(4 * n)
        row[4 * i + 3], row[4 * i + 7] = 1, -1
        rows.append(row)
        right.append(0)
    coef = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    d = at - x[i]
    return (coef[i] * np.stack([d**0, d, d**2, d**3], axis=1)).sum(axis=1)


def test_spline_equals_piecewise_solution():
    rng = np.random.default_rng(2)
    x = np.sort(rng.choice(60, 20, replace=False)).astype(float)
    y = rng.normal(size=20)
    at = np.linspace(x[0], x[-1], 50)
    np.testing.assert_allclose(S.spline_values(x, y, at), natural(x, y, at), atol=1e-8)


def test_blockwise_spline_equals_whole_spline(spark):
    rng = np.random.default_rng(3)
    y = np.sin(np.arange(900) / 7) + rng.normal(0, 0.1, 900)
    y[rng.random(900) < 0.3] = np.nan
    y[200:260], y[:3], y[-2:] = np.nan, np.nan, np.nan
    pdf = pd.DataFrame({"k": "a", "p": np.arange(900), "v": y})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = S.interpolate_cubic(df, ["k"], "p", "v", block=32).orderBy("p").toPandas()["v"].to_numpy(float)
    known = ~np.isnan(y)
    want = np.where(known, y, S.spline_values(np.flatnonzero(known).astype(float), y[known], np.arange(900.0)))
    np.testing.assert_allclose(got, want, atol=1e-9)


def run_frame(spark, starts, length, skip=()):
    rows = [
        ("s", start, float(lead), start + timedelta(hours=lead), 100.0 * i + lead, (start + timedelta(hours=lead) - T0).total_seconds() / 3600)
        for i, start in enumerate(starts) for lead in range(1, length + 1) if (i, lead) not in skip
    ]
    return spark.createDataFrame(
        rows, "station_id string, starttime timestamp, forecasttime double, timestamp timestamp, nwp double, wind double"
    )


def test_run_sequences_are_contiguous_and_skip_gaps(spark):
    starts = [T0 + timedelta(hours=6 * i) for i in range(5)]
    out = S.run_sequences(run_frame(spark, starts, 6), ["station_id"], "nwp", "wind", "wind", 12, 6).orderBy("starttime").collect()
    assert [r["starttime"].replace(tzinfo=timezone.utc) for r in out] == starts[2:]
    for r in out:
        series = r["observed"] + r["y"]
        assert np.allclose(np.diff(series), 1.0)  # history ends one hour before the target starts
        assert len(r["known"]) == 18 and len(r["observed"]) == 12
    gap = S.run_sequences(run_frame(spark, starts, 6, {(2, 3)}), ["station_id"], "nwp", "wind", "wind", 12, 6)
    assert gap.count() == 0  # run 2 is incomplete, and it is in the history of runs 3 and 4


def test_run_pair_reasons(spark):
    series = spark.createDataFrame(
        [("s", t, None if i == 40 else 1.0) for i, t in enumerate(hours(60)) if i != 30], "station_id string, timestamp timestamp, v double"
    )
    starts = [2, 12, 18, 24, 30, 38, 58]
    runs = spark.createDataFrame([("s", T0 + timedelta(hours=h)) for h in starts], "station_id string, starttime timestamp")
    out = S.run_pairs(runs, series, ["station_id"], "v", 6, 4).collect()
    reasons = {int((r["starttime"].replace(tzinfo=timezone.utc) - T0).total_seconds() // 3600): r["reason"] for r in out}
    assert reasons == {2: "bounds", 12: "no_history", 18: "valid", 24: "valid", 30: "no_timestamp", 38: "missing", 58: "bounds"}


# -- imputation and scaling ----------------------------------------------------


def brute_impute(x, keys, k):
    out = x.copy()
    width = x.shape[1]
    for i, c in zip(*np.nonzero(np.isnan(x))):
        best = []
        for j in range(len(x)):
            if np.isnan(x[j, c]):
                continue
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                d = np.sqrt(((x[i, both] - x[j, both]) ** 2).sum() * width / both.sum())
                best.append((round(d, 9), keys[j], x[j, c]))
        best.sort()
        out[i, c] = np.mean([b[2] for b in best[:k]]) if best else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize(("block", "narrow"), [(1, 16), (7, 0), (None, 16)])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, block, narrow):
    monkeypatch.setattr(I, "NARROW", narrow)  # the closure of the task takes it along
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[10] = np.nan
    x[20:30] = x[19]  # equal distances
    rows = [("a", i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, t bigint, x array<double>")
    want = brute_impute(x, np.arange(60), 4)
    for by in (["g"], []):
        got = I.nearest_rows_mean(df, by, "t", "x", 4, block).collect()
        assert len(got) == np.isnan(x).sum()
        for r in got:
            assert r["value"] == pytest.approx(want[r["t"], r["column"]], abs=1e-9)


def test_nearest_rows_of_few_candidates_at_a_time(monkeypatch):
    """Whatever is looked at first, the result is that of all exact distances."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(200, 6)), 1) + 1e6
    x[rng.random(x.shape) < 0.5] = np.nan
    keys = rng.permutation(200)
    order = np.argsort(keys)
    want = brute_impute(x[order], keys[order], 3)[np.argsort(order)]
    for first, blocks, kind in ((1, 1, I.NearestRows), (3, 4, I.NearestRows), (256, 7, I.NearestRows), (1, 1, I.NearestOfNarrowRows), (1, 5, I.NearestOfNarrowRows)):
        monkeypatch.setattr(I, "FIRST", first)
        nearest = kind(x, 3)
        for at in np.array_split(np.arange(200), blocks):
            nearest.meet(keys[at], x[at])
        for i, gaps in enumerate(nearest.gaps):
            mean = nearest.means(i)
            np.testing.assert_allclose(np.where(np.isnan(mean), want[i, gaps], mean), want[i, gaps], rtol=1e-12)


def test_station_matrix_in_any_blocks(spark):
    rows = [(f"{s:03d}", t, None if (s * 7 + i) % 5 == 0 else float(s + i % 24 + i % 7)) for i, t in enumerate(hours(300)) for s in range(4)]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, v double")
    ways = [sorted(map(tuple, I.impute_matrix(df, "timestamp", "v", 3, block_rows=n).collect())) for n in (40, 1000)]
    assert len(ways[0]) == 1200 and all(v is not None for *_, v in ways[0])
    assert [r[:2] for r in ways[0]] == [r[:2] for r in ways[1]]
    np.testing.assert_allclose([r[2] for r in ways[0]], [r[2] for r in ways[1]], atol=1e-12)


def test_complete_series_pass_unchanged(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(30))], "station_id string, timestamp timestamp, v double")
    out = I.impute_rows(df, ["station_id"], "timestamp", ["v"]).orderBy("timestamp").toPandas()
    np.testing.assert_array_equal(out["v"], np.arange(30.0))


@pytest.mark.parametrize("most", [2, 64])
def test_pair_semivariance_equals_every_common_time(spark, monkeypatch, most):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(K, "TILE", most)
    names = [f"{i:02d}" for i in range(9)]
    places = spark.createDataFrame([(n, float(47 + i % 3 * 0.01), float(8 + i % 4)) for i, n in enumerate(names)], "station_id string, latitude double, longitude double")
    times = hours(24 * 50)
    values = {n: np.where(rng.random(len(times)) < 0.6, np.nan, rng.normal(1000, 3, len(times))) for n in names[:-1]}
    rows = [(n, "ab"[i % 2], t, None if np.isnan(v) else float(v)) for n, own in values.items() for i, (t, v) in enumerate(zip(times, own, strict=True))]
    series = spark.createDataFrame(rows, "station_id string, part string, timestamp timestamp, v double")
    pairs = spark.createDataFrame([(a, b, 1.5) for a in names for b in names if a < b and b != "05"], "i string, j string, distance double")
    for stations in (None, places):
        got = {(r["part"], r["i"], r["j"]): r["semivariance"] for r in K.pair_semivariance(series, pairs, "v", by=["part"], stations=stations).collect()}
        want = {}
        for i, j in [(a, b) for a in names[:-1] for b in names[:-1] if a < b and b != "05"]:
            for k, part in enumerate("ab"):
                gap = (values[i] - values[j])[k::2]
                want[part, i, j] = 0.5 * np.nanmean(gap**2)
        assert got.keys() == want.keys()
        assert all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)


def test_exact_signed_rank_equals_enumeration(spark):
    from itertools import product

    from galeframe.operators import metrics as M

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8, 12):
        d = rng.normal(0.3, 1, n).round(9)
        ranks = np.abs(d).argsort().argsort() + 1
        w = ranks[d > 0].sum()
        signs = np.array(list(product([0, 1], repeat=n)))
        want = (signs @ np.arange(1, n + 1) >= w).mean()
        got = M.signed_rank(spark.createDataFrame([(float(x),) for x in d], "d double"), "d", F.floor).first()
        assert got["n"] == n and got["w_plus"] == w and got["exact"] and got["p_value"] == pytest.approx(want, abs=1e-12)
    fifty = spark.range(1, 51).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).cast("double").alias("d"))
    got = M.signed_rank(fifty, "d", F.floor).first()
    assert got["exact"] and got["p_value"] == pytest.approx(M.signed_rank(fifty, "d", F.floor, 0).first()["p_value"], rel=0.02)
    for more in ([1.0, 1.0, 2.0], [0.0, 1.0, 2.0]):  # ties, a zero
        assert not M.signed_rank(spark.createDataFrame([(x,) for x in more], "d double"), "d", F.floor).first()["exact"]


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(g="s", i=range(80)))
    out = SC.principal_components(df, ["g"], ["a", "b", "c"], 2).orderBy("i").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    for k, name in ((2, "known_pca_0"), (1, "known_pca_1")):
        v = vectors[:, k] * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        np.testing.assert_allclose(out[name], z @ v, atol=1e-9)


def test_scaler_refuses_unknown_columns_and_flat_columns_stay_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    stats = SC.fit_scaler(df, ["a"])
    assert [r["a"] for r in SC.transform(df, stats, ["a"]).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="not fitted"):
        SC.transform(df, stats, ["b"])


# -- splits --------------------------------------------------------------------


def test_folds_are_disjoint_and_ordered(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(100)], "k string, t bigint")
    out = SP.time_series_folds(df, ["k"], ["t"], 4, F.floor(F.col("t") / 9))
    roles = SP.fold_roles(out, 4).toPandas()
    for (_, fold), part in roles.groupby(["k", "fold"]):
        train, val = part[part["role"] == "train"]["t"], part[part["role"] == "val"]["t"]
        assert train.max() < val.min()
    n = {k: len(p) for k, p in df.toPandas().groupby("k")}
    sizes = roles[roles["role"] == "val"].groupby(["k", "fold"]).size()
    assert all(size == n[k] // 5 for (k, _), size in sizes.items())


def test_masks_are_reproducible_and_bounded(spark):
    stations = spark.createDataFrame([(f"{i:05d}",) for i in range(20)], "station_id string")
    runs = spark.createDataFrame([(f"r{i}",) for i in range(15)], "run string")
    first = SP.mask_targets(runs, stations, "run", 2, 5, 6, seed=1).toPandas()
    again = SP.mask_targets(runs.repartition(3), stations.repartition(5), "run", 2, 5, 6, seed=1).toPandas()
    key = ["run", "station_id", "role"]
    assert sorted(map(tuple, first[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    sizes = first[first["role"] == "target"].groupby("run").size()
    assert sizes.between(2, 5).all() and len(sizes) == 15
    assert not first.duplicated(["run", "station_id"]).any()


# -- kriging -------------------------------------------------------------------


def one_target(near, target, params, model, metric):
    return K.solve_weights(near[None], target[None], np.array([params]), model, metric)[0]


@pytest.fixture(scope="module")
def stations(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({
        "station_id": [f"{i:05d}" for i in range(12)],
        "latitude": rng.uniform(48, 52, 12), "longitude": rng.uniform(7, 12, 12),
    })
    return spark.createDataFrame(pdf), pdf


def test_weights_sum_to_one_and_reproduce_a_station():
    near = np.array([[50.0, 8.0], [51.0, 9.0], [49.0, 10.0]])
    for metric in ("haversine", "geodesic"):
        w = one_target(near, np.array([50.3, 8.8]), (0.2, 2.0, 150.0), "exponential", metric)
        assert w.sum() == pytest.approx(1.0)
    w = one_target(near, near[1], (0.0, 2.0, 150.0), "spherical", "haversine")
    np.testing.assert_allclose(w, [0, 1, 0], atol=1e-9)


def test_duplicate_neighbours_give_finite_weights():
    near = np.array([[50.0, 8.0], [50.0, 8.0], [49.0, 10.0]])
    w = one_target(near, np.array([50.3, 8.8]), (0.0, 2.0, 150.0), "spherical", "haversine")
    assert np.isfinite(w).all() and w.sum() == pytest.approx(1.0) and w[0] == pytest.approx(w[1])


@pytest.mark.parametrize("model", ["spherical", "gaussian", "exponential"])
def test_fit_recovers_a_known_model(spark, model):
    lags = np.linspace(10, 390, 20)
    gamma = K.variogram_values(model, lags, 0.3, 1.7, 160.0)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(lags, gamma)], "seg string, lag_km double, semivariance double")
    row = K.fit_variograms(df, model, ["seg"]).first()
    assert (row["nugget"], row["psill"], row["range"]) == pytest.approx((0.3, 1.7, 160.0), rel=1e-3)
    assert K.fit_variograms(df.drop("seg"), model).count() == 1


def weights_table(spark, stations, k=5):
    df, _ = stations
    near = k_nearest(df, df, k, candidate_key="station_id", exclude_self=True)
    params = spark.createDataFrame([(0.2, 2.0, 150.0)], "nugget double, psill double, range double")
    return K.kriging_weights(near, df, df.select(F.col("station_id").alias("target_id")), params, model="exponential")


def test_regression_kriging_equals_numpy(spark, stations):
    rng = np.random.default_rng(9)
    times = hours(6)
    ids = stations[1]["station_id"]
    z, x, y = (rng.normal(size=(6, 12)) for _ in range(3))
    rows = [(s, t, float(z[i, j]), float(x[i, j]), float(y[i, j])) for i, t in enumerate(times) for j, s in enumerate(ids)]
    series = spark.createDataFrame(rows, "station_id string, timestamp timestamp, z double, x double, y double")
    weights = weights_table(spark, stations)
    w = weights.toPandas().sort_values(["target_id", "rank"])
    at = {s: j for j, s in enumerate(ids)}
    index = {t.replace(tzinfo=None): i for i, t in enumerate(times)}
    one = K.leave_one_out(series, weights, "z", 5, covariate="x").toPandas()
    many = K.regression_kriging(series, weights, "z", ["x", "y"], 5).toPandas()
    everyone = K.global_trend_kriging(series, weights, "z", "x").toPandas()
    assert len(one) == len(many) == len(everyone) == 72
    for r in one.itertuples():
        i, j, part = index[r.timestamp.to_pydatetime()], at[r.station_id], w[w["target_id"] == r.station_id]
        near = [at[s] for s in part["near_id"]]
        wt, d = part["weight"].to_numpy(), part["distance"].to_numpy()
        assert r.ok_pred == pytest.approx(wt @ z[i, near])
        assert r.idw_pred == pytest.approx((z[i, near] / d**2).sum() / (1 / d**2).sum())
        b, a = np.polyfit(x[i, near], z[i, near], 1)
        assert r.rk_pred == pytest.approx(a + b * x[i, j] + wt @ (z[i, near] - a - b * x[i, near]))
    for r in many.itertuples():
        i, j, part = index[r.timestamp.to_pydatetime()], at[r.station_id], w[w["target_id"] == r.station_id]
        near, wt = [at[s] for s in part["near_id"]], part["weight"].to_numpy()
        design = np.column_stack([np.ones(5), x[i, near], y[i, near]])
        beta = np.linalg.lstsq(design, z[i, near], rcond=None)[0]
        want = beta @ [1, x[i, j], y[i, j]] + wt @ (z[i, near] - design @ beta)
        assert r.rk_pred == pytest.approx(want)
    for r in everyone.itertuples():
        i, j, part = index[r.timestamp.to_pydatetime()], at[r.station_id], w[w["target_id"] == r.station_id]
        near, wt = [at[s] for s in part["near_id"]], part["weight"].to_numpy()
        others = [m for m in range(12) if m != j]
        b, a = np.polyfit(x[i, others], z[i, others], 1)
        assert r.rk_pred == pytest.approx(a + b * x[i, j] + (wt @ (z[i, near] - a - b * x[i, near])) / wt.sum())


def test_regression_kriging_centres_the_fit_and_falls_back(spark):
    schema = "station_id string, timestamp timestamp, z double, x double, y double"
    near = [(f"n{i}", T0, 5.0 + i, 5.0, 10.0 * (i + 1)) for i in range(6)]
    weights = spark.createDataFrame(
        [("t", f"n{i}", i + 1, 1.0, 1.0 / 6) for i in range(6)], "target_id string, near_id string, rank int, distance double, weight double"
    )

    def predicted(target, rows=near, k=6, w=weights):
        series = spark.createDataFrame([("t", T0, 1.0, *target), *rows], schema)
        return K.regression_kriging(series, w, "z", ["x", "y"], k).filter("station_id = 't'").first()["rk_pred"]

    assert predicted((10.0, 35.0)) == pytest.approx(7.5)  # a covariate that is equal at all neighbours has no slope
    assert predicted((None, 35.0)) == pytest.approx(7.5)  # ordinary kriging: the mean here
    missing = [("n0", T0, 5.0, None, 10.0), *near[1:]]
    assert predicted((10.0, 60.0), missing) == pytest.approx(7.5)
    # as many covariates as neighbours: the flattest fit through both
    two = weights.filter("rank <= 2").withColumn("weight", F.lit(0.5))
    rows = [("n0", T0, 1.0, 0.0, 0.0), ("n1", T0, 3.0, 2.0, 0.0)]
    assert predicted((1.5, 9.0), rows, 2, two) == pytest.approx(2.5)


def test_global_trend_of_large_equal_covariates_is_flat(spark, stations):
    rng = np.random.default_rng(4)
    ids = list(stations[1]["station_id"])
    rows = [(s, t, float(rng.normal()), 101_325.7) for s in ids for t in hours(5)]
    series = spark.createDataFrame(rows, "station_id string, timestamp timestamp, z double, x double")
    far = series.withColumn("x", F.when(F.col("station_id") == ids[0], 100_825.7).otherwise(F.col("x")))
    weights = weights_table(spark, stations)
    order = ["timestamp", "station_id"]
    flat, moved = (K.global_trend_kriging(df, weights, "z", "x").filter(F.col("station_id") == ids[0]).orderBy(*order).collect() for df in (series, far))
    assert [r["rk_pred"] for r in moved] == pytest.approx([r["rk_pred"] for r in flat])


def test_formulas_keep_missing_values(spark):
    from galeframe.functions import physics as P

    one = spark.range(1).select(F.lit(None).cast("double").alias("n"), F.lit(3.0).alias("v"))
    formulas = [
        *P.direction_encoding("n", "v"), *P.direction_encoding("v", "n"), P.power_law_speed("v", "n", 10.0, 100.0),
        P.power_law_speed("n", "v", 10.0, 100.0), P.non_negative("n"), P.clip("n", 0, 1), P.global_irradiance("n", "v"),
        P.global_irradiance("v", "n"), P.cap_area("v", "n"), P.scaled_power("n", "v"), G.wind_weight("v", "n", "v", "v"),
        G.wind_weight("n", "v", "v", "v"), G.gaussian_weight("n"),
    ]
    assert all(x is None for x in one.select(*[c.alias(f"c{i}") for i, c in enumerate(formulas)]).first())
    assert one.select(P.global_irradiance("v", None)).first()[0] == 3.0
    ends = spark.createDataFrame([("a", 50.0, 7.0, 10.0), ("b", 51.0, 8.0, None)], "id string, latitude double, longitude double, h double")
    edges = spark.createDataFrame([("a", "b", 9.0), ("b", "a", 9.0)], "src string, dst string, distance double")
    assert [r["d_alt"] for r in G.edge_features(edges, ends, ends, "h").collect()] == [None, None]


def test_draws_reach_every_turbine_and_place(spark):
    from galeframe.operators import splits as SP

    drawn = spark.range(2000).select((SP.draw_number(3, "id") % 200_000).alias("n")).agg(F.max("n"), F.countDistinct("n")).first()
    assert drawn[0] > 190_000 and drawn[1] > 1950
    stations_ = spark.range(101).select(F.col("id").cast("string").alias("station_id"))
    runs = spark.range(300).select(F.col("id").cast("string").alias("run"))
    out = SP.mask_targets(runs, stations_, "run", 2, 5, 6, seed=7)
    sizes = out.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("station_id").alias("d"), F.count_if(F.col("role") == "target").alias("t"))
    assert sizes.filter("n = d AND t BETWEEN 2 AND 5 AND n = t + 6").count() == 300
    assert out.select("station_id").distinct().count() == 101


def test_a_neighbour_on_the_spot_takes_all_weight(spark):
    df = spark.createDataFrame([(1.0, 0.0), (5.0, 2.0), (None, 0.0)], "v double, d double")
    assert df.agg(K.idw_prediction(F.col("v"), F.col("d"))).first()[0] == 1.0


def test_missing_neighbour_skips_the_prediction(spark, stations):
    ids = list(stations[1]["station_id"])
    series = spark.createDataFrame(
        [(s, T0, None if s == ids[0] else 1.0) for s in ids], "station_id string, timestamp timestamp, z double"
    )
    weights = weights_table(spark, stations)
    hit = {r["target_id"] for r in weights.filter(F.col("near_id") == ids[0]).select("target_id").collect()}
    out = {r["station_id"] for r in K.leave_one_out(series, weights, "z", 5).collect()}
    assert out == set(ids) - hit - {ids[0]}  # not observed itself


def test_diffusion_keeps_the_mass_of_a_signal(spark, stations):
    edges = G.nearest_edges(stations[0], 3).withColumn("weight", F.exp(-F.col("distance") / 200))
    signal = stations[0].select("station_id", F.lit(T0).cast("timestamp").alias("timestamp"), F.rand(1).alias("v"))
    out = G.diffuse(signal, edges, "v", 3).agg(*[F.sum(f"v_hop_{i}") for i in range(4)]).first()
    assert list(out) == pytest.approx([out[0]] * 4)


def test_global_scaler_ignores_held_out_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("test", 1000.0)], "s string, v double")
    stats = SC.fit_scaler(df, ["v"], where=F.col("s") != "test").first()
    assert (stats["v_mean"], stats["v_std"]) == (2.0, 1.0)


def test_positions_feed_windows_of_every_full_length(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(50))], "station_id string, timestamp timestamp, v double")
    placed = positions(df, ["station_id"], ["timestamp"], F.date_trunc("day", "timestamp"))
    out = S.history_future_windows(placed, ["station_id"], "pos", "timestamp", ["v"], ["v"], "v", 5, 3, step=4).collect()
    assert len(out) == 11
    for r in out:
        assert r["known_v"] == r["observed_v"] + r["y"]
        assert np.allclose(np.diff(r["known_v"]), 1)


def test_quantiles_of_one_crowded_bracket(spark):
    from galeframe.operators.quantiles import exact_quantiles

    # the middle 99 % lie between 0.5 and 0.5001, all different
    df = spark.range(200_000).select(F.when(F.col("id") < 1000, F.col("id").cast("double") - 1e6).when(F.col("id") >= 199_000, 1e6 + F.col("id"))
                                     .otherwise(0.5 + F.col("id") * 1e-10).alias("v"))
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    values = np.array([r["v"] for r in df.collect()])
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_interpolation_on_the_ellipsoid(spark, stations):
    ids = list(stations[1]["station_id"])
    rng = np.random.default_rng(12)
    rows = [(s, t, float(rng.normal())) for s in ids for t in hours(8)]
    series = spark.createDataFrame(rows, "station_id string, timestamp timestamp, z double")
    sphere, ellipsoid = (
        K.interpolate_stations(series, stations[0], "z", 4, 800.0, 8, "exponential", distance=d).orderBy("timestamp", "station_id").toPandas()
        for d in ("haversine", "geodesic")
    )
    assert len(sphere) == len(ellipsoid) == 96
    gap = (sphere["idw_pred"] - ellipsoid["idw_pred"]).abs()
    assert 0 < gap.max() < 0.05


@pytest.mark.parametrize("turned", [False, True])
def test_unlisted_pairs_equal_listed_ones(spark, monkeypatch, turned):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(K, "WIDE_TILE", 3)
    names = [f"{i:02d}" for i in range(14)]
    spots = [(n, float(47 + rng.uniform(0, 3)), float(8 + rng.uniform(0, 3))) for n in names] + [("13", 48.0, 9.0), ("14", None, 8.0)]
    places = spark.createDataFrame(spots, "station_id string, latitude double, longitude double")
    rows = [(n, "ab"[h % 2], t, None if rng.random() < 0.5 else float(rng.normal(9, 3))) for n in names[:-2] for h, t in enumerate(hours(24 * 40))]
    rows += [("13", "a", t, 1.0) for t in hours(30)]
    series = spark.createDataFrame(rows, "station_id string, part string, timestamp timestamp, v double")
    pairs = K.station_pairs(places, 200.0, K.anisotropic_axes(places.dropDuplicates(["station_id"]), 135.0, 0.6), 202.0) if turned else K.station_pairs(places, 200.0)
    got, want = (
        sorted((r["part"], r["i"], r["j"], round(r["distance"], 6), round(r["semivariance"], 9)) for r in K.pair_semivariance(series, p, "v", by=["part"], stations=places).collect())
        for p in (pairs, pairs.rows())
    )
    assert got == want and len(got) > 60
    plan = K.pair_semivariance(series, pairs, "v", stations=places)._jdf.queryExecution().optimizedPlan().toString()
    assert "target_id" not in plan  # no table of pairs, which a shuffle would carry


def test_wide_table_as_a_map(spark):
    from galeframe.operators.reshape import pivot_mean, pivot_mean_map

    df = spark.createDataFrame([(s, t, None if i % 2 else 1.0) for s in "abc" for i, t in enumerate(hours(6))], "station_id string, timestamp timestamp, v double")
    seen = spark.createDataFrame([(s, t, float(i)) for s in ("a", "b", None) for i, t in enumerate(hours(5))], "station_id string, timestamp timestamp, x double")
    wide, of_map = pivot_mean(seen, ["timestamp"], "station_id", ["a", "b"], {"x": "x_{}"}), pivot_mean_map(seen, ["timestamp"], "station_id", "x", "m")
    ways = [sorted(map(tuple, I.fill_from_wide(df, w, "timestamp", c, "v", 3600).collect()), key=str) for w, c in ((wide, {"x_a": "a", "x_b": "b"}), (of_map, "m"))]
    assert ways[0] == ways[1] and of_map.columns == ["timestamp", "m"]


def test_entries_of_a_station_matrix_do_not_carry_its_names(spark):
    df = spark.createDataFrame([(f"{s}", t, float(s)) for s in range(3) for t in hours(5)], "station_id string, timestamp timestamp, v double")
    plan = I.impute_matrix(df, "timestamp", "v", 2)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "posexplode(_x" in x]
    assert lines and not any("_ids" in x for x in lines)


def test_leave_one_out_sends_rows_not_partial_sums(spark):
    series = spark.createDataFrame([("a", T0, 1.0, 2.0)], "station_id string, timestamp timestamp, z double, x double")
    weights = spark.createDataFrame([("b", "a", 1, 3.0, 1.0)], "target_id string, near_id string, rank int, distance double, weight double")
    plan = K.leave_one_out(series, weights, "z", 1, covariate="x")._jdf.queryExecution().executedPlan().toString()
    steps = re.findall("HashAggregate|Exchange", plan)
    at = steps.index("HashAggregate")
    assert steps[at : at + 3] == ["HashAggregate", "HashAggregate", "Exchange"]


def test_groups_of_tiles_meet_once_and_travel_little(spark, monkeypatch):
    rng = np.random.default_rng(15)
    for name, n in {"WIDE_TILE": 2, "GROUP": 3, "MOST_GROUP": 3, "SLOTS": 50, "DENSE_BYTES": 4000}.items():
        monkeypatch.setattr(K, name, n)
    names = [f"{i:03d}" for i in range(40)]
    spots = [(n, float(47 + rng.uniform(0, 3)), float(8 + rng.uniform(0, 3))) for n in names]
    places = spark.createDataFrame(spots, "station_id string, latitude double, longitude double")
    times = hours(24 * 40)
    values = {n: np.where(rng.random(len(times)) < 0.6, np.nan, rng.normal(9, 3, len(times))) for n in names}
    values["007"][:] = np.nan
    values["008"][24:] = np.nan
    late = T0 + timedelta(minutes=7)  # a time that only some have
    rows = [(n, t, None if np.isnan(v) else float(v)) for n, own in values.items() for t, v in zip(times, own, strict=True)]
    rows += [(n, late, float(k)) for k, n in enumerate(names[:5])]
    series = spark.createDataFrame(rows, "station_id string, timestamp timestamp, v double")
    pairs = K.station_pairs(places, 250.0)
    got = {(r["i"], r["j"]): (r["distance"], r["semivariance"]) for r in K.pair_semivariance(series, pairs, "v").collect()}
    apart = {(r["i"], r["j"]): r["distance"] for r in pairs.rows().collect()}
    want = {}
    for (a, b), distance in apart.items():
        gaps = values[a] - values[b]
        gaps = np.append(gaps[~np.isnan(gaps)], [names.index(a) - names.index(b)] if b < "005" else [])
        if len(gaps):
            want[a, b] = distance, 0.5 * np.mean(gaps**2)
    assert got.keys() == want.keys() and len(got) > 500
    for pair, found in got.items():
        assert found == pytest.approx(want[pair], rel=1e-9)

    # 20 tiles in 7 groups, two spans: half of the groups and the tasks of a group, not all tiles within reach
    met = K._brought_together(series, pairs, "v", "timestamp", [], "month")
    sides = {r["_side"]: r["n"] for r in met.groupBy("_side").agg(F.count("*").alias("n")).collect()}
    shares = met.agg(F.count_distinct("_part")).first()[0]
    assert sides[0] <= 2 * 20 * shares and sides[1] <= 2 * 20 * 4.5


@pytest.mark.parametrize("circular", [False, True])
def test_wide_station_matrix_in_tiles_equals_rows_in_blocks(spark, monkeypatch, circular):
    monkeypatch.setattr(I, "CELLS", 300)  # a few stations a tile
    rng = np.random.default_rng(21)
    rows = [(f"{s:03d}", t, None if rng.random() < 0.7 else float(rng.integers(0, 9) * 40)) for s in range(40) for i, t in enumerate(hours(50)) if (s + i) % 11]
    rows += [(s, t, v) for s, t, v in rows[:49] if v is not None and s == "000" for s in ("900",)]  # a copy: equal distances
    rows += [("901", hours(50)[3], None)]  # nothing at all
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, v double")
    assert "posexplode(_x" not in I.impute_matrix(df, "timestamp", "v", 3, circular)._jdf.queryExecution().optimizedPlan().toString()
    ways = [{(r[0], r[1]): r[2] for r in I.impute_matrix(df, "timestamp", "v", 3, circular, n).collect()} for n in (None, 20)]
    assert ways[0].keys() == ways[1].keys() and len(ways[0]) == 42 * 50
    for name, v in ways[1].items():
        assert (ways[0][name] is None) == (v is None)
        if v is not None:
            assert ways[0][name] == pytest.approx(v, abs=1e-9) or circular and abs(abs(ways[0][name] - v) - 360) < 1e-9
    # rows without a name or a time are nobody's values
    odd = df.unionByName(spark.createDataFrame([(None, hours(50)[0], 1e6), ("000", None, 1e6)], df.schema))
    seen = {(r[0], r[1]): r[2] for r in I.impute_matrix(odd, "timestamp", "v", 3, circular).collect()}
    assert len(seen) == 43 * 51
    assert all(seen[name] == (v if v is None else pytest.approx(v, abs=1e-9)) for name, v in ways[0].items())


def test_kriging_over_tiles_equals_rows(spark, monkeypatch):
    """Odd rows: repeated weights and rows, gaps, stations without weights or place, two tiles and parts of a tile."""
    monkeypatch.setattr(K, "WIDE_TILE", 4)
    monkeypatch.setattr(K, "MOST_EDGES", 100)
    rng = np.random.default_rng(31)
    ids = [f"{i:02d}" for i in range(12)]
    places = spark.createDataFrame([(n, float(47 + rng.uniform(0, 2)), float(8 + rng.uniform(0, 2))) for n in ids] + [("12", None, 8.0)], "station_id string, latitude double, longitude double")
    near = [(p, a, b, r, float(rng.uniform(1, 50)), float(rng.uniform(0, 1))) for p in "ab" for a in ids[:9] for r, b in enumerate(rng.choice([x for x in ids if x != a], 3, False).tolist(), 1)]
    near[1] = near[1][:4] + (0.0, 0.3)
    near.append(near[5])  # one more neighbour than k
    weights = spark.createDataFrame(near, "part string, target_id string, near_id string, rank int, distance double, weight double")
    value = lambda: None if rng.random() < 0.15 else float(rng.normal(9, 3))
    rows = [("ab"[h % 2], n, t, value(), value(), value()) for n in [*ids, "12", "13"] for h, t in enumerate(hours(24 * 33)[::12])]
    rows += [r for r in rows[:40] if r[3] is not None] + [("a", None, T0, 1.0, 1.0, 1.0), ("a", "03", None, 1.0, 1.0, 1.0)]
    series = spark.createDataFrame(rows, "part string, station_id string, timestamp timestamp, z double, x double, y double")
    once = series.dropDuplicates(["part", "station_id", "timestamp"])
    frame = once.toPandas().dropna(subset=["timestamp"])

    def expected(kind, frame):
        own = {(r.part, r.station_id, r.timestamp): r for r in frame.itertuples()}
        edges = {}
        for p, a, b, r, d, w in near:
            edges.setdefault((p, a), []).append((r, b, d, w))
        out = {}
        for (p, s, t), r in own.items():
            known = [(own[p, b, t], d, w) for _, b, d, w in sorted(edges.get((p, s), [])) if (p, b, t) in own]
            if kind == "trend":
                others = [o for o in own.values() if (o.part, o.timestamp) == (p, t) and o.station_id != s and not np.isnan(o.z + o.x)]
                b, a = np.polyfit([o.x for o in others], [o.z for o in others], 1)
                there = [(w, o.z - a - b * o.x) for o, _, w in known if not np.isnan(o.z + o.x)]
                out[p, s, t] = a + b * r.x + (sum(w * e for w, e in there) / sum(w for w, _ in there) if there else 0.0)
                continue
            covered = kind == "many" or sum(not np.isnan(o.x) for o, *_ in known) == 3
            known = [n for n in known if not np.isnan(n[0].z)]
            if len(known) != 3 or np.isnan(r.z):
                continue
            z, x, d, w = (np.array(v) for v in zip(*[(o.z, o.x, d, w) for o, d, w in known]))
            ordinary = (w * z).sum()
            idw = z[d == 0].mean() if (d == 0).any() else (z / d**2).sum() / (1 / d**2).sum()
            rk = ordinary
            if covered and not np.isnan(x.sum() + r.x):
                b, a = np.polyfit(x, z, 1)
                rk = a + b * r.x + (w * (z - a - b * x)).sum()
            out[p, s, t] = (idw, ordinary, rk)
        return out

    for where in (places, None):
        found = K.leave_one_out(once, weights, "z", 3, "x", by=["part"], places=where).toPandas()
        want = expected("one", frame)
        got = {(r.part, r.station_id, r.timestamp): (r.idw_pred, r.ok_pred, r.rk_pred) for r in found.itertuples()}
        assert got.keys() == want.keys() and len(got) == len(found) > 200
        assert [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], rel=1e-7, abs=1e-6)] == []
        found = K.global_trend_kriging(once, weights, "z", "x", by=["part"], places=where).toPandas()
        want = expected("trend", frame)
        got = {(r.part, r.station_id, r.timestamp): r.rk_pred for r in found.itertuples()}
        assert got.keys() == want.keys() and {"12", "13", "10"} < {k[1] for k in got}
        assert [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], rel=1e-7, abs=1e-6, nan_ok=True)] == []
        many = K.regression_kriging(once, weights, "z", ["x"], 3, by=["part"], places=where).toPandas()
        assert {(r.part, r.station_id, r.timestamp): r.rk_pred for r in many.itertuples()} == pytest.approx({k: v[2] for k, v in expected("many", frame).items()}, rel=1e-7, abs=1e-6)
    # a row of the series that comes twice is two neighbours, and is itself answered twice
    twice = K.leave_one_out(series.filter("part = 'b'"), weights.filter("part = 'b'"), "z", 3, "x", places=places)
    assert twice.count() > 0 and twice.groupBy("station_id", "timestamp").count().filter("count > 2").count() == 0
    # a station's month goes once to a tile, not once to each target that looks at it
    plan = K.leave_one_out(once, weights, "z", 3, "x", by=["part"], places=places)._jdf.queryExecution().optimizedPlan().toString()
    assert "_values" in plan and "regr_slope" not in plan
