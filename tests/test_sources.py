"""Readers and writers on small file trees, and the streams."""

from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.sources import preprocess, readers, run_files, writers
from galeframe.streaming import series as ST

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "timestamp timestamp, wind_speed double"


def test_station_files_prefer_parquet(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00"])
    pd.DataFrame({"wind_speed": [1.0, float("nan")], "extra": [1, 2]}, index=ts.rename("timestamp")).to_parquet(
        tmp_path / "synth_183.parquet", coerce_timestamps="us", allow_truncated_timestamps=True
    )
    for name, v in (("synth_183", 9.0), ("Station_00200", 7.0)):
        pd.DataFrame({"timestamp": ts, "wind_speed": v}).to_csv(tmp_path / f"{name}.csv", sep=";", index=False)
    out = readers.read_stations(spark, str(tmp_path), SCHEMA).orderBy("station_id", "timestamp").collect()
    assert [(r["station_id"], r["wind_speed"]) for r in out] == [("00183", 1.0), ("00183", None), ("00200", 7.0), ("00200", 7.0)]
    only = readers.read_stations(spark, str(tmp_path), SCHEMA, ids=["00200", "99999"])
    assert {r["station_id"] for r in only.collect()} == {"00200"}
    with pytest.raises(FileNotFoundError):
        readers.read_stations(spark, str(tmp_path / "none"), SCHEMA)


@pytest.mark.parametrize("kind,lon_first", [("ML", False), ("SL", True)])
def test_run_files(spark, tmp_path, kind, lon_first):
    for hour in (6, 9):
        folder = tmp_path / kind / f"{hour:02d}" / "00183"
        folder.mkdir(parents=True)
        start = [T0 + timedelta(hours=hour), T0 + timedelta(hours=hour + 1)]  # the second start is misplaced
        name = f"8.25_50.5_{kind}.parquet" if lon_first else f"50.5_8.25_{kind}.parquet"
        pd.DataFrame({"starttime": start, "forecasttime": [1.0, 1.0], "u_wind": [2.0, 3.0]}).to_parquet(
            folder / name, coerce_timestamps="us", allow_truncated_timestamps=True
        )
    out = readers.read_runs(spark, str(tmp_path), kind, lon_first=lon_first).collect()
    assert {(r["run_hour"], r["latitude"], r["longitude"], r["u_wind"]) for r in out} == {(6, 50.5, 8.25, 2.0), (9, 50.5, 8.25, 2.0)}
    assert readers.read_runs(spark, str(tmp_path), kind, [9], lon_first).count() == 1


def test_run_tree_is_one_file_a_point_and_filters_choose_files(spark, tmp_path):
    rows = [(T0 + timedelta(hours=h, days=d), float(lead), float("nan") if lead == 2 else float(h), f"{s:05d}", 47.5 + s / 100, 6.25 + s, "x")
            for h in (6, 9, 12) for d in (0, 1) for lead in (1, 2, 3) for s in (1, 2, 40)]
    df = spark.createDataFrame(rows, "starttime timestamp, forecasttime double, u double, station_id string, latitude double, longitude double, note string")
    path, schema = str(tmp_path / "tree"), "starttime timestamp, forecasttime double, u double, note string"
    for _ in range(2):  # a repeated write replaces its files
        run_files.write_run_files(df, path, "SL", lon_first=True)
    files = sorted(str(f.relative_to(path)) for f in (tmp_path / "tree").rglob("*") if f.is_file())
    assert len(files) == 9 and files[0] == "SL/06/00001/7.25_47.51_SL.parquet"
    (tmp_path / "tree/SL/06/00001/note.txt").write_text("x")
    (tmp_path / "tree/SL/09/00001/7.25_47.51_SL.parquet").write_text("never opened")
    tree = run_files.read_run_files(spark, path, schema, "SL", lon_first=True)
    got = tree.filter((F.col("run_hour").isin(6, 12)) & (F.col("latitude") < 47.6)).collect()
    assert sorted((r["starttime"].replace(tzinfo=timezone.utc), r["forecasttime"], r["u"], r["station_id"], r["latitude"], r["longitude"], r["note"]) for r in got if r["u"] is not None) == sorted(
        r for r in rows if r[0].hour != 9 and r[4] < 47.6 and r[1] != 2.0)
    assert len(got) == 24 and tree.filter((F.col("run_hour") == 9) & (F.col("station_id") == "00040")).count() == 6
    assert tree.filter((F.col("run_hour") > 12) | F.col("run_hour").isNull()).filter("run_hour = 12").count() == 0
    assert run_files.read_run_files(spark, str(tmp_path / "none"), schema).count() == 0


def test_second_model_names(spark, tmp_path):
    pd.DataFrame({"starttime": [T0], "forecasttime": [1], "u_wind10m": [1.0], "v_wind_10m": [2.0]}).to_parquet(
        tmp_path / "a.parquet", coerce_timestamps="us", allow_truncated_timestamps=True
    )
    df, missing = readers.read_second_model(spark, str(tmp_path), ["u_wind_10m", "v_wind10m", "temp_2m"])
    assert df.columns == ["starttime", "forecasttime", "u_wind_10m", "v_wind_10m"] and missing == ["temp_2m"]


def test_metadata_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,latitude,longitude,station_height\n183,50.5,8.25,100\n")
    (tmp_path / "b.csv").write_text("park_id;longitude;latitude;altitude;commissioning_date\n7;8.25;50.5;20;2001-01-01\n")
    got = [tuple(readers.read_metadata(spark, str(tmp_path / f)).first()) for f in ("a.csv", "b.csv")]
    assert got == [("00183", 50.5, 8.25, 100.0), ("00007", 50.5, 8.25, 20.0)]


def test_topography(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "location_id,kind,elevation,aspect,tdi,elev_std\n1,station,0,90,,0\n2,station,10,0,,3\n3,station,20,180,2,1\n4,station,5,10,4,1\n"
    )
    (tmp_path / "c.csv").write_text("station_id,dist_coast_km\n1,5\n2,7\n3,9\n")
    out = {r["location_id"]: r for r in readers.read_topography(spark, str(tmp_path / "t.csv"), str(tmp_path / "c.csv")).collect()}
    assert out["1"]["tdi"] == 0.0 and out["2"]["tdi"] == 2.0 and out["4"]["dist_coast"] == 7.0
    assert out["1"]["aspect_sin"] == pytest.approx(1.0)


def test_csv_conversion_goes_file_by_file(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1.0)], "station_id string, v double").coalesce(1)
    writers.write_csv(df, src)
    schema = "station_id string, v double"
    report = {r["side"]: r["n_files"] for r in writers.csv_to_parquet(spark, src, dst, schema, ["station_id"]).collect()}
    assert report == {"csv": 1, "parquet": 1}
    before = {r["path"] for r in writers._files(spark, dst).filter("path LIKE '%.parquet'").collect()}
    writers.write_csv(spark.createDataFrame([("b", 2.0)], schema).coalesce(1), src, mode="append")
    report = {r["side"]: r["n_files"] for r in writers.csv_to_parquet(spark, src, dst, schema, ["station_id"]).collect()}
    assert report == {"csv": 2, "parquet": 2}
    after = {r["path"] for r in writers._files(spark, dst).filter("path LIKE '%.parquet'").collect()}
    assert before < after  # the file that was converted before is left alone
    assert sorted(r["v"] for r in spark.read.parquet(dst).collect()) == [1.0, 2.0]
    writers.csv_to_parquet(spark, src, dst, schema, ["station_id"], force=True)
    assert spark.read.parquet(dst).count() == 2
    assert not before & {r["path"] for r in writers._files(spark, dst).collect()}


def test_unknown_source_kind(spark):
    with pytest.raises(ValueError, match="known kinds"):
        preprocess.prepare(spark.range(1), "data/hydro")


def batches(spark, tmp_path, rows_per_batch, schema):
    folder = str(tmp_path / "in")
    for rows in rows_per_batch:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    return stream


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "station_id string, timestamp timestamp, wind_speed double"
    at = lambda h, v: ("s", T0 + timedelta(hours=h), v)
    # a watermark counts for rows from the batch after the next one on
    parts = [[at(0.1, 1.0), at(0.2, 3.0)], [at(5.0, 1.0)], [at(5.5, 1.0)], [at(0.3, 100.0), at(9.0, 1.0)]]
    stream = batches(spark, tmp_path, parts, schema)
    out = ST.run_to_end(ST.hourly_means(stream, "station_id", "timestamp", ["wind_speed"]), str(tmp_path / "late"))
    rows = {r["timestamp"].hour: r["wind_speed"] for r in spark.read.parquet(out).collect()}
    assert rows[0] == 2.0  # the 100.0 came after the watermark had passed


def test_append_takes_new_runs_once(spark, tmp_path):
    schema = "grid_id bigint, starttime timestamp, forecasttime double, v double, arrival bigint"
    row = lambda h, lead, v, n=0: (1, T0 + timedelta(hours=h), float(lead), v, n)
    parts = [[row(0, 1, 1.0), row(0, 2, 2.0, 1), row(0, 2, -7.0, 2), row(6, 1, 5.0)], [row(0, 1, 9.0), row(6, 1, 9.0), row(6, 2, 6.0)]]
    store = str(tmp_path / "store")
    sink = ST.append_new_runs(store, ["grid_id", "starttime"], ["forecasttime"], expected=2, arrival=["arrival"])
    stream = batches(spark, tmp_path, parts, schema)
    ST.run_to_end(stream, str(tmp_path / "append"), sink=sink)
    got = sorted((r["starttime"].hour, r["forecasttime"], r["v"]) for r in ST.read_store(spark, store, stream.schema).collect())
    assert got == [(0, 1.0, 1.0), (0, 2.0, 2.0), (6, 1.0, 5.0), (6, 2.0, 6.0)]


def test_only_newer_runs_of_a_grid_point_are_appended(spark, tmp_path):
    schema = "grid_id bigint, starttime timestamp, forecasttime double, v double, arrival bigint"
    row = lambda g, h, v: (g, T0 + timedelta(hours=h), 1.0, v, 0)
    parts = [[row(1, 6, 1.0), row(2, 0, 2.0)], [row(1, 0, 9.0), row(1, 6, 9.0), row(1, 12, 3.0), row(2, 6, 4.0), row(3, 0, 5.0)]]
    store = str(tmp_path / "store")
    sink = ST.append_newer_runs(store, ["grid_id"], ["grid_id", "starttime"], ["forecasttime"], ["arrival"])
    stream = batches(spark, tmp_path, parts, schema)
    ST.run_to_end(stream, str(tmp_path / "append"), sink=sink)
    assert sorted(r["v"] for r in ST.read_store(spark, store, stream.schema).collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_batches_open_few_pieces_and_merges_lose_nothing(spark, tmp_path):
    """Batches of two days each: what a batch opens and keeps stays bounded, rows are those of one batch."""
    schema = "grid_id bigint, starttime timestamp, forecasttime double, v double, arrival bigint"
    row = lambda b, lead, v: (b % 3, T0 + timedelta(hours=6 * b), float(lead), v, 0)
    parts = [[row(b, 1, 1.0), row(b, 2, 2.0), row(max(0, b - 1), 2, 9.0), row(max(0, b - 1), 3, 3.0), row(b, 2, 2.5)] for b in range(24)]
    parts = [[(*r[:4], i) for i, r in enumerate(p)] for p in parts]
    path = str(tmp_path / "store")
    sink = ST.append_new_runs(path, ["grid_id", "starttime"], ["forecasttime"], expected=3, arrival=["arrival"], fan_in=3)
    opened = []
    for b, part in enumerate(parts):
        days = {r[1].strftime("%Y-%m-%d") for r in part}
        opened.append(len(ST.DatedStore(spark, path).paths("rows", days)))
        sink(spark.createDataFrame(part, schema), b)
        sink(spark.createDataFrame([row(b, 7, -1.0)], schema), b)  # repeated after the manifest: nothing happens
    assert max(opened[12:]) <= max(opened[:12]) <= 8
    want = {}
    for part in parts:
        for g, start, lead, v, _ in part:
            done = len([k for k in want if k[:2] == (g, start)]) >= 3
            if not done or (g, start, lead) in want:
                want.setdefault((g, start, lead), v)
    got = ST.read_store(spark, path, None).collect()
    assert {(r["grid_id"], r["starttime"].replace(tzinfo=T0.tzinfo), r["forecasttime"]): r["v"] for r in got} == want and len(got) == len(want)
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) == 2


def test_a_batch_that_failed_before_its_manifest_is_repeated(spark, tmp_path, monkeypatch):
    schema = "grid_id bigint, starttime timestamp, forecasttime double, v double, arrival bigint"
    path = str(tmp_path / "store")
    sink = ST.append_new_runs(path, ["grid_id", "starttime"], ["forecasttime"], expected=9, arrival=["arrival"], fan_in=2)
    rows = [[(1, T0, float(b), float(b), 0)] for b in range(5)]
    for b, part in enumerate(rows):
        with monkeypatch.context() as m:
            m.setattr(ST.DatedStore, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                sink(spark.createDataFrame(part, schema), b)
        assert ST.read_store(spark, path, spark.createDataFrame([], schema).schema).count() == b
        sink(spark.createDataFrame(part, schema), b)
        assert ST.read_store(spark, path, None).count() == b + 1


def test_versions_of_a_key_are_bounded(spark, tmp_path):
    path, keys = str(tmp_path / "newest"), ["grid_id", "timestamp"]
    sink = ST.keep_newest(path, keys, "timestamp", fan_in=3)
    for b in range(14):
        rows = [(g, T0 + timedelta(hours=h), float(b)) for g in range(2) for h in (1, 2)]
        sink(spark.createDataFrame(rows, "grid_id bigint, timestamp timestamp, v double"), b)
        stored = ST.DatedStore(spark, path).read("rows").count()
        assert stored <= 4 * 2 * 4  # keys, pieces of a level, levels
    assert [r["v"] for r in ST.read_latest(spark, path, keys).collect()] == [13.0] * 4


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    schema = "grid_id bigint, starttime timestamp, forecasttime double, v double, arrival bigint"
    seen = []

    def sink(batch, batch_id):
        seen.append((batch_id, sorted(r["v"] for r in batch.collect())))

    row = lambda v: (1, T0, 1.0, v, 0)
    place = str(tmp_path / "state")
    ST.run_to_end(batches(spark, tmp_path, [[row(1.0)], [row(2.0)]], schema), place, sink=sink)
    ST.run_to_end(batches(spark, tmp_path, [[row(3.0)]], schema), place, sink=sink)
    assert [v for _, v in seen] == [[1.0], [2.0], [3.0]] and [b for b, _ in seen] == [0, 1, 2]


def test_shortest_lead_wins_over_batches(spark, tmp_path):
    schema = "grid_id bigint, starttime timestamp, forecasttime double, timestamp timestamp, v double"
    row = lambda lead, v: (1, T0 + timedelta(hours=10 - lead), float(lead), T0 + timedelta(hours=10), v)
    stream = batches(spark, tmp_path, [[row(5, 1.0)], [row(2, 2.0)], [row(4, 3.0)]], schema)
    latest = ST.latest_forecasts(stream, ["grid_id"], "timestamp", ["forecasttime", "v"], "2 days")
    store = str(tmp_path / "latest")
    ST.run_to_end(latest, str(tmp_path / "newest"), mode="update", sink=ST.keep_newest(store, ["grid_id", "timestamp"], "timestamp"))
    assert [tuple(r)[2:] for r in ST.read_latest(spark, store, ["grid_id", "timestamp"]).collect()] == [(2.0, 2.0)]


def test_pushed_predicates(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame([(T0, 1.0, 50.0, 8.0, 10)], "starttime timestamp, forecasttime double, latitude double, longitude double, height int").write.parquet(path)
    keep = readers.multilevel_filter([(50.0, 8.0), (51.0, 8.0)], T0, T0 + timedelta(days=1), [10, 38])
    df = spark.read.parquet(path).filter(keep)
    assert df.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(height, [10,38])" in plan and "GreaterThanOrEqual(starttime" in plan and "EqualTo(latitude,50.0)" in plan


def test_station_writer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("00001", T0, 1.0), ("00002", T0, 2.0)], f"station_id string, {SCHEMA}")
    writers.write_per_station(df, str(tmp_path / "out"))
    back = readers.read_stations(spark, str(tmp_path / "out"), SCHEMA)
    assert {(r["station_id"], r["wind_speed"]) for r in back.collect()} == {("00001", 1.0), ("00002", 2.0)}
    assert back.filter(F.col("timestamp") == F.lit(T0)).count() == 2
