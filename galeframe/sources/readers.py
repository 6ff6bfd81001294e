"""Readers for station series, forecast runs, metadata and result files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeframe.functions.text import grid_from_file_name, id_from_file_name

# Large files need no chunked reading: Spark splits them (spark.sql.files.maxPartitionBytes).


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing doubles as null, because ``avg`` skips nulls but not NaN."""
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def utc(df: DataFrame) -> DataFrame:
    """Timestamps without zone become UTC timestamps."""
    cols = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols}) if cols else df


def _try(read) -> DataFrame | None:
    """The frame, or None where no file matches."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _named(df: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    if "__index_level_0__" in df.columns and "timestamp" not in df.columns:
        df = df.withColumnRenamed("__index_level_0__", "timestamp")
    if "station_id" not in df.columns:
        df = df.withColumn("station_id", id_from_file_name(F.col("_metadata.file_path")))
    df = df.withColumn("station_id", F.lpad(F.col("station_id").cast("string"), 5, "0"))
    return df.filter(F.col("station_id").isin(*ids)) if ids else df


def read_stations(
    spark: SparkSession, path: str, schema: StructType | str, ids: Sequence[str] | None = None
) -> DataFrame:
    """Station series from parquet, and from ``;`` CSV files for stations without parquet.

    A file either holds a ``station_id`` column (or partition) or carries the id in its
    name. Stations without any file are simply absent.
    """
    options = dict(recursiveFileLookup=False)
    parquet = _try(lambda: spark.read.parquet(path, pathGlobFilter="*.parquet", **options))
    csv = _try(
        lambda: spark.read.schema(schema).csv(path, sep=";", header=True, pathGlobFilter="*.csv", **options)
    )
    frames = []
    if parquet is not None and parquet.columns:
        frames.append(_named(parquet, ids))
    if csv is not None:
        extra = _named(csv, ids)
        if frames:
            extra = extra.join(frames[0].select("station_id").distinct(), "station_id", "left_anti")
        frames.append(extra)
    if not frames:
        raise FileNotFoundError(f"no station files in {path}")
    out = frames[0]
    for more in frames[1:]:
        out = utc(out).unionByName(utc(more), allowMissingColumns=True)
    return nan_to_null(utc(out))


def read_runs(
    spark: SparkSession, path: str, kind: str = "ML", run_hours: Sequence[int] | None = None, lon_first: bool = False
) -> DataFrame:
    """Forecast runs from ``{kind}/{hour}/{station}/{lat}_{lon}_{kind}.parquet`` files.

    Position and run hour come from the path; only the directories of ``run_hours`` are
    listed. Rows whose start hour differs from their directory are left out.
    """
    hours = "{" + ",".join(f"{h:02d}" for h in run_hours) + "}" if run_hours else "*"
    df = spark.read.option("basePath", path).parquet(f"{path}/{kind}/{hours}/*/*_{kind}.parquet")
    file = F.col("_metadata.file_path")
    lat, lon = grid_from_file_name(file, kind, lon_first)
    df = df.withColumns(
        {
            "latitude": lat,
            "longitude": lon,
            "run_hour": F.regexp_extract(file, rf"/{kind}/(\d+)/", 1).cast("int"),
            "starttime": F.col("starttime").cast("timestamp"),
        }
    )
    return nan_to_null(utc(df)).filter(F.hour("starttime") == F.col("run_hour"))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """A folder that ``write_csv`` wrote."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True)


def read_second_model(spark: SparkSession, path: str, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Second model's runs with normalised column names, and the requested names it lacks.

    ``u_wind_10m`` and ``u_wind10m`` are the same column.
    """
    import re

    df = spark.read.parquet(path)
    tidy = [re.sub(r"^([uv]_wind)(\d)", r"\1_\2", c) for c in df.columns]
    df = utc(df.toDF(*tidy))
    keys = [c for c in ("starttime", "forecasttime", "grid_lat", "grid_lon") if c in df.columns]
    wanted = [re.sub(r"^([uv]_wind)(\d)", r"\1_\2", f) for f in features]
    missing = [f for f in wanted if f not in df.columns]
    return nan_to_null(df.select(*keys, *[f for f in wanted if f in df.columns])), missing


def multilevel_filter(
    points: Sequence[tuple[float, float]] | None, start: datetime, end: datetime, heights: Sequence[float]
) -> Column:
    """Plain column predicates, which a database or parquet reader can evaluate itself."""
    keep = (F.col("starttime") >= F.lit(start).cast("timestamp")) & (F.col("starttime") <= F.lit(end).cast("timestamp"))
    keep = keep & F.col("height").isin(*heights)
    if points:
        spots = [(F.col("latitude") == lat) & (F.col("longitude") == lon) for lat, lon in points]
        any_spot = spots[0]
        for s in spots[1:]:
            any_spot = any_spot | s
        keep = keep & any_spot
    return keep


def read_multilevel_jdbc(
    spark: SparkSession, url: str, table: str, points, start: datetime, end: datetime, heights: Sequence[float],
    features: Sequence[str], partitions: int = 32, properties: dict[str, str] | None = None,
) -> DataFrame:
    """Runs from a database, read in parallel by run start with all filters pushed down."""
    df = (
        spark.read.format("jdbc")
        .options(**(properties or {}))
        .options(
            url=url, dbtable=table, partitionColumn="starttime", numPartitions=partitions,
            lowerBound=start.strftime("%Y-%m-%d %H:%M:%S"), upperBound=end.strftime("%Y-%m-%d %H:%M:%S"),
        )
        .load()
    )
    keys = ["starttime", "forecasttime", "latitude", "longitude", "height"]
    return df.filter(multilevel_filter(points, start, end, heights)).select(*keys, *features)


# Column names of the two metadata dialects.
METADATA_NAMES = {"park_id": "station_id", "altitude": "station_height"}


def normalise_metadata(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed(METADATA_NAMES)
    height = F.col("station_height") if "station_height" in df.columns else F.lit(None)
    return df.select(
        F.lpad(F.col("station_id").cast("string"), 5, "0").alias("station_id"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        height.cast("double").alias("station_height"),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stations or parks; the separator is read off the header line."""
    header = spark.read.text(path).first()[0]
    sep = ";" if header.count(";") > header.count(",") else ","
    return normalise_metadata(spark.read.csv(path, header=True, sep=sep))


def complete_topography(df: DataFrame) -> DataFrame:
    """Terrain table with encoded aspect; flat ground has no dissection, gaps get the median."""
    from galeframe.operators.quantiles import quantile_columns

    angle = F.radians("aspect")
    df = df.withColumns({"aspect_sin": F.sin(angle), "aspect_cos": F.cos(angle)})
    df = df.withColumn("tdi", F.when(F.col("tdi").isNull() & (F.col("elev_std") == 0), 0.0).otherwise(F.col("tdi")))
    df = df.withColumnRenamed("dist_coast_km", "dist_coast")
    numeric = [c for c, t in df.dtypes if t == "double"]
    medians = quantile_columns(df.unpivot([], numeric, "column", "value"), ["column"], "value", {"median": 0.5})
    # a handful of columns, as one map
    known = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("m")).scalar()
    filled = {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c))) for c in numeric}
    return df.withColumn("_medians", known).withColumns(filled).drop("_medians")


def read_topography(spark: SparkSession, terrain: str, coast: str) -> DataFrame:
    table = spark.read.csv(terrain, header=True, inferSchema=False)
    text = ("location_id", "kind")
    table = table.select(*[F.col(c) if c in text else F.col(c).cast("double").alias(c) for c in table.columns])
    shore = spark.read.csv(coast, header=True).select(
        F.col("station_id").alias("location_id"), F.col("dist_coast_km").cast("double").alias("dist_coast_km")
    )
    return complete_topography(table.join(shore, "location_id", "left"))


def read_results(
    spark: SparkSession, pattern: str, schema: StructType | str, models: dict[str, tuple[str, str]] | None = None,
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Result files named ``{prefix}[_test]_fold{k}.csv``; absent columns get defaults.

    ``models`` maps prefixes to (model, variant); other prefixes are left out.
    """
    df = spark.read.schema(schema).csv(pattern, header=True, enforceSchema=False)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_fold\d+\.csv", 1)
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"_fold(\d+)\.csv", 1).cast("int")
    df = df.withColumns(
        {
            "prefix": F.regexp_replace(stem, "_test$", ""),
            "split": F.when(stem.endswith("_test"), "test").otherwise("val"),
            "fold": fold,
        }
    )
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    if models:
        known = F.create_map(*[
            F.lit(x) for p, mv in models.items() for x in (p, f"{mv[0]}|{mv[1]}")
        ])
        named = F.split(F.try_element_at(known, F.col("prefix")), r"\|")
        df = df.withColumn("_mv", named).filter("_mv IS NOT NULL")
        df = df.withColumns({"model": F.col("_mv")[0], "variant": F.col("_mv")[1]}).drop("_mv")
    return df
