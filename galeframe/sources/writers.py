"""Sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_per_station(
    df: DataFrame, path: str, ts: str = "timestamp", chunk: str = "month", mode: str = "errorifexists"
) -> None:
    """Parquet by station, sorted by time.

    Rows are spread by station and calendar chunk, so a station with very many rows is
    written by several tasks into several files of its directory.
    """
    spread = df.withColumn("_chunk", F.date_trunc(chunk, ts))
    (
        spread.repartition("station_id", "_chunk")
        .sortWithinPartitions("station_id", ts)
        .drop("_chunk")
        .write.mode(mode)
        .partitionBy("station_id")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all data files below a folder, from the listing alone."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select("path", "length")


def _relative(path: str) -> Column:
    return F.regexp_extract("path", rf".*{re.escape(path.rstrip('/').rsplit('/', 1)[-1])}/(.*)$", 1)


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, schema: StructType | str, partition_by: Sequence[str] = (),
    sep: str = ";", force: bool = False,
) -> DataFrame:
    """Convert a CSV tree file by file; files that are converted already are left alone unless ``force``.

    The target is partitioned by ``source``, the file's path in the tree, and a file's
    partitions are overwritten as a whole, so a repeated call mends a broken one. Returns the
    number of files and bytes of either side.
    """
    name = _relative(source)
    wanted = _files(spark, source).filter(F.col("path").endswith(".csv")).select("path", name.alias("source"))
    if not force:
        try:
            there = spark.read.parquet(target).select("source").distinct()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            wanted = wanted.join(there, "source", "left_anti")
    paths = [r["path"] for r in wanted.toLocalIterator()]
    if paths:
        rows = spark.read.schema(schema).csv(paths, sep=sep, header=True)
        rows = rows.select("*", F.col("_metadata.file_path").alias("path")).withColumn("source", name).drop("path")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if force else "dynamic")
        writer.partitionBy("source", *partition_by).parquet(target)
    sides = []
    for side, path, ending in (("csv", source, ".csv"), ("parquet", target, ".parquet")):
        files = _files(spark, path).filter(F.col("path").endswith(ending))
        sides.append(files.agg(F.lit(side).alias("side"), F.count("path").alias("n_files"), F.sum("length").alias("bytes")))
    return sides[0].unionByName(sides[1])
