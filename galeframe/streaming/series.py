"""Streaming forms of the hourly mean, the store append and the latest forecast."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from galeframe.streaming.store import DatedStore


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """File stream over the table ``{folder}/{name}.parquet``, a single file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    first = table.select("_metadata.file_path").first()
    stream = spark.readStream.schema(table.schema)
    if first and first[0].endswith(f"/{name}.parquet"):
        stream = stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        stream = stream.parquet(path)
    zoned = {c: F.col(c).cast("timestamp") for c, t in table.dtypes if t == "timestamp_ntz"}
    return stream.withColumns(zoned) if zoned else stream


def hourly_means(
    stream: DataFrame, key: str, ts: str, cols: Sequence[str], lateness: str = "2 hours", window: str = "1 hour"
) -> DataFrame:
    """Mean per key and hour, emitted once the watermark has passed the hour's end.

    Rows that come later than the watermark are dropped. State is one partial mean per
    key and open hour, so it does not grow with the stream.
    """
    means = [F.avg(c).alias(c) for c in cols]
    binned = stream.withWatermark(ts, lateness).groupBy(key, F.window(ts, window)).agg(*means)
    return binned.select(key, F.col("window.start").alias(ts), *cols)


def latest_forecasts(stream: DataFrame, by: Sequence[str], valid: str, value: Sequence[str], lateness: str) -> DataFrame:
    """Shortest-lead row per key and valid time; for update mode into an upserting sink."""
    best = F.min_by(F.struct(*value), F.struct("forecasttime", F.negative(F.unix_timestamp("starttime"))))
    rows = stream.withWatermark(valid, lateness).groupBy(*by, valid).agg(best.alias("_best"))
    return rows.select(*by, valid, *[F.col("_best")[v].alias(v) for v in value])


def _first_delivered(batch: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row per key, the one that the columns ``arrival`` put first."""
    values = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*arrival)).alias("_v")).select(*keys, "_v.*")


def _as_it_is(rows: DataFrame) -> DataFrame:
    return rows


def append_newer_runs(
    store_path: str, grid: Sequence[str], run: Sequence[str], row: Sequence[str], arrival: Sequence[str], run_time: str = "starttime"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that appends the runs that start after the newest stored one of their grid point.

    The newest start per grid point is a table of its own, replaced with each batch, so rows are never read again.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        store = DatedStore(batch.sparkSession, store_path)
        if store.done(batch_id):
            return
        unique = _first_delivered(batch, [*run, *row], arrival)
        latest = StructType([*(unique.schema[c] for c in grid), StructField("_newest", unique.schema[run_time].dataType)])
        newest = store.read("newest", latest)
        fresh = unique.join(newest, [*grid], "left").filter(F.col("_newest").isNull() | (F.col(run_time) > F.col("_newest")))
        written = store.write(batch_id, "rows", fresh.drop("_newest"), F.col(run_time), [run_time])
        starts = written.select(*grid, F.col(run_time).alias("_newest")).unionByName(newest)
        store.write(batch_id, "newest", starts.groupBy(*grid).agg(F.max("_newest").alias("_newest")), replace=True)
        store.commit(batch_id, {"rows": (_as_it_is, [run_time])})

    return sink


def append_new_runs(
    store_path: str, run: Sequence[str], row: Sequence[str], expected: int, arrival: Sequence[str], run_time: str = "starttime",
    fan_in: int = 8,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that appends rows of runs that are new or not yet complete.

    Of rows with one key, the first by ``arrival`` wins in a batch, and the stored one against a batch. A run
    that already has ``expected`` rows is left alone. The store keeps rows by run day, merged from time to time, and an index of
    the number of rows of each run; a batch reads both for its own days only, and rows only of runs not yet complete.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        store = DatedStore(batch.sparkSession, store_path, fan_in)
        if store.done(batch_id):
            return
        unique, days = store.stage(batch_id, _first_delivered(batch, [*run, *row], arrival), F.col(run_time))
        index = StructType([*(unique.schema[c] for c in dict.fromkeys([*run, run_time])), StructField("n", LongType(), False)])
        counted = store.read("runs", index, days).groupBy(*run).agg(F.sum("n").alias("n"))
        whole, part = counted.filter(F.col("n") >= expected).select(*run), counted.filter(F.col("n") < expected).select(*run)
        known = store.read("rows", unique.schema, days).select(*run, *row).join(part, [*run], "left_semi")
        fresh = unique.join(whole, [*run], "left_anti").join(known, [*run, *row], "left_anti")
        written = store.write(batch_id, "rows", fresh, F.col(run_time), [run_time])
        store.write(batch_id, "runs", _run_sizes(written, index.names[:-1]), F.col(run_time), run)
        summed = lambda rows: rows.groupBy(*index.names[:-1]).agg(F.sum("n").alias("n"))
        store.commit(batch_id, {"rows": (_as_it_is, [run_time]), "runs": (summed, run)})

    return sink


def _run_sizes(rows: DataFrame, run: Sequence[str]) -> DataFrame:
    return rows.groupBy(*run).agg(F.count("*").alias("n"))


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a store; none if nothing is there yet."""
    return DatedStore(spark, path).read("rows", schema)


def run_to_end(
    stream: DataFrame, folder: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None
) -> str:
    """Process all input that is not yet done into parquet (or a batch sink); returns the output folder.

    Output and checkpoint live in ``folder``, which all executors share. Called again with
    the same folder, after a stop or with more input, the stream goes on where it was.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    if sink:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", f"{folder}/data").start()
    query.awaitTermination()
    return f"{folder}/data"


def _newest_version(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_version").alias("_v")).select(*keys, "_v.*")

    return merge


def keep_newest(path: str, keys: Sequence[str], ts: str, fan_in: int = 8) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for update mode: one row a key and batch, by the day of ``ts``, which is one of the keys.

    Pieces of a day are merged from time to time, and only the newest version of a key outlives that, so the
    store holds a bounded number of versions of each key.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        store = DatedStore(batch.sparkSession, path, fan_in)
        if store.done(batch_id):
            return
        store.write(batch_id, "rows", batch.withColumn("_version", F.lit(batch_id).cast("long")), F.col(ts), keys)
        store.commit(batch_id, {"rows": (_newest_version(keys), keys)})

    return sink


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key of an update-mode store."""
    return _newest_version(keys)(DatedStore(spark, path).read("rows")).drop("_version")
