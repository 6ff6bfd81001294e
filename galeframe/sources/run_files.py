"""A Spark data source for trees of forecast runs, ``{kind}/{hour}/{station}/{lat}_{lon}_{kind}.parquet``.

Reading, the driver lists hour and station folders only; a task lists the files of its stations. Comparisons of
``run_hour``, ``station_id``, ``latitude`` and ``longitude`` are decided by the path, before a file is opened.
Writing, every task writes whole files, one for each (hour, station, point) of its rows, under a name of its own first, and
renames them when they are complete, so a repeated task replaces what a lost one left.
"""

from __future__ import annotations

import operator
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from galeframe.sources.readers import nan_to_null

#: Columns that are in the path and not in the file.
PLACE = ["run_hour", "station_id", "latitude", "longitude"]
TESTS = {
    EqualTo: operator.eq, In: lambda a, b: a in b, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt, LessThanOrEqual: operator.le,
}
#: Station folders that one task reads.
FOLDERS = 32


def _tree(options: dict) -> tuple[pafs.FileSystem, str, str]:
    store, root = pafs.FileSystem.from_uri(options["path"])
    return store, root.rstrip("/"), options.get("kind", "ML")


def _folders(store: pafs.FileSystem, path: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)


class Folders(InputPartition):
    def __init__(self, hour: str, stations: list[str]) -> None:
        self.hour, self.stations = hour, stations


class RunReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema, self.tests = dict(options), schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if type(f) in TESTS and len(f.attribute) == 1 else None
            if column in PLACE:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, **place) -> bool:
        return all(TESTS[kind](place[column], value) for column, kind, value in self.tests if column in place)

    def partitions(self) -> Sequence[InputPartition]:
        store, root, kind = _tree(self.options)
        out = []
        for hour in _folders(store, f"{root}/{kind}"):
            if hour.isdigit() and self._wanted(run_hour=int(hour)):
                stations = [s for s in _folders(store, f"{root}/{kind}/{hour}") if self._wanted(station_id=s)]
                out += [Folders(hour, stations[i : i + FOLDERS]) for i in range(0, len(stations), FOLDERS)]
        return out or [Folders("", [])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, root, kind = _tree(self.options)
        first, second = ("longitude", "latitude") if self.options.get("lonfirst") == "true" else ("latitude", "longitude")
        target = to_arrow_schema(self.schema)
        for station in partition.stations:
            for info in store.get_file_info(pafs.FileSelector(f"{root}/{kind}/{partition.hour}/{station}")):
                parts = re.fullmatch(rf"(-?[\d.]+)_(-?[\d.]+)_{kind}[.]parquet", info.base_name)
                if not parts:
                    continue
                place = {"run_hour": int(partition.hour), "station_id": station, first: float(parts[1]), second: float(parts[2])}
                if not self._wanted(**place):
                    continue
                with store.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(columns=[f.name for f in target if f.name not in PLACE]):
                        columns = [
                            pa.array([place[f.name]] * len(batch), f.type) if f.name in PLACE else batch.column(f.name).cast(f.type)
                            for f in target
                        ]
                        yield pa.RecordBatch.from_arrays(columns, schema=target)


class RunWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root, kind = _tree(self.options)
        lon_first = self.options.get("lonfirst") == "true"
        name, writer, parts = None, None, ("", "")

        def close() -> None:
            if writer is not None:
                writer.close()
                store.move(*parts)

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            places = list(zip(*(table[c].to_pylist() for c in PLACE), strict=True))
            change = np.flatnonzero([a != b for a, b in zip(places, places[1:], strict=False)]) + 1
            bounds = [0, *change.tolist(), len(places)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                rows = table.slice(a, b - a).drop_columns(PLACE)
                if places[a] != name:
                    close()
                    name = places[a]
                    hour, station, lat, lon = name
                    folder = f"{root}/{kind}/{hour:02d}/{station}"
                    store.create_dir(folder)
                    stem = f"{lon}_{lat}" if lon_first else f"{lat}_{lon}"
                    parts = f"{folder}/.{stem}-{uuid.uuid4().hex}", f"{folder}/{stem}_{kind}.parquet"
                    writer = pq.ParquetWriter(parts[0], rows.schema, filesystem=store)
                writer.write_table(rows)
        close()
        return WriterCommitMessage()


class RunFiles(DataSource):
    """``spark.read.format("run_files").schema(...).option("kind", "SL").option("lonFirst", True).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RunReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RunWriter(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunFiles)
    return spark


def write_run_files(df: DataFrame, path: str, kind: str = "ML", lon_first: bool = False) -> None:
    """One file for each (run hour, station, point) of ``df``, with starttime, station_id, latitude and longitude.

    A file holds all rows of its key, by start and lead, and replaces one that is there.
    """
    _registered(df.sparkSession)
    rows = df.withColumn("run_hour", F.hour("starttime"))
    rows = rows.repartition(*PLACE).sortWithinPartitions(*PLACE, "starttime", "forecasttime")
    rows.write.format("run_files").option("kind", kind).option("lonFirst", str(lon_first).lower()).mode("append").save(path)


def read_run_files(spark: SparkSession, path: str, schema: str, kind: str = "ML", lon_first: bool = False) -> DataFrame:
    """Rows of a tree with the columns of its files (``schema``) and run_hour, station_id, latitude and longitude.

    Rows whose start hour differs from their folder are left out, not-a-number is missing.
    """
    full = f"{schema}, run_hour int, station_id string, latitude double, longitude double"
    reader = _registered(spark).read.format("run_files").schema(full)
    df = reader.option("kind", kind).option("lonFirst", str(lon_first).lower()).load(path)
    return nan_to_null(df).filter(F.hour("starttime") == F.col("run_hour"))
