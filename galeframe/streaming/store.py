"""A store of dated pieces under a manifest, into which the batches of a stream are written.

Each table of a store is a set of pieces, one folder of parquet files for a day of one batch. A batch opens only the
pieces of its own days. When ``fan_in`` pieces of a day have gathered on a level, they are merged into one of the
next level, so a day has at most ``fan_in - 1`` pieces on each of a logarithmic number of levels, and a row is
rewritten once a level. What belongs to the store is what its newest manifest lists: a file named after
the batch that is renamed into place as the last act. A batch that failed before that is
repeated under the same folder names, in overwrite mode; one that is repeated after it does nothing. Merged
pieces are deleted one batch later, so a reader that has just opened the older manifest still finds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pieces of tables that have no days.
ALWAYS = "1970-01-01"


class DatedStore:
    def __init__(self, spark: SparkSession, path: str, fan_in: int = 8) -> None:
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._newest()
        self._added: list[dict] = []
        self._gone: list[str] = []

    # -- files ---------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _newest(self) -> dict:
        names = [n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return {"batch": -1, "pieces": [], "schemas": {}, "gone": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        final = f"{self.path}/manifest/{manifest['batch']:012d}.json"
        out = self._fs.create(self._path(f"{final}.new"), True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(self._path(f"{final}.new"), self._path(final)):
            raise OSError(f"the manifest {final} can't be put into place")

    # -- reading -------------------------------------------------------------

    def done(self, batch: int) -> bool:
        return self.manifest["batch"] >= batch

    def paths(self, table: str, days: Sequence[str] | None = None) -> list[str]:
        """Folders of the pieces of a table, of all days or some."""
        wanted = None if days is None else set(days)
        pieces = [p for p in self.manifest["pieces"] if p["table"] == table and (wanted is None or p["day"] in wanted)]
        return [f"{self.path}/{table}/{p['name']}/_day={p['day']}" for p in pieces]

    def read(self, table: str, schema: StructType | None = None, days: Sequence[str] | None = None) -> DataFrame:
        """The rows of a table; ``schema`` is that of a table which nothing was written to."""
        known = self.manifest["schemas"].get(table)
        schema = StructType.fromJson(known) if known else schema
        if schema is None:
            raise ValueError(f"no table {table!r} in {self.path}")
        paths = self.paths(table, days)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------

    def stage(self, batch: int, rows: DataFrame, day: Column | None = None) -> tuple[DataFrame, list[str]]:
        """A batch's rows written beside the tables and read back, and their days."""
        folder = f"{self.path}/_incoming/b{batch:012d}"
        days = self._write(folder, rows, day)
        self._gone.append(folder)
        paths = [f"{folder}/_day={d}" for d in days]
        return (self.spark.read.schema(rows.schema).parquet(*paths) if days else self.spark.createDataFrame([], rows.schema)), days

    def _write(self, folder: str, rows: DataFrame, day: Column | None, sort: Sequence[str] = ()) -> list[str]:
        dated = rows.withColumn("_day", F.lit(ALWAYS) if day is None else F.date_format(day, "yyyy-MM-dd"))
        dated = dated.sortWithinPartitions("_day", *sort)
        dated.write.mode("overwrite").partitionBy("_day").parquet(folder)
        return [n.removeprefix("_day=") for n in self._names(folder) if n.startswith("_day=")]

    def write(self, batch: int, table: str, rows: DataFrame, day: Column | None = None, sort: Sequence[str] = (), replace: bool = False) -> DataFrame:
        """Rows as new pieces of a table, in place of all others if ``replace``; they count once ``commit`` is through."""
        name = f"b{batch:012d}"
        days = self._write(f"{self.path}/{table}/{name}", rows, day, sort)
        if replace:
            self._drop([p for p in self.manifest["pieces"] if p["table"] == table])
        self._added += [{"table": table, "day": d, "name": name, "level": 0} for d in days]
        self.manifest["schemas"][table] = rows.schema.jsonValue()
        paths = [f"{self.path}/{table}/{name}/_day={d}" for d in days]
        return self.spark.read.schema(rows.schema).parquet(*paths) if days else self.spark.createDataFrame([], rows.schema)

    def _drop(self, pieces: list[dict]) -> None:
        self.manifest["pieces"] = [p for p in self.manifest["pieces"] if p not in pieces]
        self._gone += [f"{self.path}/{p['table']}/{p['name']}/_day={p['day']}" for p in pieces]

    def _merge(self, batch: int, table: str, merge: Callable[[DataFrame], DataFrame], sort: Sequence[str]) -> None:
        """Days with too many pieces on a level get one piece of the next, all days of a level in one job."""
        level = 0
        while True:
            here: dict[str, list[dict]] = {}
            for p in self.manifest["pieces"]:
                if p["table"] == table and p["level"] == level:
                    here.setdefault(p["day"], []).append(p)
            due = [p for pieces in here.values() if len(pieces) >= self.fan_in for p in pieces]
            if not due:
                if not any(p["table"] == table and p["level"] > level for p in self.manifest["pieces"]):
                    return
                level += 1
                continue
            schema = StructType.fromJson(self.manifest["schemas"][table])
            days = sorted({p["day"] for p in due})
            each = []
            for d in days:
                paths = [f"{self.path}/{table}/{p['name']}/_day={d}" for p in due if p["day"] == d]
                each.append(merge(self.spark.read.schema(schema).parquet(*paths)).select(*schema.names).withColumn("_d", F.lit(d)))
            rows = each[0]
            for more in each[1:]:
                rows = rows.unionByName(more)
            name = f"b{batch:012d}-{level + 1}"
            rows = rows.repartition("_d").sortWithinPartitions("_d", *sort).withColumnRenamed("_d", "_day")
            rows.write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/{table}/{name}")
            self._drop(due)
            self.manifest["pieces"] += [{"table": table, "day": d, "name": name, "level": level + 1} for d in days]
            level += 1

    def commit(self, batch: int, merges: dict[str, tuple[Callable[[DataFrame], DataFrame], Sequence[str]]]) -> None:
        """Merge what is due, put the manifest of the batch into place, then delete what the batch before left behind."""
        self.manifest["pieces"] += self._added
        for table, (merge, sort) in merges.items():
            self._merge(batch, table, merge, sort)
        before = self.manifest["gone"]
        self.manifest |= {"batch": batch, "gone": self._gone}
        self._swap(self.manifest)
        self._added, self._gone = [], []
        for folder in before:
            self._fs.delete(self._path(folder), True)
        old = [n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")][:-2]
        for name in old:
            self._fs.delete(self._path(f"{self.path}/manifest/{name}"), False)
