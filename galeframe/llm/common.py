"""What the operators on documents share: reading, words, digests and tables kept between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.session import shared_dir

#: The white space that separates words and frames lines: code points 9-13 and 32.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the files of a query's shuffles when the query ends, instead of some time after.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs start from there, so what was shuffled for it can go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return written(spark.read.schema(df.schema).parquet(path), path)


#: The tables written in the innermost block of ``scratch``, their folders and their names in the catalog, if any.
_written: ContextVar[list[tuple[DataFrame, str, str | None]] | None] = ContextVar("written", default=None)


def written(table: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """A table in ``path``, which goes with the block of ``scratch`` it was written in."""
    if (own := _written.get()) is not None:
        own.append((table, path, name))
    return table


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``saved`` wrote inside go when the block ends, but for those given to the function it yields.

    These are then tables of the block around it; without one they stay. What a block returns may read kept tables only.
    """
    outer, own, kept = _written.get(), [], []
    before = _written.set(own)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.reset(before)
        for entry in own:
            if not any(entry[0] is k for k in kept):
                remove(*entry)
            elif outer is not None:
                outer.append(entry)


def remove(table: DataFrame, path: str, name: str | None = None) -> None:
    spark = table.sparkSession
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded(table: DataFrame, entries: str | None = None, limit: int = 64 << 20) -> DataFrame:
    """A written thin table, to be broadcast where its counted size (rows and array entries) allows it, else joined by a shuffle."""
    inner = F.coalesce(F.sum(F.size(entries)), F.lit(0)) if entries else F.lit(0)
    rows, inside = table.agg(F.count("*"), inner).first()
    return table.hint("broadcast") if 64 * rows + 16 * inside <= limit else table


def hash128(text: Column, name: str) -> list[Column]:
    """Two independently seeded 64-bit hashes of a text, as columns ``<name>a`` and ``<name>b``."""
    return [F.xxhash64(text).alias(f"{name}a"), F.xxhash64(F.lit(1), text).alias(f"{name}b")]


#: Names of the row key.
ROW = ["_row_a", "_row_b"]


def row_key() -> list[Column]:
    """A 128-bit key of doc_id and text, as the columns of ``ROW``: equal rows share it."""
    return [F.xxhash64("doc_id", "text").alias(ROW[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(ROW[1])]


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does that to texts of ASCII alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_of(column: str) -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` units of size each, so that work arrays stay small."""
    total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    cut = np.flatnonzero(np.diff(total // most)) + 1
    bounds = [0, *cut.tolist(), len(batch)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
