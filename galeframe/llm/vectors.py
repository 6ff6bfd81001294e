"""What the operators on embeddings share: whole-number vectors, blocks of them and exact products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from galeframe.llm.common import saved


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: str) -> Column:
    """Neither missing nor with a component that is missing or not finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), number), F.lit(False))


def whole(vector: str, scale: float) -> Column:
    """Each component x as floor(scale * x)."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


def packed(rows: DataFrame, order: list[Column], size: int, same: list[str], name: str) -> DataFrame:
    """``rows`` (with a vector v of whole numbers) put together ``size`` at a time along ``order``, as a written table.

    Each block has the lists of all columns, its vectors as one binary, their number n and length dim, and its place
    (part, seq). Rows that differ in one of the columns ``same`` or in dim share no block.
    """
    rows = rows.withColumn("dim", F.size("v"))
    parts = max(1, math.ceil(rows.count() / size))
    keys = [F.col("dim"), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).coalesce(parts)
    single = [c for c in rows.columns if c not in ("v", "dim")]
    kinds = {c: rows.schema[c].dataType for c in single}

    def block(table: pa.Table, part: int, seq: int) -> pa.RecordBatch:
        values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        small = len(values) == 0 or -(2**31) <= values.min() and values.max() < 2**31
        columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(table)], pa.int32())]
        columns += [table["dim"].combine_chunks().slice(0, 1), pa.array([values.astype("<i4" if small else "<i8").tobytes()], pa.binary())]
        for c in single:
            items = table[c].combine_chunks()
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items))
        return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n", "dim", "v", *single])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and len(held) else table
            change = np.zeros(len(held), bool)
            for c in ["dim", *same]:
                values = held[c].combine_chunks()
                change[1:] |= values[1:].to_numpy(zero_copy_only=False) != values[:-1].to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(change).tolist()]
            ends = [*starts[1:], len(held)]
            cuts = [(a, min(a + size, end)) for start, end in zip(starts, ends, strict=True) for a in range(start, end, size)]
            for a, b in cuts[:-1]:
                yield block(held.slice(a, b - a), part, seq)
                seq += 1
            held = held.slice(cuts[-1][0]) if cuts else None
        if held is not None and len(held):
            yield block(held, part, seq)

    fields = [T.StructField(c, T.ArrayType(kinds[c])) for c in single]
    first = T.StructType.fromDDL("part int, seq int, n int, dim int, v binary")
    return saved(dealt.mapInArrow(run, T.StructType([*first.fields, *fields])), name)


def numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their number, from 0, among those of equal dim: the order of the table of blocks alone is sorted."""
    place = blocks.select("dim", "part", "seq", (F.row_number().over(Window.partitionBy("dim").orderBy("part", "seq")) - 1).alias("number"))
    return blocks.join(place, ["dim", "part", "seq"])


def matrix(binary: bytes, n: int, dim: int) -> np.ndarray:
    """The vectors of a block."""
    wide = n * dim > 0 and len(binary) == 8 * n * dim
    return np.frombuffer(binary, "<i8" if wide else "<i4").reshape(n, dim)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of all rows of a with all rows of b.

    No partial sum exceeds the product of the lengths, so floating point is exact as long as that product is a small
    whole number. Products beyond 64 bits raise an error.
    """
    most = lengths(a).max(initial=0.0) * lengths(b).max(initial=0.0) * (1 + 1e-9)
    if most >= 2**63:
        raise OverflowError("inner products don't fit into 64 bits")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def tie_order(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order, missing ones last."""
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    return place


def largest(scores: np.ndarray, allowed: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, of equal ones those of smaller place; in no order."""
    n = scores.shape[1]
    if n > k:
        low, high = int(scores.min()), int(scores.max())
        if max(abs(low), abs(high)) < (2**62) // (n + 1):
            rank = np.where(allowed, scores * n + (n - 1 - place), np.iinfo(np.int64).min)
            columns = np.argpartition(rank, n - k, axis=1)[:, n - k :]
        else:
            columns = np.stack([np.lexsort((place, -s, ~a))[:k] for s, a in zip(scores, allowed, strict=True)])
        rows = np.repeat(np.arange(len(scores)), k)
        columns = columns.ravel()
        fine = allowed[rows, columns]
        return rows[fine], columns[fine]
    return np.nonzero(allowed)
