"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of at most ``bucket_rows`` rows of one length class (lengths within
ten per cent of each other). Queries are cut into blocks sorted by the length that a vector needs to reach their k-th best
score so far. Buckets are searched in rounds, the longest first and four times as many each round, so that the scores
of one round set the thresholds of the next:

* A block meets a bucket only if the bucket's greatest length suffices for one of its queries.
* Inside, threshold / (length of the query * greatest length of the bucket) is the local cosine threshold. Above one, the query
  skips the bucket. From ``coordinate_from`` on, coordinate pruning is tried: a vector that reaches the threshold lies
  within an angle of the query, which bounds each of its unit coordinates; sorted coordinates give those inside
  the bounds of the query's largest coordinates. It is chosen if it leaves at most ``coordinate_share`` of
  the bucket, else length pruning: the bucket is searched down to the length that is still enough.
* What is left is verified by its exact product, and each query keeps its k best of the bucket.

Nothing is lost: bounds are widened against rounding, equal scores count as reaching the threshold, and thresholds of zero or
less prune nothing. Tables grow with the blocks that meet buckets; a task holds one block and one bucket at a time.

Defined cases: vectors that are missing or hold a missing or not finite component take no part; vectors meet those of
their own number of components; rows of the query's own vec_id are no candidates for it, other rows are, one by one if
repeated; repeated query rows give their results once each; a missing vec_id is no query and comes last among equal
scores; vectors of length zero score 0; an empty table gives an empty table; further columns are ignored; products
beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.llm.common import saved
from galeframe.llm.vectors import embeddings, largest, lengths, matrix, numbered, packed, products, tie_order, usable, whole

#: Two lengths of one class differ by less than this factor.
CLASS = 1.1
SLACK = 1e-9
FOCUS = 3
STRIPE = 256
FOUND = "key long, query_id long, vec_id long, score long"


class Bucket:
    """A bucket's vectors by descending length, with sorted coordinates made when first asked for."""

    def __init__(self, vectors: np.ndarray, ids: pa.Array) -> None:
        self.vectors, self.ids = vectors, ids
        self.lengths = lengths(vectors)
        self.place = tie_order(ids)
        self.known = np.asarray(ids.is_valid())
        self.values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self._unit, self._sorted = None, {}

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        return self._unit

    def between(self, f: int, low: float, high: float) -> np.ndarray:
        """Rows whose unit coordinate f is within bounds."""
        if f not in self._sorted:
            order = np.argsort(self.unit()[:, f], kind="stable")
            self._sorted[f] = order, self.unit()[order, f]
        order, values = self._sorted[f]
        return order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]


def feasible(unit: np.ndarray, cosine: float, focus: int) -> list[tuple[int, float, float]]:
    """(coordinate, low, high) of the largest coordinates: what vectors of at least this cosine have there."""
    chosen = np.argsort(-np.abs(unit), kind="stable")[:focus]
    angle, reach = np.arccos(np.clip(unit[chosen], -1, 1)), np.arccos(min(1.0, cosine))
    low, high = np.cos(np.minimum(np.pi, angle + reach)) - 1e-7, np.cos(np.maximum(0, angle - reach)) + 1e-7
    return list(zip(chosen.tolist(), low.tolist(), high.tolist(), strict=True))


def by_coordinates(bucket: Bucket, query: np.ndarray, length: float, cosine: float, share: float) -> np.ndarray | None:
    """Rows within the bounds of the focus coordinates, or None where they leave too many."""
    bounds = feasible(query / length, cosine, FOCUS)
    rows = min((bucket.between(f, low, high) for f, low, high in bounds), key=len)
    if len(rows) > share * len(bucket.ids):
        return None
    for f, low, high in bounds:
        here = bucket.unit()[rows, f]
        rows = rows[(here >= low) & (here <= high)]
    return rows


def search(
    queries: np.ndarray, ids: np.ndarray, thresholds: np.ndarray, bucket: Bucket, k: int, coordinate_from: float, coordinate_share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of up to k rows of the bucket for each query, all that reach its threshold and its best k."""
    own = lengths(queries)
    most = bucket.lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((thresholds > 0) & (own > 0), thresholds / (own * most), -np.inf)
    local = np.where((thresholds > 0) & (own * most == 0), np.inf, local)
    live = np.flatnonzero(local <= 1 + SLACK)
    out, dense = [], []
    for i in live.tolist():
        rows = by_coordinates(bucket, queries[i], own[i], local[i], coordinate_share) if local[i] >= coordinate_from else None
        if rows is None:
            dense.append(i)
            continue
        scores = products(queries[i : i + 1], bucket.vectors[rows])
        fine = (scores >= thresholds[i]) & ~(bucket.known[rows] & (bucket.values[rows] == ids[i]))
        _, at = largest(scores, fine, tie_order(bucket.ids.take(pa.array(rows))), k)
        out.append((np.full(len(at), i), rows[at], scores[0, at]))
    for stripe in (np.array(dense[a : a + STRIPE], np.int64) for a in range(0, len(dense), STRIPE)):
        # lengths fall, so what the least demanding query of the stripe needs comes first
        need = np.min(np.where(np.isfinite(local[stripe]), local[stripe], 0.0)) * most * (1 - SLACK)
        end = np.searchsorted(-bucket.lengths, -need, "right")
        scores = products(queries[stripe], bucket.vectors[:end])
        fine = scores >= thresholds[stripe][:, None]
        same = np.flatnonzero(bucket.known[:end] & np.isin(bucket.values[:end], ids[stripe]))
        fine[:, same] &= ids[stripe][:, None] != bucket.values[same]
        q, at = largest(scores, fine, bucket.place[:end], k)
        out.append((stripe[q], at, scores[q, at]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(queries: DataFrame, best: DataFrame | None, k: int, size: int) -> DataFrame:
    """Blocks of queries by the length that a vector needs, with the least one, as a table with numbers."""
    if best is None:
        rows = queries.withColumn("threshold", F.lit(float("-inf")))
    else:
        full = best.groupBy("key").agg(F.min("score").cast("double").alias("threshold"), F.count("*").alias("n")).filter(F.col("n") >= k)
        exact = F.col("threshold") - F.abs("threshold") * 1e-15  # scores are whole numbers, doubles may be rounded
        rows = queries.join(full.select("key", exact.alias("threshold")), "key", "left").fillna(float("-inf"), ["threshold"])
    need = F.when((F.col("threshold") > 0) & (F.col("length") > 0), F.col("threshold") / F.col("length")).otherwise(F.lit(0.0))
    # A threshold above zero is out of reach for a query of length zero, which therefore never has one.
    blocks = packed(rows.withColumn("need", need), [F.col("need"), F.col("key")], size, [], "blocks")
    return blocks.select("part", "seq", "n", "dim", "v", "key", "query_id", "threshold", F.array_min("need").alias("least"))


def _meet(blocks: DataFrame, buckets: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks and buckets numbered first to last that can reach a threshold, side by side."""
    sizes = buckets.groupBy("dim").agg((F.max("number") + 1).alias("total"))
    thin = blocks.select("dim", "part", "seq", "least").join(sizes, "dim").filter(F.col("total") > first)
    numbers = F.sequence(F.lit(first), F.least(F.lit(last), F.col("total") - 1))
    pairs = thin.select("dim", "part", "seq", "least", F.explode(numbers).alias("number"))
    pairs = pairs.join(buckets.select("dim", "number", "high"), ["dim", "number"]).filter(F.col("high") >= F.col("least") * (1 - SLACK))
    left = pairs.select("dim", "part", "seq", "number").join(blocks.drop("least").withColumnsRenamed({"n": "q_n", "v": "q_v"}), ["dim", "part", "seq"])
    return left.join(buckets.select("dim", "number", "n", "v", "vec_id"), ["dim", "number"])


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    bucket_rows: int = 8192,
    block_rows: int = 1024,
    coordinate_from: float = 0.9,
    coordinate_share: float = 0.25,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query with vectors of another vec_id.

    ``vectors`` and ``queries`` have a vec_id and an array v of whole numbers.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    step = F.when(F.col("length") > 0, F.floor(F.log("length") / F.log(F.lit(CLASS)))).otherwise(-1)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").withColumn("length", length).withColumn("class", step)
    order = [F.col("class").desc(), F.col("length").desc(), F.col("vec_id")]
    buckets = numbered(packed(rows, order, bucket_rows, ["class"], "buckets")).withColumn("high", F.array_max("length"))
    buckets = saved(buckets.select("dim", "number", "n", "high", "v", "vec_id"), "numbered")
    asked = queries.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("query_id"), "v")
    asked = saved(asked.withColumn("length", length), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bucket = None, None
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                dim = one["dim"].as_py()
                if name != (dim, one["number"].as_py()):
                    name = dim, one["number"].as_py()
                    bucket = Bucket(matrix(one["v"].as_py(), one["n"].as_py(), dim), one["vec_id"].values)
                block = matrix(one["q_v"].as_py(), one["q_n"].as_py(), dim)
                ids, thresholds = (one[c].values.to_numpy() for c in ("query_id", "threshold"))
                q, at, scores = search(block, ids, thresholds, bucket, k, coordinate_from, coordinate_share)
                found = [one["key"].values.take(pa.array(q)), pa.array(ids[q]), bucket.ids.take(pa.array(at)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(found, names=["key", "query_id", "vec_id", "score"])

    by_score = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best, first, width = None, 0, 1
    total = buckets.agg(F.max("number")).first()[0]
    while total is not None and first <= total:
        met = saved(_meet(_blocks(asked, best, k, block_rows), buckets, first, first + width - 1).mapInArrow(run, FOUND), "met")
        found = met if best is None else best.unionByName(met)
        best = saved(found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).drop("rank"), "best")
        first, width = first + width, 4 * width
    if best is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return best.select("query_id", F.row_number().over(by_score).alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).filter(usable("embedding")).select("vec_id", whole("embedding", 1024).alias("v"))
    return top_products(rows, rows.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
