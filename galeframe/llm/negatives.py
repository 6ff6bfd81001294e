"""Hard negatives of anchors by slots of scores.

A positive of an anchor asks for the best negatives with a score between two limits, both shares of its own score, so
the windows of an anchor's positives overlap. Their upper limits cut the scores into disjoint slots: slot i
holds what is above the upper limit i + 1 and at most the upper limit i. Each block of anchors meets each chunk of rows once;
a chunk hands on the best k of every slot, and combiners keep the best k of a slot at any point before and after the
shuffle. The slots of an anchor, in descending order, then answer all its windows: the best k of a window are the first
k of the slots from its upper limit on, down to its lower limit. That is exact, because a slot's k best are all that any
window starting at or above it can need.

Positives are found the same way, an anchor's block meeting only the chunks that hold its labels: chunks are cut from rows
sorted by label, so a label with a third of all rows is many chunks and a rare label shares one.

Defined cases: rows with a missing label or vector, or with a component that is missing or not finite, take no part; vectors
meet those of their own number of components; rows of the anchor's own vec_id are not its positives, other rows are, one by
one if repeated; a repeated anchor row gives its results once each; a missing vec_id is no anchor and comes last among equal
scores; a positive with a negative score has an empty window; an anchor without positives or negatives gives no row; an empty
table gives an empty table; further columns are ignored; products beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.llm.common import saved
from galeframe.llm.vectors import embeddings, largest, matrix, numbered, packed, products, tie_order, usable, whole

STRIPE = 256
PLACE = ["dim", "part", "seq"]


def _ids(column: pa.ListScalar) -> pa.Array:
    return column.values


def _joined(blocks: DataFrame, chunks: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Block and chunk of each pair (dim, part, seq, number) side by side."""
    left = blocks.select(*PLACE, F.col("n").alias("q_n"), F.col("v").alias("q_v"), "key", "anchor_id", F.col("label").alias("q_label"), *columns)
    return pairs.join(left, PLACE).join(chunks.select("dim", "number", "n", "v", "vec_id", "label"), ["dim", "number"])


def _stripes(one: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(anchors, their scores, whether labels are equal) of a pair of block and chunk, some anchors at a time."""
    dim = one["dim"].as_py()
    anchors = matrix(one["q_v"].as_py(), one["q_n"].as_py(), dim)
    rows = matrix(one["v"].as_py(), one["n"].as_py(), dim)
    own, others = (one[c].values.to_numpy(zero_copy_only=False) for c in ("q_label", "label"))
    for at in range(0, len(anchors), STRIPE):
        part = slice(at, at + STRIPE)
        yield part, products(anchors[part], rows), own[part][:, None] == others


def _pairs_of_labels(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks and the chunks that share a label with them: those of one label have consecutive numbers."""
    of = chunks.select("dim", "number", F.explode(F.array_distinct("label")).alias("label"))
    spans = of.groupBy("dim", "label").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    asked = blocks.select(*PLACE, F.explode(F.array_distinct("label")).alias("label"))
    return asked.join(spans, ["dim", "label"]).select(*PLACE, F.explode(F.sequence("first", "last")).alias("number")).distinct()


def positives(blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(key, anchor_id, positive_rank, positive_id, positive_score): the best k other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, keys, own = _ids(one["vec_id"]), _ids(one["key"]), _ids(one["anchor_id"])
                place, known, values = tie_order(ids), np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for part, scores, alike in _stripes(one):
                    same = (own.to_numpy()[part][:, None] == values) & known
                    q, at = largest(scores, alike & ~same, place, k)
                    chosen = pa.array(q + part.start)
                    found = [keys.take(chosen), own.take(chosen), ids.take(pa.array(at)), pa.array(scores[q, at])]
                    yield pa.RecordBatch.from_arrays(found, names=["key", "anchor_id", "positive_id", "positive_score"])

    met = _joined(blocks, chunks, _pairs_of_labels(blocks, chunks), []).mapInArrow(
        run, "key long, anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("key").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last())
    return met.withColumn("positive_rank", F.row_number().over(best)).filter(F.col("positive_rank") <= k)


def _share(score: str, percent: int, up: bool) -> F.Column:
    """percent/100 of a whole number, rounded down or up, in whole numbers."""
    product = F.col(score).cast("decimal(38,0)") * F.lit(-percent if up else percent)
    quotient = F.floor(product / F.lit(100).cast("decimal(3,0)")).cast("long")
    return -quotient if up else quotient


def slotted(scores: np.ndarray, allowed: np.ndarray, uppers: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, slot, row) of the k best allowed rows of every slot; ``uppers`` descend and are padded with the least number."""
    out = []
    for j in range(uppers.shape[1]):
        below = uppers[:, j + 1, None] if j + 1 < uppers.shape[1] else np.iinfo(np.int64).min
        q, at = largest(scores, allowed & (scores <= uppers[:, j, None]) & (scores > below), place, k)
        out.append((q, np.full(len(q), j, np.int32), at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_slots(blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(key, slot, rank, negative_id, negative_score): the best k rows of other labels in each slot of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, keys = _ids(one["vec_id"]), _ids(one["key"])
                lists = one["uppers"].as_py()
                uppers = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).min)
                for row, values in zip(uppers, lists, strict=True):
                    row[: len(values)] = values
                lowest, place = one["lowest"].values.to_numpy(), tie_order(ids)
                for part, scores, alike in _stripes(one):
                    q, slot, at = slotted(scores, ~alike & (scores >= lowest[part][:, None]), uppers[part], place, k)
                    found = [keys.take(pa.array(q + part.start)), pa.array(slot), ids.take(pa.array(at)), pa.array(scores[q, at])]
                    yield pa.RecordBatch.from_arrays(found, names=["key", "slot", "negative_id", "negative_score"])

    sizes = chunks.groupBy("dim").agg((F.max("number")).alias("last"))
    pairs = blocks.select(*PLACE).join(sizes, "dim").select(*PLACE, F.explode(F.sequence(F.lit(0), "last")).alias("number"))
    met = _joined(blocks, chunks, pairs, ["uppers", "lowest"]).mapInArrow(run, "key long, slot int, negative_id long, negative_score long")
    best = Window.partitionBy("key", "slot").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    chunk_rows: int = 8192,
    block_rows: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of all anchors.

    ``vectors`` and ``anchors`` have a vec_id, a label and an array v of whole numbers. For each anchor and each of its best
    ``n_positives`` positives come the best ``n_negatives`` rows of other labels with a score between ``low_percent`` and
    ``high_percent`` of the positive's.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    by_label = [F.col("label"), F.col("vec_id")]
    chunks = saved(numbered(packed(rows, by_label, chunk_rows, [], "chunks")), "numbered")
    asked = anchors.select(
        F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("anchor_id"), F.col("label").cast("long").alias("label"), "v"
    )
    asked = saved(asked, "anchors")
    by_label = [F.col("label"), F.col("key")]
    best = saved(positives(packed(asked, by_label, block_rows, [], "blocks"), chunks, n_positives), "positives")
    limits = best.withColumn("low", _share("positive_score", low_percent, up=True)).withColumn("high", _share("positive_score", high_percent, up=False))
    limits = limits.filter(F.col("low") <= F.col("high"))
    slots = limits.groupBy("key").agg(F.sort_array(F.collect_set("high"), False).alias("uppers"), F.min("low").alias("lowest"))
    found = in_slots(packed(asked.join(slots, "key"), by_label, block_rows, [], "windows"), chunks, n_negatives)
    item = F.struct("slot", "rank", "negative_id", "negative_score")
    lists = saved(found.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items")), "slots")
    windows = limits.join(slots.select("key", "uppers"), "key").join(lists, "key")
    # slots count from 0, array positions from 1
    fits = lambda x: (x["slot"] >= F.array_position("uppers", F.col("high")) - 1) & (x["negative_score"] >= F.col("low"))
    first = F.slice(F.filter("items", fits), 1, n_negatives)
    names = ["anchor_id", "positive_id", "positive_rank", "positive_score"]
    flat = windows.select(*names, F.posexplode(first).alias("at", "item"))
    out = ["anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "item.negative_id", "positive_score", "item.negative_score", "positive_rank"]
    return flat.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).filter(F.col("label").isNotNull() & usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole("embedding", 256).alias("v"))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, p.vec_id AS other, a.label = p.label AS alike, CAST(list_inner_product(a.v, p.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors p ON a.vec_id <> p.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score,
           CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS INTEGER) AS positive_rank
    FROM scored WHERE alike
), ranked AS (
    SELECT anchor_id, positive_id, n.other AS negative_id, positive_score, n.score AS negative_score, positive_rank,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
    FROM positives JOIN scored n USING (anchor_id)
    WHERE positive_rank <= 5 AND NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM ranked WHERE rank <= 10
"""
