"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed per document and collapsed to the distinct ones, so copies never meet each other.
A fingerprint is cut into two segments of 32 bits. If two differ in at most three bits, one of their segments
differs in at most one. So each segment value is looked up with its Hamming ball of radius one: the value
itself and, since of two values that differ in one bit one has it set, only those with one set bit cleared.
Matches are joined by (segment, value) and their complete distance is verified; a pair is kept at the first
segment that finds it. Values that ``hot`` or more fingerprints share get a second key, a byte of the other
segment: with at most three bits left, one of its four bytes is equal. That is exact and splits such groups.
Links run between distinct fingerprints; components of links are found by star rounds.

Defined cases: a missing or blank text has fingerprint zero and is linked like any other; repeated rows and
equal texts share a fingerprint; component_id is the smallest doc_id of the component, missing only where no
row of it has one; an empty table gives an empty table; further columns are kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import ROW, bounded, documents, row_key, saved, text_of
from galeframe.llm.components import components

SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the word shingles of a text in lower case (A-Z), as a signed 64-bit number."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    h = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return majority(np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):  # bounded work space for very long texts
        part = hashes[at : at + (1 << 18)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, the row key and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], names=["doc_id", *ROW, "fp"])

    rows = docs.select("doc_id", *row_key(), text_of("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {ROW[0]} long, {ROW[1]} long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, seg, value, other): each segment of a fingerprint with the remaining one."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    part = lambda i, a, b: F.struct(F.lit(i).alias("seg"), a.alias("value"), b.alias("other"))
    return fps.select("fp", F.inline(F.array(part(0, low, high), part(1, high, low))))


def _ball(value: str) -> Column:
    """The value and all that have one of its set bits cleared."""
    cleared = [F.col(value).bitwiseAND(0xFFFFFFFF ^ (1 << i)) for i in range(32)]
    return F.array_distinct(F.array(F.col(value), *cleared))


def _byte(column: str, i: int) -> Column:
    return F.shiftrightunsigned(column, 8 * i).bitwiseAND(255)


def _split(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """The second key: a byte of the other segment for crowded values, in four rows, and none for the rest."""
    if crowded is None:
        return rows.withColumns({"byte": F.lit(-1), "part": F.lit(0).cast("long")})
    key = lambda i, b: F.struct(F.lit(i).alias("byte"), b.alias("part"))
    each = F.array(*(key(i, _byte("other", i)) for i in range(4)))
    keys = F.when(F.col("crowd"), each).otherwise(F.array(key(-1, F.lit(0).cast("long"))))
    marked = rows.join(crowded, ["seg", "value"], "left")
    return marked.select(*rows.columns, F.inline(keys))


def links(fps: DataFrame, bits: int = 3, hot: int = 256) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (a column fp) that differ in at most ``bits`` bits, up to three."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    table = _segments(fps)
    crowded = saved(
        table.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= hot).select("seg", "value", F.lit(True).alias("crowd")),
        "crowded",
    )
    crowded = None if crowded.isEmpty() else crowded
    probes = table.select("fp", "seg", "other", F.explode(_ball("value")).alias("value"))
    left = _split(probes, crowded).withColumnsRenamed({"fp": "a", "other": "rest"})
    right = _split(table, crowded).withColumnsRenamed({"fp": "b", "other": "rest2"})
    found = left.join(right, ["seg", "value", "byte", "part"])
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.bit_count(apart.bitwiseAND(0xFFFFFFFF))
    second = F.bit_count(F.shiftrightunsigned(apart, 32))
    differ = F.col("rest").bitwiseXOR(F.col("rest2"))
    # Equal values meet from both sides, and a pair may meet at both segments or at several bytes: keep it once.
    once = (F.col("a") < F.col("b")) | (F.when(F.col("seg") == 0, first).otherwise(second) > 0)
    by_segment = (F.col("seg") == 0) | (first > 1)
    zero = [F.shiftrightunsigned(differ, 8 * i).bitwiseAND(255) == 0 for i in range(4)]
    first_equal = F.coalesce(*(F.when(z, F.lit(i)) for i, z in enumerate(zero)))
    by_byte = (F.col("byte") < 0) | (F.col("byte") == first_equal)
    near = (F.col("a") != F.col("b")) & (first + second <= bits)
    return found.filter(near & once & by_segment & by_byte).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, hot: int = 256) -> DataFrame:
    """doc_id, row key, fp, root and component_id of every row; components join documents over links of at most ``bits`` bits."""
    rows = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(links(fps.select("fp"), bits, hot)).withColumnRenamed("node", "fp")
    rooted = fps.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def first_of_each(docs: DataFrame, found: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row of ``docs`` for each root in ``found`` (doc_id, row key, root): that of its smallest doc_id.

    Keys of the rows that stay are broadcast to the texts up to ``broadcast_bytes``, counted before, and joined by a
    shuffle beyond. Only rows whose key is repeated are shuffled with their text, to leave one of each.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)
    winners = found.groupBy("root").agg(F.min(rank).alias("best")).select(*(F.col(f"best.{k}") for k in ROW))
    winners = bounded(saved(winners, "winners"), limit=broadcast_bytes)
    repeated = found.groupBy(*ROW).agg(F.count("*").alias("n")).filter("n > 1").select(*ROW)
    repeated = bounded(saved(repeated, "repeated"), limit=broadcast_bytes)
    stays = docs.withColumns(dict(zip(ROW, row_key(), strict=True))).join(winners, ROW, "left_semi")
    single = stays.join(repeated, ROW, "left_anti")
    return single.unionByName(stays.join(repeated, ROW, "left_semi").dropDuplicates(ROW)).select(*docs.columns)


def keep_one(docs: DataFrame, words: int = 3, bits: int = 3, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest doc_id."""
    return first_of_each(docs, near_duplicates(docs, words, bits), broadcast_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
