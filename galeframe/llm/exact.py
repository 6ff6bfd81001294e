"""Exact deduplication in two passes around a Bloom filter, with DataFrame functions only.

Texts are reduced once to a thin table of digests. Pass one sets up to two bits per row in blocks of 32,768
bits and keeps the bits that two or more rows have hit: counts are combined in each task before they are
shuffled, so a third of all rows with one text is one row per task. What is shuffled here are pairs of numbers
(block, bit) with a count, two for a row that is alone in its task; no text, digest or doc_id. Pass two tests every row
against those bits. Rows with an unset bit have no equal and go straight to the result; only the others are
shuffled with their digest, for the exact grouping by SHA-256.

The filter has ``bits_per_row`` bits for each row, at most twice that. Up to ``broadcast_bytes``, counted before, it is
broadcast, so that unique rows' digests are never shuffled; beyond that the thin rows meet their block by a shuffle join
instead. Either way a false positive costs a shuffled row and nothing else.

Defined cases: a missing text is empty; a missing doc_id loses against any other and stays if it is alone;
repeated rows of one doc_id count one by one in group_size and stay or go together; an empty table gives an
empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import documents, saved, text_of, without_spaces

BLOCK_BYTES = 4096
BLOCK_BITS = 8 * BLOCK_BYTES


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sha, h): length of the original text, digest and short hash of the text without white space."""
    text = text_of("text")
    rows = docs.select("doc_id", F.char_length(text).alias("n"), without_spaces(text).alias("bare"))
    return rows.select("doc_id", "n", F.sha2("bare", 256).alias("sha"), F.xxhash64("bare").alias("h"))


def with_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """The block of each row and its two bits there, from different parts of the hash."""
    part = lambda shift: F.shiftrightunsigned("h", shift)
    return rows.withColumns(
        {"block": F.pmod("h", F.lit(blocks)), "bit1": part(33).bitwiseAND(BLOCK_BITS - 1), "bit2": part(48).bitwiseAND(BLOCK_BITS - 1)}
    )


def repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """Pass one: (block, bits), the bits that at least two rows have hit."""
    hits = with_bits(rows, blocks).select("block", F.explode(F.array_distinct(F.array("bit1", "bit2"))).alias("bit"))
    often = hits.groupBy("block", "bit").agg(F.count("*").alias("n")).filter("n > 1")
    return often.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _set(bit: str) -> Column:
    """Whether the block's bitmap has the bit; bit i of a bitmap is bit i % 8 of byte i / 8."""
    byte = F.conv(F.hex(F.expr(f"substring(bits, CAST({bit} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return F.getbit(byte, F.expr(f"CAST({bit} % 8 AS INT)")) == 1


def deduplicate(docs: DataFrame, bits_per_row: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    rows = saved(digests(docs), "digests")
    blocks = 1 << max(0, math.ceil(math.log2(max(1, rows.count() * bits_per_row / BLOCK_BITS))))
    bits = repeated_bits(rows, blocks)
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        bits = bits.hint("broadcast")
    tested = with_bits(rows, blocks).join(bits, "block", "left")
    suspect = F.coalesce(_set("bit1") & _set("bit2"), F.lit(False))
    alone = tested.filter(~suspect).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    suspects = tested.filter(suspect).select("doc_id", "n", "sha")
    groups = suspects.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("n", -F.col("doc_id"))).alias("best"))
    # Written first: rows then meet a table, not an aggregate, and a group with very many rows is split in the join.
    grouped = suspects.join(saved(groups, "groups"), "sha").select(
        "doc_id",
        (-F.col("best.col2")).alias("keep_id"),
        "group_size",
        (-F.col("best.col2")).eqNullSafe(F.col("doc_id")).alias("kept"),
        "sha",
    )
    return alone.unionByName(grouped).withColumnRenamed("sha", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), placed AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
    FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM placed
"""
