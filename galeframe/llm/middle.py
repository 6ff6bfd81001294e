"""Fill-in-the-middle order of documents, cut at line boundaries by a learned rank index.

A text is cut into units, lines with their line feed. The index learns where they end: over the points (rank, offset), with
offsets in code points, it fits straight segments one after the other, each as long as one slope from its first point keeps
every point within ``ERROR`` code points (the cone of such slopes is narrowed point by point), and stores what remains per
point in one byte. A cut at a rank is the prediction of its segment plus the stored residual, which is exact. Two
cuts, drawn by a hash of doc_id, give prefix, middle and suffix, which are put together behind marks in one of two orders;
``restore`` undoes that.

Every document is handled alone, by its own row, so nothing is shuffled. Defined cases: a missing text is empty; an empty
text, one that holds a mark, and what is beyond the rate stay plain; a missing doc_id draws as the empty word; repeated rows
have equal results; a line beyond any length is one unit; an empty table gives an empty table; further columns are
ignored (``transform`` keeps those that it doesn't make).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.common import documents, parts, text_of

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Residuals stay within one signed byte.
ERROR = 100
SLICE = 4 << 20
NEW = {
    "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
    "output": pa.string(), "n_segments": pa.int64(),
}


def boundaries(raw: bytes) -> np.ndarray:
    """Offsets in code points of the starts of all units of a UTF-8 text, and of its end."""
    if not raw:
        return np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    starts = starts[:-1] if starts[-1] == len(data) else starts
    first = (data & 0xC0) != 0x80  # not a continuation byte
    sizes = np.add.reduceat(first, starts, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


class RankIndex(NamedTuple):
    """Straight segments from rank to offset, and what they miss at each rank."""

    firsts: np.ndarray
    origins: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.origins[segment] + np.floor(self.slopes[segment] * (ranks - self.firsts[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of ranks: predicted, then corrected."""
        return self.predict(ranks) + self.residuals[ranks]


def _cone(offsets: np.ndarray, start: int, error: int) -> tuple[int, float]:
    """(end, slope) of the longest segment from a point: all points before the end are within the error."""
    low, high, at, width = -np.inf, np.inf, start + 1, 32
    while at < len(offsets):
        run = np.arange(at, min(at + width, len(offsets)))
        step, rise = run - start, offsets[run] - offsets[start]
        lows = np.maximum(np.maximum.accumulate((rise - error) / step), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / step), high)
        shut = np.flatnonzero(lows > highs)
        if len(shut):
            end = int(run[shut[0]])
            if shut[0]:
                low, high = lows[shut[0] - 1], highs[shut[0] - 1]
            return end, float(low + high) / 2 if end > start + 1 else 0.0
        low, high, at, width = lows[-1], highs[-1], at + width, min(2 * width, 1 << 16)
    return len(offsets), float(low + high) / 2 if len(offsets) > start + 1 else 0.0


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index over offsets by rank, each segment as long as it can be."""
    firsts, slopes, at = [], [], 0
    while at < len(offsets):
        firsts.append(at)
        at, slope = _cone(offsets, at, error)
        slopes.append(slope)
    starts = np.array(firsts, np.int64)
    index = RankIndex(starts, offsets[starts], np.array(slopes), np.zeros(len(offsets), np.int16))
    missed = offsets - index.predict(np.arange(len(offsets)))
    return index._replace(residuals=missed.astype(np.int16 if np.abs(missed).max() > 127 else np.int8))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from a hash of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arranged(text: str, raw: bytes, doc_id: int | None, rate: int, spm_rate: int, seed: int) -> tuple:
    """n, form, code points of prefix and middle, output and number of segments of a text."""
    offsets = boundaries(raw)
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text, 0
    index = fit(offsets)
    a, b = index.offsets(np.sort([h1 % (n + 1), h2 % (n + 1)])).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), len(index.firsts)
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), len(index.firsts)


def transform(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` with n units, form (plain, psm or spm), prefix_chars, middle_chars, output and n_segments of the index.

    ``rate`` per cent of the documents are rearranged, ``spm_rate`` per cent of those with the suffix first.
    """
    names = [c for c in docs.columns if c.lower() not in NEW and c.lower() != "text"]
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("string").alias("id"), text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts(batch, pc.binary_length(batch.column(2)), SLICE)):
            made = []
            for doc_id, text in zip(part.column(1), part.column(2), strict=True):
                made.append(arranged(text.as_py(), text.as_buffer().to_pybytes(), doc_id.as_py(), rate, spm_rate, seed))
            new = [pa.array(v, t) for v, t in zip(zip(*made, strict=True), NEW.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *new], names=["row", "text", *NEW])

    kinds = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string, n_segments long")
    out = kept.mapInArrow(run, T.StructType([kept.schema["row"], kept.schema["text"], *kinds.fields]))
    return out.select(*(F.col(f"row.`{c}`") for c in names), *([] if "text" in names else ["text"]), *NEW)


def restore(output: Column, form: Column) -> Column:
    """The text of an output: none of the marks occurs in a text that was rearranged, so each first one is the mark."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    middle = F.substr(rest, F.locate(MIDDLE, rest) + len(MIDDLE))
    ahead = F.left(rest, F.locate(MIDDLE, rest) - 1)
    cut = lambda mark: (F.left(ahead, F.locate(mark, ahead) - 1), F.substr(ahead, F.locate(mark, ahead) + len(mark)))
    prefix, suffix = cut(SUFFIX)
    suffix_first, prefix_second = cut(PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(output)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir).select("doc_id", "text"))
    again = restore(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS own,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT *, len(own) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
           CAST('0x' || h[25:32] AS UBIGINT) AS h4
    FROM units
), cut AS (
    SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                   WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
    FROM drawn
), parted AS (
    SELECT *, array_to_string(own[1:a], '') AS prefix, array_to_string(own[a + 1:b], '') AS middle, array_to_string(own[b + 1:n], '') AS suffix
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
