"""Substring dedup by level-wise doubling of word windows.

A window of ``words`` words that occurs in a document with a smaller doc_id is removed from the later one. Windows are found
in levels of half the length, the full length and, with ``extend``, twice that, four times and so on until none is left;
only what is repeated at one level is looked at in the next:

* Half length: each document names anchors, the windows of half length whose hash is the smallest among the
  ones that some full window holds. The choice depends on content alone, so equal full windows hold the same
  anchor at the same place, and about one position in thirteen needs a row. Anchors that two documents share
  survive. (All positions would be as many rows as words.)
* Full length: only the full windows around surviving anchors are hashed and compared. Of each, all but those
  in the smallest doc_id are removed.
* Beyond: a window of twice the length is a candidate if both its halves survived; its hash is made of theirs. The last
  level that a document has a repeated window in is its ``longest``.

Documents with equal words are settled by one digest before, so copies never enter the levels. Hashes are
rolled over prefix sums; those that decide have 128 bits a window; rows carry numbers only. Smallest and largest
doc_ids are combined in each task before a shuffle, and the joins back read written tables, so a passage that a third of all
documents hold is split like any skewed join. Spans go to the texts by a broadcast up to
``broadcast_bytes``, counted before, and by a shuffle join beyond.

Defined cases: a missing text has no words; a missing doc_id comes after all others, and rows without one don't
remove each other; repeated rows keep and lose the same words; shorter documents lose nothing; windows inside
one document alone are no repeats; an empty table gives an empty table; further columns are kept, names beginning like those
of ``KEY``, ``_text`` and ``_spans`` are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.common import bounded, documents, parts, saved, scratch, text_of

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEY = ["_order", "_text_hash"]
SLICE = 4 << 20
SPANS = "array<struct<start:int,end:int>>"


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolled:
    """Hashes of any window of one document's words, rolled over sums of word hashes times powers of one base."""

    def __init__(self, parts_: list[bytes], which: int = 0) -> None:
        n, base = len(parts_), BASES[which]
        self.n, size = n, 1 << max(10, n.bit_length())
        values = np.fromiter((xxhash.xxh64_intdigest(w, which) for w in parts_), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, size)[:n], dtype=np.uint64)])
        self.back = _powers(pow(base, -1, 1 << 64), size)

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def anchors(rolled: Rolled, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of half windows, at least one in every full window, the same ones in equal windows."""
    half = words // 2
    if rolled.n < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolled.hashes(np.arange(rolled.n - half + 1), half)
    span = words - half + 1
    chosen = []
    for at in range(0, len(h) - span + 1, 1 << 20):  # bounded work space for very long texts
        view = np.lib.stride_tricks.sliding_window_view(h[at : at + (1 << 20) + span - 1], span)
        chosen.append(np.unique(view.argmin(axis=1) + np.arange(len(view)) + at))
    places = np.unique(np.concatenate(chosen))
    return places, h[places]


def full_starts(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Starts of all full windows that hold a half window at one of the places."""
    around = np.zeros(n + 1, np.int64)
    low = np.maximum(places - (words - words // 2), 0)
    np.add.at(around, low, 1)
    np.add.at(around, places + 1, -1)
    return np.flatnonzero(np.cumsum(around)[: n - words + 1] > 0)


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the order of its doc_id and a hash of its text, which together name a document."""
    last = F.lit((1 << 63) - 1)
    return docs.withColumns({KEY[0]: F.coalesce(F.col("doc_id").cast("long"), last), KEY[1]: F.xxhash64(text_of("text"))})


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Per document its key, number of words, 128-bit digest of them and anchors (h, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column(2)), SLICE):
                counts, one, two, found = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = _split(text)
                    digest = np.frombuffer(hashlib.blake2b(b" ".join(own), digest_size=16).digest(), np.int64)
                    counts.append(len(own))
                    one.append(int(digest[0]))
                    two.append(int(digest[1]))
                    found.append(anchors(Rolled(own), words))
                offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])])
                rows = pa.StructArray.from_arrays(
                    [
                        pa.array(np.concatenate([h for _, h in found]), pa.int64()),
                        pa.array(np.concatenate([p for p, _ in found]), pa.int32()),
                    ],
                    names=["h", "p"],
                )
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
                columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(one, pa.int64())]
                names = [*KEY, "n_words", "wa", "wb", "anchors"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(two, pa.int64()), lists], names=names)

    kind = "n_words long, wa long, wb long, anchors array<struct<h:long,p:int>>"
    rows = keyed(docs).select(*KEY, text_of("text").alias("text"))
    return rows.mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, {kind}")


def shared(rows: DataFrame, keys: list[str], name: str = "shared") -> DataFrame:
    """The hashes that documents of different order hold, with the smallest of them (low)."""
    ends = rows.groupBy(*keys).agg(F.min(KEY[0]).alias("low"), F.max(KEY[0]).alias("high"))
    return saved(ends.filter("low < high").select(*keys, "low"), name)


def surviving(windows: DataFrame) -> DataFrame:
    """The windows (key, ha, hb, s) that documents of different order hold, with the smallest of them (low); their table is gone after."""
    with scratch() as keep:
        windows = saved(windows, "windows")
        return keep(saved(windows.join(shared(windows, ["ha", "hb"]), ["ha", "hb"]), "survivors"))


def full_windows(found: DataFrame, words: int) -> DataFrame:
    """(key, ha, hb, s) of the full windows around the places of a table (key, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column(2)), SLICE):
                starts, one, two = [], [], []
                for text, places in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    own = _split(text)
                    starts.append(full_starts(np.asarray(places, np.int64), len(own), words))
                    one.append(Rolled(own, 0).hashes(starts[-1], words))
                    two.append(Rolled(own, 1).hashes(starts[-1], words))
                times = [len(s) for s in starts]
                keys = [pa.array(np.repeat(part.column(i).to_numpy(), times), pa.int64()) for i in (0, 1)]
                rows = [pa.array(np.concatenate(one), pa.int64()), pa.array(np.concatenate(two), pa.int64())]
                yield pa.RecordBatch.from_arrays([*keys, *rows, pa.array(np.concatenate(starts), pa.int32())], names=[*KEY, "ha", "hb", "s"])

    rows = found.select(*KEY, "text", "places")
    return rows.mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, ha long, hb long, s int")


def doubled(survivors: DataFrame, length: int) -> DataFrame:
    """(key, ha, hb, s) of the windows of twice the length whose halves both survive."""
    ahead = Window.partitionBy(*KEY).orderBy("s").rangeBetween(length, length)  # a document at a time, of which a task holds the text too
    both = survivors.select(*KEY, "ha", "hb", "s").withColumns({"ha2": F.max("ha").over(ahead), "hb2": F.max("hb").over(ahead)})
    both = both.filter(F.col("ha2").isNotNull())
    return both.select(*KEY, F.xxhash64("ha", "ha2").alias("ha"), F.xxhash64(F.lit(1), "hb", "hb2").alias("hb"), "s")


def spans_of(windows: DataFrame, words: int) -> DataFrame:
    """(key, spans) of windows (key, s), repeats included: spans that don't touch, from one pass over the sorted starts."""
    in_order = Window.partitionBy(*KEY).orderBy("s")
    opens = F.coalesce(F.col("s") - F.lag("s").over(in_order) > words, F.lit(True)).cast("int")
    rows = windows.withColumn("opens", opens)
    rows = rows.withColumn("island", F.sum("opens").over(in_order))
    spans = rows.groupBy(*KEY, "island").agg(F.min("s").alias("start"), (F.max("s") + words).cast("int").alias("end"))
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(docs: DataFrame, words: int = 50, broadcast_bytes: int = 64 << 20, extend: bool = False) -> DataFrame:
    """(key, spans, longest) of the documents with repeats: spans of words to lose, the end excluded, and the last level.

    With ``extend`` levels go on beyond ``words`` until no candidate survives, else ``longest`` is of no use.
    """
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    nothing = F.array().cast(SPANS)
    levels = F.floor(F.log2(F.col("n_words") / words))
    with scratch() as keep:
        with scratch() as found:
            with scratch() as still:
                table = saved(survey(docs, words), "survey")
                sets = table.groupBy("wa", "wb").agg(F.min(KEY[0]).alias("first"), F.max(KEY[0]).alias("last")).filter("first < last")
                marked = table.join(saved(sets.drop("last"), "copies"), ["wa", "wb"], "left")
                copies = marked.filter(F.col("first").isNotNull() & (F.col("n_words") >= words)).select(
                    *KEY, F.when(F.col(KEY[0]) > F.col("first"), whole).otherwise(nothing).alias("spans"), (F.lit(words) * F.pow(F.lit(2.0), levels)).cast("long").alias("longest")
                )
                copies = found(still(saved(copies, "whole")))
                single = marked.filter(F.col("first").isNull() | (F.col(KEY[0]) == F.col("first")))
                halves = still(saved(single.select(*KEY, F.inline("anchors")), "halves"))
            places = halves.join(shared(halves, ["h"]).select("h"), "h").groupBy(*KEY).agg(F.collect_set("p").alias("places"))
            places = found(saved(places, "places"))
        texts = keyed(docs).select(*KEY, text_of("text").alias("text"))
        survivors = surviving(full_windows(texts.join(bounded(places, "places", broadcast_bytes), KEY), words))
        spans = spans_of(survivors.filter(F.col(KEY[0]) > F.col("low")).select(*KEY, "s"), words)
        longest, length = survivors.select(*KEY, F.lit(words).cast("long").alias("longest")).distinct(), words
        while extend and not survivors.isEmpty():
            survivors, length = surviving(doubled(survivors, length)), 2 * length
            longest = longest.unionByName(survivors.select(*KEY, F.lit(length).cast("long").alias("longest")).distinct())
        ends = longest.join(spans, KEY, "left").select(*KEY, F.coalesce("spans", nothing).alias("spans"), "longest").unionByName(copies)
        # The first of equal documents is found by either way; what it loses is empty in one of them.
        most = F.max_by("spans", F.size("spans")).alias("spans")
        return keep(saved(ends.groupBy(*KEY).agg(most, F.max("longest").alias("longest")), "spans"))


def remove_repeats(docs: DataFrame, words: int = 50, broadcast_bytes: int = 64 << 20, extend: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the words that stay joined by single spaces.

    With ``extend`` levels go on until none is left; also ``longest``, the length of the last level in which the document has
    a repeated window, 0 if none.
    """
    if reserved := {c.lower() for c in docs.columns} & {*KEY, "_text", "_spans"}:
        raise ValueError(f"reserved column names: {sorted(reserved)}")
    spans = bounded(repeated_spans(docs, words, broadcast_bytes, extend), "spans", broadcast_bytes)
    new = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "longest": pa.int64()}
    names = [c for c in docs.columns if c.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column("_text")), SLICE):
                counts, removed, kept = [], [], []
                for text, cut in zip(part.column("_text").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    own, stays, at = _split(text), [], 0
                    for span in cut or ():
                        stays += own[at : span["start"]]
                        at = span["end"]
                    stays += own[at:]
                    counts.append(len(own))
                    removed.append(len(own) - len(stays))
                    kept.append(b" ".join(stays).decode("utf-8", "surrogatepass"))
                columns = [counts, removed, kept, pc.fill_null(part.column("longest"), 0)]
                values = [pa.array(v, t) for v, t in zip(columns, new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *values], names=[*names, *new])

    rows = keyed(docs.select(*(f"`{c}`" for c in names))).join(spans.withColumnRenamed("spans", "_spans"), KEY, "left")
    rows = rows.select(*(f"`{c}`" for c in names), text_of("text").alias("_text"), "_spans", "longest")
    made = T.StructType.fromDDL("n_words long, n_removed long, kept_text string, longest long")
    out = rows.mapInArrow(run, T.StructType([*rows.select(*(f"`{c}`" for c in names)).schema.fields, *made.fields]))
    return out if extend else out.drop("longest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own
    FROM documents
), words AS (
    SELECT doc_id, unnest(generate_series(1, len(own))) AS pos, unnest(own) AS word FROM texts
), starts AS (
    SELECT doc_id, own, unnest(generate_series(1, len(own) - 49)) AS s FROM texts WHERE len(own) >= 50
), windows AS (
    SELECT doc_id, s, md5(array_to_string(own[s:s + 49], ' ')) AS h FROM starts
), firsts AS (
    SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS pos FROM windows JOIN firsts USING (h) WHERE doc_id > low
), judged AS (
    SELECT w.doc_id, w.pos, w.word, g.pos IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos
)
SELECT t.doc_id, CAST(len(any_value(own)) AS BIGINT) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM texts t LEFT JOIN judged j ON t.doc_id = j.doc_id GROUP BY t.doc_id
"""
