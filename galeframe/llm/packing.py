"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous steps.

Documents are encoded, ended by an end id and cut into pieces of at most ``length`` tokens. Pieces are sorted
by size; a piece is named by its size and its rank among the pieces of that size. Ranks are dealt out in
chunks with a running sum over the chunks' counts, so a size that a third of all pieces have is many tasks.

Sizes are whole numbers up to ``length``, so the sorted pieces, and the sorted gaps of the open sequences, are
runs of equal numbers: at most ``length`` runs of pieces, however many pieces there are. A step takes the
pieces of the largest size left. Their successor sweep goes up the gap runs from the smallest that fits;
each run of gaps takes as many pieces as fit, and which piece gets which gap is settled by rank: the i-th
piece of a stretch goes to the i-th gap of it. The gaps that are left over go back as shorter ones, pieces
without a gap open new sequences, and the next step begins. The result is that of best-fit decreasing over
all pieces. Steps work on runs alone and leave a table of stretches (size, first rank, number, first
sequence, offset), whose size is bounded by ``length``; then every task looks up its pieces' stretches by
successor search, all at once.

Defined cases: a missing or empty text is the end id alone; repeated rows are packed as documents of their
own; ties in size are broken by doc_id, piece and checksum; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.llm.common import documents, parts, saved, text_of

LENGTH = 1024
END = 2
SLICE = 4 << 20
#: Other characters go to the tokenizers library itself: its tables of letters and white space may be of another Unicode version.
PLAIN = re.compile("[\t\n\r -~\xa1-ſ‐-‧]*")
TWO_SPACES = re.compile(r"\s\s|\s\Z")


class Encoder:
    """Ids of whole texts, those of the tokenizers library for ``<name>.json``; ``<name>.tiktoken`` has the same ranks."""

    def __init__(self, path: str) -> None:
        self.exact = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        make = lambda p: tiktoken.Encoding(path, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        # Where no two white spaces meet, the pattern needs no look-ahead, which is faster.
        self.general, self.simple = make(pattern), make(pattern.replace(r"\s+(?!\S)|", ""))

    def __call__(self, text: str) -> list[int]:
        if not PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return (self.general if TWO_SPACES.search(text) else self.simple).encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n tokens; only the first may be shorter than ``length`` if there are more."""
    first = n % length or length
    return [(0, min(n, first)), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column(1)), SLICE):
                rows = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text), end], "<u4")
                    for k, (start, size) in enumerate(cuts(len(ids), length)):
                        rows.append((i, k, start, size, zlib.crc32(ids[start : start + size])))
                at, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [part.column(0).take(pa.array(at)), *(pa.array(v, t) for v, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: dict[int, int], length: int) -> np.ndarray:
    """Stretches (size, rank, number, sequence, offset), sorted by size and rank, of so many pieces of each size."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by room left: runs (first sequence, number)
    out, opened = [], 0

    def fill(size: int, rank: int, left: int, room: int, first: int, number: int) -> int:
        """Put up to ``left`` pieces into a run of gaps, as many a gap as fit; the number of pieces placed."""
        each = room // size
        full, rest = divmod(min(left, number * each), each)
        for k in range(each if full else 0):
            out.append((size, rank + k * full, full, first, length - room + k * size))
        for k in range(rest):  # one more gap takes the last few
            out.append((size, rank + each * full + k, 1, first + full, length - room + k * size))
        for run, used in (((first, full), each), ((first + full, 1 if rest else 0), rest), ((first + full + (rest > 0), number - full - (rest > 0)), 0)):
            if run[1] and room - used * size:
                gaps[room - used * size].append(run)
        return each * full + rest

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        for room in range(size, length + 1):
            runs, gaps[room] = gaps[room], []
            while runs and left:
                placed = fill(size, rank, left, room, *runs.pop())
                rank, left = rank + placed, left - placed
            gaps[room] += runs
        if left:
            number = -(-left // (length // size))
            fill(size, rank, left, length, opened, number)
            opened += number
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, most: int, chunk_rows: int) -> DataFrame:
    """``rows`` with a rank from 0 among those of equal length, dealt out in chunks of about ``chunk_rows`` rows."""
    chunks = max(1, -(-most // chunk_rows))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    by_chunk = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    before = before.select("length", "_chunk", F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    placed = rows.withColumn("_inside", F.row_number().over(inside)).join(before, ["length", "_chunk"])
    return placed.withColumn("_rank", F.col("_before") + F.col("_inside") - 1).drop("_chunk", "_before", "_inside")


def pack(rows: DataFrame, length: int = LENGTH, chunk_rows: int = 1000) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset there."""
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    plan = best_fit(sizes, length)  # at most a few stretches for each pair of sizes
    wide = max(sizes.values(), default=0) + 1
    keys = plan[:, 0] * wide + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, size * wide + rank, side="right") - 1
            sequence, offset = plan[at, 3] + rank - plan[at, 1], plan[at, 4]
            columns = [*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(rows.dtypes)["doc_id"]
    placed = ranked(rows.select(*names), wide - 1, chunk_rows)
    return placed.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """All pieces of ``docs`` with their places in sequences."""
    return pack(saved(pieces(docs, vocabulary, length, end), "pieces"), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
