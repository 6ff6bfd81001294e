"""SentencePiece encoding and decoding by a table of distinct chunks.

The library turns each space into the marker and puts one in front of the text. No piece of the vocabulary
has a marker behind another character (``crosses_markers`` checks it), so no merge runs across the start of
a marked word: every run of markers with the word behind it can be segmented alone. Each task keeps a table
of the distinct marked words it has met, segments each once and joins the ids back by position. The table
holds at most ``table_rows`` words and then begins anew, so memory is bounded and results do not depend on
it. No shuffle is needed: a word that is frequent in the corpus is frequent in every task.

Defined cases: a missing or empty text has no ids and decodes to the empty text; an empty table gives an
empty table; all other columns are kept (one named like the output is replaced).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.common import documents, parts, text_of

MARKER = "▁"
_CHUNK = re.compile(" *[^ ]*")


@lru_cache(maxsize=4)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=4)
def crosses_markers(model: str) -> bool:
    """Whether a piece goes on into the next marked word, so that words can't be segmented alone."""
    sp = processor(model)
    return any(re.search(f"[^{MARKER}]{MARKER}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, which the library adds again."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [c[1:] for c in _CHUNK.findall(" " + text) if c]


class ChunkTable:
    """Distinct chunks of a task with their ids, laid out one after another."""

    def __init__(self, model: str, table_rows: int) -> None:
        self.sp, self.limit = processor(model), table_rows
        if crosses_markers(model):
            raise ValueError("pieces of this vocabulary cross word markers; words can't be segmented alone")
        self.lone = [self.sp.piece_to_id(MARKER)]
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = defaultdict(count().__next__)  # a new chunk gets the next number
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        found = self.sp.encode(new, num_threads=1)
        found = [ids if chunk else self.lone for ids, chunk in zip(found, new, strict=True)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate([self.start, self.ids.size + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))])

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text."""
        if len(self.rows) > self.limit:
            self._clear()
        split = [chunks(t) for t in texts]
        known = len(self.rows)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.rows) > known:
            self._learn(list(islice(self.rows, known, None)))
        length = self.length[at]
        ends = np.cumsum(length)
        flat = self.ids[np.repeat(self.start[at] - (ends - length), length) + np.arange(ends[-1] if ends.size else 0)]
        ends = np.concatenate([[0], ends])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, batch.column(n)) for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [values], names=[n for n, _ in kept] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids", table_rows: int = 400_000) -> DataFrame:
    """``df`` with the ids of its texts, exactly those of the library."""
    df = df.withColumn(text, text_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, table_rows)
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column(text)), 4 << 20):
                yield _with(part, out, table.encode(part.column(text).to_pylist()))

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the library makes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for part in parts(batch, pc.list_value_length(batch.column(ids)), 1 << 20):
                column = part.column(ids)
                cuts = np.asarray(column.offsets)
                own = column.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))  # ``values`` are those of the whole batch
                flat = own.to_numpy(zero_copy_only=False).tolist()  # far faster than lists of Arrow values
                cuts = (cuts - cuts[0]).tolist()
                texts = sp.decode([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], num_threads=1)
                yield _with(part, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, out, T.StringType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"), model).drop("text")
    return decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
