"""Chat formatting: token-level assembly of turns with a loss mask that can be read back.

A turn becomes ``<s>[INST]role[/INST]text</s>``. Role and text are encoded as segments of their own and
the four control tokens are spliced in as reserved ids, so no content can ever produce one of them. The
same holds for the rendered string: control strings in a role or text are broken by an escape, which
``unescape`` undoes. Turns do not depend on each other, so formatting needs no shuffle; only reading a
conversation back runs over its turns in order, as a stream with a few counters of state.

Defined cases: a missing text or role is empty; repeated turn numbers are ordered by their formatted
string; a missing conv_id is a conversation of its own; an empty table gives an empty table; further
columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import text_of

#: The control strings in the order of their reserved ids.
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
#: The first of the four reserved ids; the vocabulary ends below it.
RESERVED = 50257
ESCAPE = "␛"
BREAK, SELF = ESCAPE + "c", ESCAPE + "e"

_NEEDS_ESCAPE = re.compile(ESCAPE + "|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(f"{ESCAPE}[ce]")


def escape(text: str) -> str:
    """Put a break after the first character of every control string; the escape character itself is doubled up."""
    return _NEEDS_ESCAPE.sub(lambda m: SELF if m[0] == ESCAPE else m[0] + BREAK, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[0] == SELF else "", text)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(role: str, text: str, trained: bool, enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn and its loss mask: +1 where a trained segment begins, -1 after it, summed up."""
    segments = [[RESERVED], [RESERVED + 1], enc.encode_ordinary(escape(role)), [RESERVED + 2]]
    segments += [enc.encode_ordinary(escape(text)), [RESERVED + 3]]
    starts = np.cumsum([0] + [len(s) for s in segments])
    steps = np.zeros(starts[-1] + 1, np.int8)
    if trained:
        steps[starts[4]] += 1
        steps[starts[5]] -= 1
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps[:-1], dtype=np.int8)


def render(ids: np.ndarray, enc: tiktoken.Encoding) -> str:
    """The string of formatted ids, control tokens as their strings."""
    cuts = np.flatnonzero(ids >= RESERVED)
    out, at = [], 0
    for c in cuts.tolist():
        out += [enc.decode(ids[at:c].tolist()), CONTROL[int(ids[c]) - RESERVED]]
        at = c + 1
    return "".join([*out, enc.decode(ids[at:].tolist())])


def format_turns(turns: DataFrame, vocabulary: str, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, ids, mask (1 under the loss) and formatted, the rendered string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            rows = [assemble(r, t, r in trained_roles, enc) for r, t in zip(b["role"], b["text"], strict=True)]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "turn": b["turn"],
                    "ids": [i for i, _ in rows],
                    "mask": [m for _, m in rows],
                    "formatted": [render(i, enc) for i, _ in rows],
                }
            )

    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text")
    )
    return rows.mapInPandas(run, "conv_id long, turn long, ids array<int>, mask array<tinyint>, formatted string")


class _Conversation:
    """What reading back keeps of a conversation while its turns pass."""

    def __init__(self) -> None:
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, formatted: str, enc: tiktoken.Encoding) -> None:
        _, _, header, body = np.flatnonzero(ids >= RESERVED).tolist()
        role = unescape(enc.decode(ids[2:header].tolist()))
        text = unescape(enc.decode(ids[header + 1 : body].tolist()))
        learned = unescape(enc.decode(ids[mask == 1].tolist()))
        self.turns += 1
        self.chars += len(formatted)
        self.loss_chars += len(learned)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation, from ids and masks alone: turns, digests of all turns and of the text under the loss."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, now, state, done = encoding(vocabulary), None, None, []
        for b in batches:
            for conv, ids, mask, text in zip(b["key"], b["ids"], b["mask"], b["formatted"], strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(state.row(now))
                    now, state = conv, _Conversation()
                state.add(np.asarray(ids), np.asarray(mask), text, enc)
            yield _frame(done)
            done = []
        if state is not None:
            yield _frame([state.row(now)])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out = pd.DataFrame(rows, columns=names)
        out["conv_id"] = pd.array([None if x == "" else int(x) for x in out["conv_id"]], dtype="Int64")
        return out

    # a text key keeps a missing id apart from every number
    keyed = formatted.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    ordered = keyed.repartition("key").sortWithinPartitions("key", "turn", "formatted")
    return ordered.select("key", "ids", "mask", "formatted").mapInPandas(run, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose two texts consist of control strings."""
    spark: SparkSession = turns.sparkSession
    probe = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).unionByName(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    turns = with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_back(format_turns(turns, vocabulary), vocabulary)


_COUNTS = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in CONTROL)
_GROWN = f"2 * ({_COUNTS}) + length({{0}}) - length(replace({{0}}, '{ESCAPE}', ''))"

SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({sum(map(len, CONTROL))} + length(role) + {_GROWN.format("role")}
                + length(text) + {_GROWN.format("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
