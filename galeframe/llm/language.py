"""Language identification with error-correcting output codes over binary n-gram classifiers.

Every language gets a codeword of bits. One binary classifier per bit weighs hashed letter n-grams (orders 1
to 3, lower case, anything but a letter is a word boundary) by the log-odds of the languages whose bit is set
against the others. A text's evidence for each bit is its mean log-odds times its number of n-grams, up to
``enough`` of them. Loss-weighted decoding takes the language whose codeword has the smallest logistic loss,
each bit weighted by how well its classifier separates that language; the score is the softmax of the losses.
Texts whose best two codewords are close are flagged as ambiguous.

The n-gram counts are sums over all labelled training rows, gathered per task before they are shuffled. The
model has ``BUCKETS`` counts per language, whatever the corpus.

Defined cases: a missing text or one without a letter is ``und`` with score 0 and ambiguous; without any
labelled row everything is ``und``; with one language it is that language; a missing doc_id is held out and
not learnt from; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import documents, parts

BUCKETS = 1 << 14
ORDERS = 3
#: Characters whose n-grams are hashed at a time.
SLICE = 1 << 17
BOUNDARY = "\n\n"
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def stretches(texts: list[str], most: int) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, stretch) of all texts, in lists of about ``most`` characters.

    A stretch is up to ``most`` characters with the two before it; a text begins and ends with two word boundaries.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        whole = text + BOUNDARY
        for at in range(0, len(whole), most):
            held.append((i, (whole[at - 2 : at] if at else BOUNDARY) + whole[at : at + most]))
            size += len(held[-1][1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def ngrams(texts: list[str], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams that hold a letter, and for each the number of its text, some text at a time.

    A text of any length is cut, so that work arrays stay small: every n-gram is counted where it ends.
    """
    for held in stretches(texts, most):
        codes = [np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32) for _, piece in held]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        c = letters()[np.concatenate(codes)]
        owner = np.repeat(np.fromiter((i for i, _ in held), np.int32, len(held)), lengths)[2:]
        counted = np.ones(len(c), bool)
        starts = np.cumsum(lengths) - lengths
        counted[starts] = counted[starts + 1] = False  # these belong to the stretch before
        counted, filled = counted[2:], c > 0
        found, owners = [], []
        mixed, any_letter = np.zeros(len(c) - 2, np.uint32), np.zeros(len(c) - 2, bool)
        for order in range(ORDERS):  # n-grams that end at position 2, 3, ...
            at = slice(2 - order, len(c) - order)
            mixed = (mixed ^ c[at]) * np.uint32(0x9E3779B1) + np.uint32(order + 1)
            any_letter = any_letter | filled[at]
            keep = any_letter & counted
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(18))[keep])
            owners.append(owner[keep])
        yield np.concatenate(found), np.concatenate(owners)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) of a table (text, lang); each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column("text")), SLICE):
                langs = np.asarray(part.column("lang").to_pylist(), object)
                for grams, owner in ngrams(part.column("text").to_pylist()):
                    for lang in set(langs[np.unique(owner)]):
                        own = grams[(langs == lang)[owner]]
                        total[lang] = total.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    counts = labelled.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: all distinct splits up to five languages, drawn ones beyond."""
    if n <= 5:
        splits = np.arange(1, max(1, 1 << (n - 1)) if n > 1 else 1)  # the last language is always on the 0 side
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], np.float64).reshape(n, len(splits))
    bits = int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for seed in range(50):
        drawn = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        near = (bits - (drawn @ drawn.T - 2 * bits * np.eye(n)).max()) / 2
        if near > gap and (np.abs(drawn.sum(0)) < n).all():
            best, gap = drawn, near
    return best


class Model:
    """Languages, codewords, one weight per bucket and bit, and the decoding weights."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages, self.code = languages, codewords(len(languages))
        p = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
        ones = self.code.T > 0  # bit, language
        side = lambda pick: (pick @ p) / np.maximum(pick.sum(1, keepdims=True), 1)
        self.weights = np.log(side(ones.astype(float)) / side((~ones).astype(float))).T.astype(np.float32)
        margin = np.maximum(self.code * (p @ self.weights), 1e-6)  # language, bit
        self.trust = margin / margin.sum(1, keepdims=True) * max(1, margin.shape[1]) if margin.size else margin

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and the gap of the losses to the second, of rows of evidence per bit."""
        loss = np.stack([np.logaddexp(0, -evidence * m) @ t for m, t in zip(self.code, self.trust, strict=True)], 1)
        order = np.sort(loss, 1)
        score = 1 / np.exp(order[:, :1] - order).sum(1)
        gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(1), score, gap


def train(labelled: DataFrame, most_languages: int = 256) -> Model | None:
    """A model of the languages in (text, lang); rows without text or lang are left out.

    ``most_languages`` bounds the model's size; more of them are an error, none is dropped.
    """
    counts = count_ngrams(labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    rows: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():
        if r["lang"] not in rows:
            if len(rows) == most_languages:
                raise ValueError(f"more than {most_languages} languages")
            rows[r["lang"]] = np.zeros(BUCKETS)
        rows[r["lang"]][r["bucket"]] = r["n"]
    languages = sorted(rows)
    return Model(languages, np.stack([rows[x] for x in languages])) if languages else None


def predict(df: DataFrame, model: Model | None, text: str = "text", enough: int = 300, clear: float = 1.0) -> DataFrame:
    """``df`` with lang_pred, score and ambiguous; only the text is looked at."""

    def found_in(texts: list[str]) -> pd.DataFrame:
        bits = range(model.weights.shape[1]) if model is not None else range(0)
        n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(bits)))
        for grams, owner in ngrams(texts):
            n += np.bincount(owner, minlength=len(texts))
            for b in bits:
                sums[:, b] += np.bincount(owner, model.weights[:, b][grams], minlength=len(texts))
        out = {"lang_pred": np.full(len(texts), UNKNOWN, object), "score": np.zeros(len(texts)), "ambiguous": n >= 0}
        known = n > 0
        if model is not None and known.any():
            mean = sums[known] / n[known, None]
            best, score, gap = model.decode(mean * np.minimum(n[known, None], enough) / ORDERS)
            out["lang_pred"][known] = np.asarray(model.languages, object)[best]
            out["score"][known], out["ambiguous"][known] = score, gap < clear
        return pd.DataFrame(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for part in parts(batch.set_column(batch.schema.get_field_index(text), text, texts), pc.binary_length(texts), SLICE):
                found = found_in(part.column(text).to_pylist())
                kept = [(x, part.column(x)) for x in names]
                new = [(x, pa.array(found[x], type=t)) for x, t in kinds]
                yield pa.RecordBatch.from_arrays([a for _, a in kept + new], names=[x for x, _ in kept + new])

    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]
    names = [c for c in df.columns if c not in dict(kinds)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields])
    return df.select(*names).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in three, and those without an id, are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and ambiguous, learnt from the rows that are not held out."""
    return predict(docs.withColumn("held_out", held_out()), train(docs.filter(~held_out())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
