"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose value lies above a cutoff. Cutoffs are learnt per stratum (the language column)
from labelled rows that pass the base rules, which a hash deals into two halves. The proposing half of the good
rows gives each rule a ladder of cutoffs (quantiles up to the maximum). On that half rules are added one by one, each
at the step that separates good from bad best beside those before, until none gains. The calibrating half tests
these growing sets of rules in that order: a set is certified if the exact binomial tail says that a false
rejection rate of ``risk``, by any of its rules, is refuted at level ``error`` / strata, and testing ends at the first
failure (a fixed sequence, so neither rules nor steps need a correction). The last certified set is taken. So with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good texts to the rules. Strata with few labels
certify nothing and reject nothing; with four strata 86 good calibrating rows without a loss are enough.

Word and window counts are exact: repeated 8-word windows are found by hashes, then compared word by word.

Defined cases: a missing text has no words; a row without a language forms the stratum ``''``; a document
labelled more than once counts as good if any label says so; an empty label table leaves the base rules only;
repeated documents are repeated in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import documents, parts, saved, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LADDER = (1.0, 0.999, 0.995, 0.99, 0.98, 0.97, 0.95)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SLICE = 4 << 20

#: The rules: a share or length of each text, compared with a cutoff from above.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_upper / greatest(n_letters, 1)",
    "no_letters": "1 - n_letters / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "double_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, 3 if a capital one, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 3 if chr(c).isupper() else 1
    return out


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words inside windows of eight words that occur twice or more in it."""
    ids: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((ids.setdefault(w, len(ids)) for text in words for w in text), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(words)), lengths)
    out = np.zeros(len(words), np.int64)
    if len(flat) < WINDOW:
        return out
    starts = np.flatnonzero(owner[: len(flat) - WINDOW + 1] == owner[WINDOW - 1 :])
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = owner[starts].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(WINDOW):
        hashes = (hashes ^ mixed[starts + k]) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not again.size:
        return out
    starts = starts[np.isin(hashes, again)]
    rows = np.column_stack([owner[starts], *(flat[starts + k] for k in range(WINDOW))])
    _, group, size = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    steps = np.zeros(len(flat) + 1, np.int64)
    found = starts[size[group.ravel()] > 1]
    np.add.at(steps, found, 1)
    np.add.at(steps, found + WINDOW, -1)
    return np.bincount(owner, np.cumsum(steps[:-1]) > 0, minlength=len(words)).astype(np.int64)


def measure(texts: list[str]) -> pd.DataFrame:
    """The counts of some texts, one row each."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    rows = []
    for text, own in zip(texts, words, strict=True):
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        kind = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=4)
        spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
        symbols = sum(map(text.count, SYMBOLS))
        rows.append((len(own), len(text) - spaces, symbols, len(lines) - len(set(lines)), 0, len(lines), kind[3], kind[1] + kind[3]))
    out = pd.DataFrame(rows, columns=list(COUNTS), dtype=np.int64)
    out["n_repeat_words"] = repeated_words(words)
    return out


def features(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The counts of each whole text beside the key columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column(at)), SLICE):
                found = measure(part.column(at).to_pylist())
                columns = [part.column(k) for k in keys] + [pa.array(found[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *COUNTS])

    at = "_text"
    rows = docs.select(*keys, text_of("text").alias(at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(at).schema.fields)
    return rows.mapInArrow(run, schema + "".join(f", {c} long" for c in COUNTS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws at rate p, as the regularised incomplete beta function I_{1-p}(n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Continued fraction, evaluated from the front by the ratio of successive convergents.
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(20_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        value *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    tail = front * (value - 1)
    return 1 - tail if swap else tail


def _chosen(group: pd.DataFrame, risk: float, level: float) -> list[tuple[str, int]]:
    """(rule, step) of the certified set, from counts of the rows of a stratum by how many steps each value exceeds."""
    n, good, proposes = (group[c].to_numpy() for c in ("n", "good", "proposes"))
    total = lambda mask: int(n[mask].sum())
    out, rejected, before = [], np.zeros(len(n), bool), 0
    while len(out) < len(RULES):
        best = (before, None, None, rejected)
        for rule in RULES:
            for step in range(len(LADDER)):
                # A value above m steps exceeds the m lowest ones, the last m of the ladder.
                more = rejected | (group[rule].to_numpy() >= len(LADDER) - step)
                # A false rejection weighs ten caught texts; the stricter step must earn its place.
                gain = total(~good & proposes & more) - 10 * total(good & proposes & more)
                if gain > best[0] and rule not in dict(out):
                    best = (gain, rule, step, more)
        before, rule, step, rejected = best
        if rule is None or binomial_tail(total(good & ~proposes & rejected), total(good & ~proposes), risk) > level:
            break
        out.append((rule, step))
    return out


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) of the certified cutoffs; ``measured`` has doc_id, stratum and one column per rule."""
    judged = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    proposes = (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("proposes")
    rows = measured.join(judged, "doc_id").select("stratum", "good", proposes, *RULES)
    steps = [F.percentile_approx(r, list(LADDER), 100_000).alias(f"{r}_ladder") for r in RULES]
    ladders = saved(rows.filter("good AND proposes").groupBy("stratum").agg(*steps), "ladders")
    above = [F.expr(f"size(filter({r}_ladder, c -> {r} > c))").alias(r) for r in RULES]
    placed = rows.join(ladders, "stratum").select("stratum", "good", "proposes", *above)
    sums = placed.groupBy("stratum", "good", "proposes", *RULES).agg(F.count("*").alias("n"))
    level = error / max(1, ladders.count())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = [(group["stratum"].iloc[0], *x) for x in _chosen(group, risk, level)]
        return pd.DataFrame(found, columns=["stratum", "rule", "step"])

    chosen = sums.groupBy("stratum").applyInPandas(run, "stratum string, rule string, step int")
    ladder = F.create_map(*(c for r in RULES for c in (F.lit(r), F.col(f"{r}_ladder"))))
    cutoff = F.element_at(ladder[F.col("rule")], F.col("step") + 1).alias("cutoff")
    return chosen.join(ladders, "stratum").select("stratum", "rule", cutoff)


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Per document the counts, base_failed, kept and the names of the rules it broke."""
    counted = saved(features(docs).withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit(""))), "quality")
    measured = counted.withColumns({rule: F.expr(value) for rule, value in RULES.items()})
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    cutoffs = (
        thresholds(measured.filter(~base), labels, risk, error)
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )
    broken = F.array_compact(F.array(*(F.when(F.col(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES)))
    return (
        measured.join(cutoffs, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("broken_rules", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *base, "broken_rules")
