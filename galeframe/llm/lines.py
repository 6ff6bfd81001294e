"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

Documents are read in batches. Each batch is reduced to its distinct line keys (128-bit hashes) with the
number of documents that hold them and the largest doc_id. It is merge-joined against the sorted runs: keys
that no run holds become a run of their own, so every key is in exactly one run; keys already held go to a
small table of repeats. Runs are bucketed and sorted by key in the shared folder, so only the batch is
shuffled, never what is stored. ``fan`` runs of one level are compacted into one of the next. What is to be
dropped follows from the repeats and the runs' counts; a line that occurs once never meets them again.

A line that a third of all documents hold is one row per task before any shuffle, and where the documents
look up what to drop, only their few lines found in the dropped keys travel.

Defined cases: a missing or empty text is one empty line; repeated rows count as documents of their own;
a missing doc_id is smaller than any other; keys short of ``min_chars`` are never dropped; an empty table
gives an empty table; further columns are kept by ``drop_lines``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import ROW, SPACES, bounded, documents, hash128, lower_ascii, new_path, row_key, saved, scratch, text_of, written

KEY = ["ka", "kb"]


class Runs:
    """Sorted runs of distinct line keys, by level, and the repeats of keys they hold."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = 3) -> None:
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []

    def _store(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, "run")
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return written(self.spark.table(name), path, name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (ka, kb, n, last), one row per key."""
        held = batch
        for i, run in enumerate(self.runs()):
            held = held.join(run.select(*KEY, F.lit(True).alias(f"in{i}")).hint("merge"), KEY, "left")
        found = [F.col(f"in{i}").isNotNull() for i in range(len(self.runs()))]
        if found:
            seen = found[0]
            for f in found[1:]:
                seen = seen | f
            held = saved(held.select(*KEY, "n", "last", seen.alias("seen")), "batch")
            self.repeats.append(held.filter("seen").drop("seen"))
            batch = held.filter(~F.col("seen")).drop("seen")
        self.levels[0].append(self._store(batch))
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fan:
                merged = level[0]
                for run in level[1:]:
                    merged = merged.unionByName(run)
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._store(merged))

    def frequent(self, min_docs: int) -> DataFrame:
        """(ka, kb, last) of the keys that at least ``min_docs`` documents hold, with the largest doc_id."""
        again = None
        for part in self.repeats:
            again = part if again is None else again.unionByName(part)
        out = None
        if again is not None:
            again = again.groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        for run in self.runs():
            if again is not None:
                total = F.col("n") + F.coalesce("more", F.lit(0))
                run = run.join(again, KEY, "left").select(*KEY, total.alias("n"), F.greatest("last", "later").alias("last"))
            run = run.filter(F.col("n") >= min_docs).select(*KEY, "last")
            out = run if out is None else out.unionByName(run)
        return out


def line_keys(text: Column, min_chars: int) -> Column:
    """Sorted array of (ka, kb, at, size) of the lines with a long enough key."""
    keys = F.transform(F.split(text, "\n"), lambda line: lower_ascii(F.trim(line, F.lit(SPACES))))
    hashed = F.transform(keys, lambda key, at: F.struct(*hash128(key, "k"), at.alias("at"), F.char_length(key).alias("size")))
    return F.sort_array(F.filter(hashed, lambda x: x["size"] >= min_chars))


def with_first(found: str) -> Column:
    """The sorted column with ``first``, true where a key is new in its text."""
    same = lambda x, y: (x["ka"] == y["ka"]) & (x["kb"] == y["kb"])
    first = lambda x, i: (i == 0) | ~same(x, F.get(found, i - 1))
    return F.transform(found, lambda x, i: F.struct(x["ka"], x["kb"], x["at"], first(x, i).alias("first")))


def frequent_lines(lines: DataFrame, batches: int, min_docs: int, fan: int = 3) -> DataFrame:
    """(ka, kb, last) of frequent keys in (batch, ka, kb, first, doc_id), taken in batch by batch."""
    runs = Runs(lines.sparkSession, fan=fan)
    for b in range(batches):
        own = lines.filter((F.col("batch") == b) & F.col("first"))
        runs.add(own.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
    return runs.frequent(min_docs)


def drop_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan: int = 3, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped; a frequent line stays only in the largest doc_id that holds it."""
    text = text_of("text")
    with scratch() as keep:
        lines = saved(
            docs.select("doc_id", *row_key(), line_keys(text, min_chars).alias("_found"))
            .select("doc_id", *ROW, F.inline(with_first("_found")))
            .withColumn("batch", F.pmod(ROW[0], F.lit(batches)).cast("int")),
            "lines",
            by=("batch",),
        )
        frequent = saved(frequent_lines(lines, batches, min_docs, fan), "frequent")
        # A set, because repeated rows share their key and their lines.
        gone = (
            lines.join(frequent, KEY)
            .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy(*ROW)
            .agg(F.collect_set("at").alias("_gone"))
        )
        gone = keep(saved(gone, "gone"))
    # Texts stay where they are as long as the places of their dropped lines can come to them.
    gone = bounded(gone, "_gone", broadcast_bytes)
    split = docs.withColumns(dict(zip(ROW, row_key(), strict=True))).join(gone, ROW, "left").withColumn("_lines", F.split(text, "\n"))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(places, F.coalesce("_gone", F.array().cast("array<int>"))), lambda i: F.get("_lines", i))
    return split.select(
        *(F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos FROM texts),
lines AS (
    SELECT doc_id, pos, parts[pos] AS line,
           translate(regexp_replace(parts[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM numbered
), frequent AS (
    SELECT line_key, max(doc_id) AS last FROM lines WHERE length(line_key) >= 40
    GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> f.last, false) AS gone
    FROM lines l LEFT JOIN frequent f USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
