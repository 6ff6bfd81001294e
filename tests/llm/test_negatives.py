import random

import numpy as np
import pytest

from galeframe.llm import negatives as N
from galeframe.llm import vectors as V
from tests.llm.test_topk import SCHEMA, rows_of


def brute(rows, scale, n_positives, n_negatives, low, high):
    fine = [
        (i, label, [int(np.floor(scale * float(np.float32(x)))) for x in v])
        for i, v, label, *_ in rows
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, label, own in fine:
        if a is None or a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i is None, i or 0, m) for i, m, v in fine if len(v) == len(own) and (i != a or m != label))
        best = [s for s in scored if s[3] == label][:n_positives]
        for place, (p, p_missing, p_id, _) in enumerate(best):
            found = [s for s in scored if s[3] != label and -low * p <= -100 * s[0] <= -high * p][:n_negatives]
            out += [(a, None if p_missing else p_id, r + 1, None if m else i, -p, -s, place + 1) for r, (s, m, i, _) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunks", "blocks", "many"), [(7, 2, 3), (50, 100, 1), (8192, 1024, 8)])
def test_against_all_pairs(spark, chunks, blocks, many):
    draw = random.Random(chunks)
    rows = [(i, v, draw.randrange(3) if draw.random() < 0.9 else None, s, k) for i, v, _, s, k in rows_of(draw, 320)]
    rows += [(400 + i, rows[0][1], 1 + i % 2, "", 0) for i in range(25)]  # ties in and across labels
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vectors = df.filter(V.usable("embedding") & df["label"].isNotNull()).select("vec_id", "label", V.whole("embedding", 256).alias("v"), "score", "key")
    got = N.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), many, 10, 30, 90, chunks, blocks)
    want = brute(rows, 256, many, 10, 30, 90)
    assert sorted(map(tuple, got.toLocalIterator()), key=str) == want and len(want) > 10


def test_slots_are_disjoint_and_windows_are_suffixes():
    scores = np.array([[95, 90, 89, 60, 50, 40, 12, 12, -3]])
    uppers = np.array([[90, 50, np.iinfo(np.int64).min]])
    q, slot, at = N.slotted(scores, np.ones_like(scores, bool), uppers, np.arange(9), 2)
    assert sorted(zip(slot.tolist(), scores[q, at].tolist(), strict=True)) == [(0, 89), (0, 90), (1, 40), (1, 50)]


def test_limits_in_whole_numbers(spark):
    values = [-101, -100, -7, -1, 0, 1, 9, 10, 11, 33, 100, 101, 2**53 + 1]
    df = spark.createDataFrame([(v,) for v in values], "s long")
    got = df.select("s", N._share("s", 30, True), N._share("s", 90, False)).toLocalIterator()
    assert all(low == -((-30 * s) // 100) and high == 90 * s // 100 for s, low, high in got)


def test_empty_and_single_label(spark):
    none = spark.createDataFrame([], "vec_id long, label int, v array<long>")
    assert N.hard_negatives(none, none).count() == 0
    alike = spark.createDataFrame([(100, 1, [1, 2]), (101, 1, [2, 1])], none.schema)
    assert N.hard_negatives(alike, alike).count() == 0
