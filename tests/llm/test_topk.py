import random

import numpy as np
import pyarrow as pa
import pytest

from galeframe.llm import topk as T
from galeframe.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, score string, key int"


def rows_of(draw, n, dims=6):
    """Clusters, lengths from tiny to long, ties, zeros, repeated rows and rows that take no part."""
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        centre, length = draw.choice(centres), draw.choice([0.01, 0.3, 1, 1, 1.05, 4])
        out.append((i, [length * (c + draw.gauss(0, 0.1)) for c in centre], i % 3, "x", 0))
    out += [(n + i, out[7][1], 1, None, None) for i in range(12)]  # equal vectors
    out += [out[200 % n], out[100 % n], (None, out[3][1], 0, "", 1), (n + 20, [0.0] * dims, 0, "", 1), (0, [0.0] * dims, 0, "", 1)]
    out += [(n + 30, None, 0, "", 1), (n + 31, [1.0] * (dims - 1) + [None], 0, "", 1), (n + 100 - n % 100, [float("nan")] * dims, 0, "", 1)]
    return out + [(n + 32, [float("inf")] * dims, 0, "", 1), (200, [0.5, -0.25], 0, "", 1), (n + 33, [2.0, 1.0], 0, "", 1)]


def brute(rows, scale, k):
    fine = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, own in fine:
        if q is None or q % 100:
            continue
        found = [(-sum(a * b for a, b in zip(own, v, strict=True)), i is None, i or 0) for i, v in fine if i != q and len(v) == len(own)]
        out += [(q, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("buckets", "blocks", "share", "start"), [(7, 2, 0.25, 0.9), (40, 3, 1.0, 0.0), (8192, 1024, 0.0, 0.5)])
def test_against_all_products(spark, buckets, blocks, share, start):
    rows = rows_of(random.Random(buckets), 320)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vectors = df.filter(V.usable("embedding")).select("vec_id", V.whole("embedding", 1024).alias("v"), "score", "key")
    got = T.top_products(vectors, vectors.filter("vec_id % 100 = 0"), 10, buckets, blocks, start, share)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.toLocalIterator()), key=str) == brute(rows, 1024, 10)


def test_negative_scores_and_fewer_rows_than_k(spark):
    rows = [(100 * i, [(-1.0) ** i * (i + 1), 0.5], 0, "", 0) for i in range(4)]
    vectors = spark.createDataFrame(rows, SCHEMA).select("vec_id", V.whole("embedding", 1024).alias("v"))
    assert sorted(map(tuple, T.top_products(vectors, vectors, 10, 1, 1).toLocalIterator()), key=str) == brute(rows, 1024, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    one = spark.createDataFrame([(100, [1, 2])], "vec_id long, v array<long>")
    assert T.top_products(none, none).count() == T.top_products(none, one).count() == T.top_products(one, none).count() == T.top_products(one, one).count() == 0


def test_pruning_keeps_every_vector_that_reaches_the_threshold():
    draw = np.random.default_rng(5)
    vectors = np.floor(300 * draw.normal(size=(500, 8))).astype(np.int64)
    vectors = vectors[np.argsort(-V.lengths(vectors), kind="stable")]
    bucket = T.Bucket(vectors, pa.array(range(500), pa.int64()))
    queries = vectors[::25] + draw.integers(-20, 20, (20, 8))
    scores = queries @ vectors.T
    thresholds = np.sort(scores, axis=1)[:, -5].astype(float)
    for share, start in [(1.0, 0.0), (0.1, 0.9), (0.0, 2.0)]:
        q, at, s = T.search(queries, np.full(20, -1), thresholds, bucket, 10, start, share)
        want = {(i, j) for i in range(20) for j in range(500) if scores[i, j] >= thresholds[i]}
        assert {(int(i), int(j)) for i, j in zip(q, at, strict=True)} == want and (scores[q, at] == s).all()


def test_coordinates_leave_few_rows_at_high_cosines():
    draw = np.random.default_rng(6)
    vectors = np.floor(1000 * draw.normal(size=(4000, 8))).astype(np.int64)
    bucket = T.Bucket(vectors, pa.array(range(4000), pa.int64()))
    query = vectors[17].astype(float)
    rows = T.by_coordinates(bucket, query, float(np.linalg.norm(query)), 0.995, 0.25)
    assert 17 in rows and len(rows) < 200


def test_products_are_exact_or_refused():
    for size in (3, 2**11, 2**25, 2**30):
        a = np.array([[size, -size + 1, 1], [0, 0, 0]])
        assert (V.products(a, a) == a.astype(object) @ a.T.astype(object)).all()
    with pytest.raises(OverflowError):
        V.products(np.array([[2**32, 2**32]]), np.array([[2**32, 2**32]]))
    large = np.array([[2**40, 2**40 - 1, 5], [2**40, 7, 7]])
    q, at = V.largest(large * 2**20, np.ones((2, 3), bool), np.array([0, 1, 2]), 1)
    assert q.tolist() == [0, 1] and at.tolist() == [0, 0]
