import hashlib
import random
import re

import numpy as np
import pytest

from galeframe.llm import substrings as S

SCHEMA = "doc_id long, text string, n_words string, h string"


def brute(rows, words):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    order = [float("inf") if r[0] is None else r[0] for r in rows]
    first = {}
    for o, own in zip(order, split, strict=True):
        for i in range(len(own) - words + 1):
            w = tuple(own[i : i + words])
            first[w] = min(first.get(w, o), o)
    longest, length = {}, words
    while True:  # the same windows at twice the length, as long as any two documents share one
        held = {}
        for i, (o, own) in enumerate(zip(order, split, strict=True)):
            for at in range(len(own) - length + 1):
                held.setdefault(tuple(own[at : at + length]), []).append((o, i))
        found = {i for ends in held.values() if min(ends)[0] < max(ends)[0] for _, i in ends}
        if not found:
            break
        longest.update(dict.fromkeys(found, length))
        length *= 2
    out = []
    for k, (r, o, own) in enumerate(zip(rows, order, split, strict=True)):
        gone = set()
        for i in range(len(own) - words + 1):
            if first[tuple(own[i : i + words])] < o:
                gone |= set(range(i, i + words))
        out.append((r[0], len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone), longest.get(k, 0)))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(6)
    fresh = lambda n: [f"w{draw.randrange(10**6)}é" for _ in range(n)]
    passages = [fresh(draw.choice([49, 50, 51, 60, 120])) for _ in range(8)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(draw.randint(0, 4)):
            own += fresh(draw.randint(0, 40)) + (draw.choice(passages)[draw.randint(0, 3) :] if draw.random() < 0.6 else [])
        rows.append((i, draw.choice([" ", "\n", "\t ", "\x0b"]).join(own), "x", None))
    rows += [(500 + i, rows[7][1], None, None) for i in range(40)]
    rows += [(600, "a " * 300, None, None), (601, "a " * 55, None, None), (602, "a " * 49, None, None), (603, "b a " * 100, None, None)]
    rows += [(None, " ".join(passages[0] + passages[4]), None, None), (None, " ".join(passages[4]), None, None)]
    rows += [(700, None, None, None), (701, "", None, None), (9, rows[9][1], None, None), (9, " ".join(passages[5]), None, None)]
    rows += [(800, " ".join(fresh(3000) + passages[2] + fresh(30_000)), None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}])
def test_against_brute_force(spark, limits):
    rows = corpus()
    out = S.remove_repeats(spark.createDataFrame(rows, SCHEMA), extend=True, **limits)
    assert out.columns == ["doc_id", "text", "h", "n_words", "n_removed", "kept_text", "longest"]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["longest"]) for r in out.toLocalIterator()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_other_lengths_and_the_empty_table(spark):
    rows = [(1, "a b c d e f g"), (2, "x c d e f y"), (3, "c d e"), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["longest"]) for r in S.remove_repeats(df, words=3, extend=True).toLocalIterator()]
    assert sorted(got) == brute(rows, 3)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_names_it_needs_are_refused(spark):
    with pytest.raises(ValueError, match="_order"):
        S.remove_repeats(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, _Order int"))


def test_windows_of_a_long_text(spark):
    passage = [f"p{i}" for i in range(70)]
    own = [f"w{i}" for i in range(400_000)]
    for at in range(1000, 400_000, 2000):
        own[at : at + 70] = passage
    df = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(own))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.remove_repeats(df, extend=True).toLocalIterator()}
    assert got[2]["n_removed"] == 200 * 70 and got[2]["n_words"] == 400_000 and got[1]["longest"] == got[2]["longest"] == 50
    assert got[2]["kept_text"] == " ".join(w for w in own if not w.startswith("p"))


def test_every_full_window_holds_an_anchor_at_the_same_place():
    draw = np.random.default_rng(5)
    for vocabulary in (2, 50):
        a = [str(x).encode() for x in draw.integers(0, vocabulary, 400)]
        b = [b"z"] * 13 + a[100:300] + [b"y"] * 30
        places = [S.anchors(S.Rolled(x), 50)[0] for x in (a, b)]
        for s in range(100, 251):
            inside = {p - s for p in places[0].tolist() if s <= p <= s + 25}
            assert inside & {p - (s - 100 + 13) for p in places[1].tolist()}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").toLocalIterator()]
    got = [tuple(r) for r in S.query(spark, folder).toLocalIterator()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(got) == sorted((d, n, k, sha(t)) for d, n, k, t, _ in brute(rows, 50))


def test_query_goes_on_to_an_empty_level(spark, monkeypatch):
    lengths, doubled = [], S.doubled
    monkeypatch.setattr(S, "doubled", lambda survivors, length: lengths.append(length) or doubled(survivors, length))
    own = " ".join(f"w{i}" for i in range(230))
    df = spark.createDataFrame([(1, own), (2, "x " + own)], "doc_id long, text string")
    monkeypatch.setattr(S, "documents", lambda spark, folder: df)
    assert [r["n_removed"] for r in sorted(S.query(spark, "").collect())] == [0, 230]
    assert lengths == [50, 100, 200]
