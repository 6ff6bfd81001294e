import random
import re

import pytest
import xxhash

from galeframe.llm import components as C
from galeframe.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root string"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_against_brute_force():
    draw = random.Random(1)
    texts = ["".join(draw.choice(["A", "b", "É", "ß ", " ", "\n", "\xa0", "İ", "🙂"]) for _ in range(n)) for n in range(60)]
    for t in [*texts, "", " ", "one", "one two", "one two three"]:
        assert S.fingerprint(t) % 2**64 == brute_fingerprint(t)
    # 600,000 words of which every other shingle is "x y x"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"x y x", b"y x y")]
    assert S.fingerprint("x y " * 300_000) % 2**64 == hashes[0] & hashes[1]


@pytest.mark.parametrize("hot", [2, 256])
def test_links_against_all_pairs(spark, hot):
    draw = random.Random(2)
    values = {0, 2**63, 2**64 - 1}
    for _ in range(40):
        centre = draw.getrandbits(64)
        values.add(centre)
        for _ in range(12):
            v = centre
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    crowd = draw.getrandbits(64)
    values |= {crowd ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(a)}
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    got = [(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot).toLocalIterator()]
    pairs = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= 3}
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == pairs


def test_components_of_chains_stars_and_cliques(spark):
    draw = random.Random(3)
    linked = [(i, i + 1) for i in range(100, 160)] + [(200, 201 + i) for i in range(40)]
    linked += [(a, b) for a in range(300, 312) for b in range(300, a)] + [(5, -5), (7, 7)]
    names = list(range(1000))
    draw.shuffle(names)
    linked = [(names[a], names[b]) if a > 50 else (a, b) for a, b in linked]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(linked, "a long, b long")).toLocalIterator()}
    nodes = {x for a, b in linked if a != b for x in (a, b)}
    assert got == brute_components(nodes, [p for p in linked if p[0] != p[1]])
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(draw.randint(1, 40))), "x", None) for i in range(100)]
    base = [word() for _ in range(400)]
    for i in range(60):
        near = list(base)
        near[draw.randrange(400)] = word()
        rows.append((1000 + i, " ".join(near), None, None))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, " \n", None, None), (None, rows[3][1], None, None)]
    rows += [(3, rows[3][1], "x", None), (None, "only without an id and longer", None, None), (None, "only without an id and longer", None, None)]
    return rows


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    linked = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bin(a ^ b).count("1") <= 3]
    root = brute_components(distinct, linked)
    smallest = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            smallest[root[f]] = min(smallest.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", smallest.get(root[f])) for r, f in zip(rows, fps, strict=True)], [root[f] for f in fps]


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = S.near_duplicates(df)
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in found.toLocalIterator()]
    expected, roots = brute(rows)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert len({c for _, _, c in expected if c is not None and c >= 1000}) < 40  # the near copies do link
    kept = S.keep_one(df)
    assert sorted(map(tuple, S.keep_one(df, broadcast_bytes=0).toLocalIterator()), key=str) == sorted(map(tuple, kept.toLocalIterator()), key=str)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    ids = {r["doc_id"] for r in kept.toLocalIterator()}
    assert ids == {c for _, _, c in expected}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
