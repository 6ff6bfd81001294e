import bisect
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from galeframe.llm import packing as P

VOCABULARY = P.public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(VOCABULARY)


def best_fit_decreasing(sizes, length):
    rooms, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else length
        opened += room == length and True
        if room - s:
            bisect.insort(rooms, room - s)
    return opened


def valid(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    return len(by)


def test_encoder_gives_the_ids_of_the_library():
    draw = random.Random(8)
    parts = [" ", "  ", "the", "Wort", "é", "ß", "\n", "\t", "日本", "🙂", "'s", "12", "…", "\xa0", "\x85", "\x1c", "—", "x", "<|endoftext|>", "!?", "İ", "ſ", "Ω"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + ["", " ", "a ", "a\n\nb", "y" * 50_000]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext"]
    t, encode = library(), P.encoder(VOCABULARY)
    for text in texts:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


@pytest.mark.parametrize(("n", "expected"), [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_cuts(n, expected):
    assert P.cuts(n, 10) == expected


def test_best_fit_equals_the_sequential_one():
    draw = random.Random(9)
    for _ in range(60):
        length = draw.choice([10, 64, 1024])
        sizes = [draw.randint(1, draw.choice([length, length // 2, max(1, length // 9)])) for _ in range(draw.randint(1, 900))]
        sizes += [draw.choice(sizes)] * draw.randint(0, 300)
        counts = {s: sizes.count(s) for s in set(sizes)}
        rows, covered = [], {}
        for size, rank, number, sequence, offset in P.best_fit(counts, length).tolist():
            assert rank == covered.get(size, 0)
            covered[size] = rank + number
            rows += [{"sequence_id": sequence + i, "offset": offset, "length": size} for i in range(number)]
        assert covered == counts
        assert valid(rows, length) == best_fit_decreasing(sizes, length)


def test_pack_documents(spark):
    draw = random.Random(10)
    word = lambda: draw.choice(["the ", "house ", "größe ", "日", "\n"])
    rows = [(i, "".join(word() for _ in range(draw.randint(0, 300))), "x") for i in range(300)]
    rows += [(1000 + i, "one text of many copies", None) for i in range(200)]
    rows += [(2000, None, None), (2001, "", None), (3, rows[3][1], None), (None, "no id", None), (2002, "word " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = list(P.pack(P.saved(P.pieces(df, VOCABULARY), "pieces"), chunk_rows=50).toLocalIterator())
    t, expected = library(), []
    for doc, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    assert valid(out, 1024) == best_fit_decreasing([e[3] for e in expected], 1024)
    assert P.pack_documents(df.limit(0), VOCABULARY).count() == 0


def test_query_is_close_to_the_least_number_of_sequences(spark):
    out = P.query(spark, "/root/testdata/sf0.1").toPandas()
    assert valid(out.to_dict("records"), 1024) <= 1.01 * -(-out["length"].sum() // 1024)
