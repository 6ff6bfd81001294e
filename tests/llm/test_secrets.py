import hashlib
import math
import random
import re
from collections import Counter

import pytest

from galeframe.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string, ra string"
FIXED = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def base(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(FIXED):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def entropy(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        word = m[0]
        bits = next((b for _, p, b in S.CLASSES if re.search(p, word)), None)
        if bits is None or any(re.search(p, word) for p in S.ALLOWED):
            continue
        hot = []
        for i in range(len(word) - 19):
            counts = Counter(word[i : i + 20]).values()
            if -sum(c / 20 * math.log2(c / 20) for c in counts) >= bits - 1e-12:
                hot.append(i)
        if hot:
            out.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20, "entropy"))
    return out


def expected(text):
    text = text or ""
    first = base(text)
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    kinds = Counter(x[3] for x in first)
    digest = hashlib.sha256(listed(first).encode()).hexdigest()
    return kinds["assign"], kinds["access"], kinds["hex"], digest, listed(sorted(first + entropy(text)))


def texts():
    draw = random.Random(23)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    hexa, key = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = [
        lambda: "Password = " + pick(key, 9), lambda: "api_key:'" + pick(key, 5), lambda: "TOKEN: token: abcdefg",
        lambda: "apikey==" + pick(key, 30), lambda: "AKIA" + pick("ABC234", draw.choice([5, 16, 20])), lambda: pick(hexa, draw.choice([8, 23, 24, 40])),
        lambda: pick(key, draw.choice([19, 20, 21, 64])), lambda: pick("ab", 40), lambda: "a" * 30, lambda: pick("abcdefghijklmnop", 33),
        lambda: "ñó🙂é", lambda: "ſecret: abcdefgh", lambda: "toKen: abcdefgh", lambda: "\n", lambda: " word ", lambda: "SECRET\"=\"x.y-z_/9",
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "d41d8cd98f00b204e9800998ecf8427e", lambda: pick(hexa, 30) + "g" * 30 + pick(key, 30),
    ]
    out = ["".join(draw.choice(parts)() + draw.choice(["", " ", "\n", "é"]) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    return [*out, "", None, "no secret here", "x " * 50_000 + "password: hunter22", "token=abcdef " * 3000]


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t, None, "x") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "secret = abcdefgh", None, None), (5, "another text with token: 12345678", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.query(spark, str(tmp_path)).toPandas()
    found = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got.itertuples())
    ids = lambda d: "nan" if d is None else str(float(d))
    assert found == sorted((ids(r[0]), *expected(r[1])) for r in rows)


def test_redact_blots_out_the_union(spark):
    rows = [(1, "a token: 0123456789abcdef01234567 b", "s", None), (2, None, None, None), (3, "clean", None, None)]
    rows += [(4, "é password=abcdef, AKIA" + "A1B2" * 4, None, None), (4, "é password=abcdef, AKIA" + "A1B2" * 4, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.redact(df)
    assert sorted(map(tuple, S.redact(df, broadcast_bytes=0).toLocalIterator()), key=str) == sorted(map(tuple, out.toLocalIterator()), key=str)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    texts_ = sorted((r["doc_id"], r["text"] or "") for r in out.toLocalIterator())
    assert texts_ == [(1, "a [SECRET] b"), (2, ""), (3, "clean"), (4, "é [SECRET], [SECRET]"), (4, "é [SECRET], [SECRET]")]
    assert S.redact(df.limit(0)).count() == 0 and S.find_secrets(df.limit(0)).count() == 0


def test_long_texts_with_many_spans(spark):
    draw = random.Random(4)
    long = "".join(draw.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(35_000))
    many = "é password=abcdef0 and more, " * 3000
    mixed = "x" * 12_000 + long[:300] + "x" * 12_000
    rows = [(1, f"a {long} b", "s", None), (2, many, None, None), (3, f"a {mixed} b", None, None)]
    out = {r["doc_id"]: r["text"] for r in S.redact(spark.createDataFrame(rows, SCHEMA)).toLocalIterator()}
    assert out[1] == "a [SECRET] b" and out[2] == "é [SECRET] and more, " * 3000
    start, end = entropy(f"a {mixed} b")[0][::2]
    assert out[3] == f"a {mixed} b"[:start] + "[SECRET]" + f"a {mixed} b"[end:]


def test_names_redact_needs_are_refused(spark):
    with pytest.raises(ValueError, match="_from"):
        S.redact(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, _FROM int"))


def test_clean_prose_has_no_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = S.find_secrets(docs).join(docs, "doc_id").filter(~S.F.col("text").rlike("[0-9a-zA-Z]{20,}|(?i)token|key|secret|passw"))
    assert out.filter(S.F.size("spans") > 0).count() == 0
