import math
import tracemalloc
import zlib

import numpy as np

from galeframe.llm import language as L

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score string"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 12, 40):
        code = L.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def plain_ngrams(text):
    """Buckets of a text's n-grams, one at a time: letters in lower case, all else a boundary, two of them at either end."""
    lowered = [c.lower() if len(c.lower()) == 1 else c for c in text]
    codes = [0, 0, *(ord(c) if c.isalpha() else 0 for c in lowered), 0, 0]
    out = []
    for end in range(2, len(codes)):
        mixed = 0
        for order in range(3):
            mixed = (mixed ^ codes[end - order]) * 0x9E3779B1 + order + 1 & 0xFFFFFFFF
            if any(codes[end - order : end + 1]):
                out.append(((mixed ^ mixed >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> 18)
    return out


def plain_model(labelled):
    """Codewords and per bucket the log-odds of each bit, from counts in dictionaries."""
    languages = sorted({lang for _, lang in labelled})
    counts = {lang: [0.1] * L.BUCKETS for lang in languages}
    for text, lang in labelled:
        for g in plain_ngrams(text):
            counts[lang][g] += 1
    chance = {lang: [x / sum(counts[lang]) for x in counts[lang]] for lang in languages}
    code = [[1 if split >> i & 1 else -1 for split in range(1, 1 << len(languages) - 1)] for i in range(len(languages))]
    weights = []
    for b in range(len(code[0])):
        sides = [[chance[lang] for lang, word in zip(languages, code, strict=True) if word[b] == side] for side in (1, -1)]
        mean = [[sum(x) / len(x) for x in zip(*side, strict=True)] for side in sides]
        weights.append([float(np.float32(math.log(x / y))) for x, y in zip(*mean, strict=True)])
    margins = [[max(1e-6, m * sum(p * w for p, w in zip(chance[lang], weights[b], strict=True))) for b, m in enumerate(word)] for lang, word in zip(languages, code, strict=True)]
    return languages, code, weights, [[len(row) * m / sum(row) for m in row] for row in margins]


def plain_prediction(model, text):
    languages, code, weights, trust = model
    grams = plain_ngrams(text or "")
    if not grams:
        return "und", 0.0
    evidence = [sum(w[g] for g in grams) / len(grams) * min(len(grams), 300) / 3 for w in weights]
    losses = [sum(t * math.log1p(math.exp(-m * e)) for m, t, e in zip(word, row, evidence, strict=True)) for word, row in zip(code, trust, strict=True)]
    best = min(range(len(losses)), key=losses.__getitem__)
    return languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_against_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.toLocalIterator()] + [(5000, "Ünïcode İstanbul ΑΒΓ ß", None), (5001, "12 - !", "en"), (5002, "a", None)]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in rows}
    model = plain_model([(text, lang) for d, text, lang in rows if not held[d] and text is not None and lang is not None])
    assert len(model[0]) == 4
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, docs.schema)).toLocalIterator()}
    for d, text, _ in rows:
        lang, score = plain_prediction(model, text)
        assert got[d]["held_out"] == held[d] and got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-6


def test_ngrams_of_cut_texts():
    texts = ["Ab, c", "", "1 2", "é", "The İ quick 12 brown-ſox " * 40, "x" * 17]
    for most in (2, 3, 7, 100, 1 << 19):
        found = [[] for _ in texts]
        for grams, owner in L.ngrams(texts, most):
            assert len(grams) <= 3 * (most + max(map(len, texts)) if most > 1000 else 3 * (2 * most + 2))
            for g, i in zip(grams.tolist(), owner.tolist(), strict=True):
                found[i].append(g)
        assert [sorted(x) for x in found] == [sorted(plain_ngrams(t)) for t in texts]


def test_a_text_of_many_megabytes_takes_little_memory():
    text = "the quick brown fox " * 2_000_000
    tracemalloc.start()
    n = sum(len(grams) for grams, _ in L.ngrams([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2.5 * len(text) and peak < 200 << 20


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    out = L.query(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 3000 and (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert out["score"].between(0, 1).all()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out.head(500).itertuples())


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 5, "en", "x") for i in range(30)]
    rows += [(100 + i, "le chat et le chien " * 5, "fr", None) for i in range(30)]
    rows += [(200, None, "en", None), (201, "", "en", None), (202, "123 !?", None, None), (203, "the dog", None, None)]
    rows += [(None, "le chien et le chat", "en", None), (204, "the cat " * 100_000, None, None), (203, "the dog", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = L.identify(df).toPandas()
    at = lambda i: out[out["doc_id"] == i].iloc[0]
    assert len(out) == len(rows) and "source" not in out
    for i in (200, 201, 202):
        assert (at(i)["lang_pred"], at(i)["score"], at(i)["ambiguous"]) == ("und", 0.0, True)
    assert at(203)["lang_pred"] == at(204)["lang_pred"] == "en"
    none = out[out["doc_id"].isna()].iloc[0]
    assert none["held_out"] and none["lang_pred"] == "fr"


def test_few_languages(spark):
    df = spark.createDataFrame([(i, "some words", "en" if i < 9 else None, None) for i in range(10)], SCHEMA)
    assert {r["lang_pred"] for r in L.identify(df).toLocalIterator()} == {"en"}
    unlabelled = df.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled).toLocalIterator()} == {"und"}
    assert L.identify(df.limit(0)).count() == 0
