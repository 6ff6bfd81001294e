import math
import random
import re

import pytest

from galeframe.llm import quality as Q

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    lines, seen, double = text.split("\n"), set(), 0
    for line in lines:
        if re.search(SPACE, line):
            double += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), double, len(inside)


def texts():
    draw = random.Random(3)
    pool = ["a", "b", "é#", "|", "日本", "The"]
    out = ["".join(draw.choice(pool) + draw.choice([" ", "\n", "\t ", "\x85", "\xa0", "\x0b"]) for _ in range(n)) for n in range(0, 120, 3)]
    return [*out, "", "a " * 40, "a b c d e f g h " * 3, " \n \n", "x\nx\nx ", "one two three four five six seven eight"]


def test_counts_against_brute_force():
    all_texts = texts()
    got = Q.measure(all_texts)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r) for r in got[names].itertuples(index=False)] == [brute(t) for t in all_texts]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (3, 50, 0.2), (20, 300, 0.05), (5, 5, 0.3), (30, 31, 0.5)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert Q.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def corpus(spark, n=4000):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(30)), "en", None))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(n, None, None, None), (n + 1, " ".join(word() + "###" for _ in range(30)), "xx", None), (n + 2, "### " * 30, "en", "y")]
    schema = "doc_id long, text string, lang string, kept string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_thresholds_reject_the_bad_and_keep_the_good(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in Q.judge(docs, labels).toPandas().itertuples()}
    assert len(out) == 4003
    assert all(out[i].kept == (i % 10 != 0) for i in range(4000))
    assert not out[4000].kept and out[4000].n_words == 0
    assert out[4001].kept  # a stratum without labels rejects nothing
    assert not out[4002].kept and out[4002].base_failed


def test_few_or_no_labels_certify_nothing(spark):
    docs, labels = corpus(spark, 100)
    for few in (labels, labels.limit(0), labels.withColumn("quality", Q.F.lit(None).cast("int"))):
        out = Q.judge(docs, few).filter("doc_id < 100").toPandas()
        assert out["kept"].all()
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_false_rejections_stay_below_the_risk(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = Q.query(spark, folder).join(labels, "doc_id").toPandas()
    good = out[(out["quality"] == 1) & ~out["base_failed"]]
    bad = out[out["quality"] == 0]
    assert 1 - good["kept"].mean() <= 0.05
    assert 1 - bad["kept"].mean() > 0.6


def test_small_strata_reject_what_one_rule_separates(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(30)), f"l{i % 3}") for i in range(0, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    out = Q.judge(docs, labels).toPandas()
    assert (out["kept"] == (out["doc_id"] % 4 != 0)).all()
