import random

import pytest

from galeframe.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, ra string"
TRIM = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars, min_docs):
    key = lambda line: ascii_lower(line.strip(TRIM))
    holders = {}
    for doc, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(-1 if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        every = (text or "").split("\n")
        kept = []
        for x in every:
            h = holders.get(key(x), [])
            if len(h) < min_docs or max(h) == doc:
                kept.append(x)
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows():
    draw = random.Random(11)
    pool = [f"a shared line number {i} with É and ß in it" for i in range(12)]
    out = []
    for i in range(120):
        parts = [draw.choice(pool) for _ in range(draw.randint(0, 5))] + [f"own line {i}", "short"] * draw.randint(0, 2)
        parts = [draw.choice(["", "\t", " \x0b"]) + draw.choice([p, p.upper(), ascii_lower(p)]) + draw.choice(["", "\r", "  "]) for p in parts]
        draw.shuffle(parts)
        out.append((i, "\n".join(parts), None, None))
    hot = "a line that very many documents hold, in every batch"
    out += [(200 + i, hot, "x", None) for i in range(300)]
    out += [(600, None, None, None), (601, "", None, None), (602, "\n\n", None, None), (None, hot, None, None)]
    out += [(603, (hot + "\n") * 30_000, None, None), (7, out[7][1], None, None)]
    return out


@pytest.mark.parametrize(("batches", "fan"), [(1, 3), (4, 3), (5, 2)])
def test_against_brute_force(spark, batches, fan):
    data = rows()
    out = lines.drop_lines(spark.createDataFrame(data, SCHEMA), min_docs=5, batches=batches, fan=fan)
    assert out.columns == ["doc_id", "text", "ra", "n_lines", "n_dropped", "kept_text"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.toLocalIterator()]
    assert sorted(got, key=str) == brute(data, 40, 5)


def test_places_that_are_too_many_to_broadcast(spark):
    data = rows()
    out = lines.drop_lines(spark.createDataFrame(data, SCHEMA), broadcast_bytes=0)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.toLocalIterator()]
    assert sorted(got, key=str) == brute(data, 40, 5)


def test_empty_table(spark):
    assert lines.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_is_in_one_run_only_and_stored_runs_are_not_shuffled(spark):
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS ka", "id AS kb", "1L AS n", "id AS last")
    runs = lines.Runs(spark, buckets=4, fan=3)
    for lo, hi in ((0, 50), (40, 90), (80, 100), (0, 120)):
        runs.add(make(lo, hi))
    stored = runs.runs()
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted(r["ka"] for run in stored for r in run.toLocalIterator()) == list(range(120))
    assert {r["ka"] for r in runs.frequent(3).toLocalIterator()} == set(range(40, 50)) | set(range(80, 90))
    joined = make(0, 9).repartition(4, "ka", "kb").join(stored[0].hint("merge"), ["ka", "kb"], "left_anti")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
