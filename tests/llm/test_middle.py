import hashlib
import random
import re

import numpy as np

from galeframe.llm import middle as M

SCHEMA = "doc_id long, text string, n string, `form` int, `Output` double, `a b` int"


def brute(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(1)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "é\n🙂🙂\nß", "a<P>\nb", "<S", "<\nP>\n<S\nM>\n<M", "<M>", "<", "x" * 300 + "\n" + "y"]
    for _ in range(150):
        out.append("".join(draw.choice(["a", "é", "🙂", "\n", "<", "P>", "<S", ">", "word " * draw.randint(1, 60)]) for _ in range(draw.randint(1, 200))))
    return out


def test_against_brute_force_and_back(spark):
    rows = [(i, t, "n", 1, 0.5, i) for i, t in enumerate(texts())] + [(None, "a\nb\nc", None, None, None, None), (3, "a\nb", "", 0, 0.0, 1), (3, "a\nb", "", 0, 0.0, 1)]
    for rate, spm_rate, seed in [(100, 50, 7), (60, 10, 8)]:
        out = M.transform(spark.createDataFrame(rows, SCHEMA).repartition(3), rate, spm_rate, seed)
        assert out.columns == ["doc_id", "a b", "text", *M.NEW]
        back = M.restore(out["output"], out["form"]).alias("back")
        got = list(out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", back).toLocalIterator())
        assert len(got) == len(rows)
        for doc_id, text, *made, again in got:
            assert tuple(made) == brute(doc_id, text, rate, spm_rate, seed) and again == text
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert M.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_is_bounded_by_its_error_and_exact():
    draw = np.random.default_rng(2)
    for sizes in ([1] * 5000, draw.integers(1, 80, 3000), draw.pareto(0.7, 2000).astype(np.int64) + 1, [5], [10**9, 1, 1, 10**9]):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        index = M.fit(offsets)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residuals).max() <= M.ERROR + 1
    assert len(M.fit(np.arange(100_000)).firsts) == 1
    narrow, wide = (len(M.fit(np.cumsum(draw.integers(1, 80, 3000)), e).firsts) for e in (20, 100))
    assert wide < narrow < 1500


def test_segments_are_as_long_as_a_slope_allows():
    offsets = np.cumsum(np.random.default_rng(3).integers(0, 60, 400))
    at = 0
    while at < len(offsets):
        end, _ = M._cone(offsets, at, 30)
        low, high, j = -np.inf, np.inf, at + 1
        while j < len(offsets):
            rise, step = offsets[j] - offsets[at], j - at
            low, high = max(low, (rise - 30) / step), min(high, (rise + 30) / step)
            if low > high:
                break
            j += 1
        assert end == j
        at = end


def test_a_long_text(spark):
    text = "".join(f"line {i} é\n" * (i % 5) for i in range(300_000))
    (row,) = M.transform(spark.createDataFrame([(5, text)], "doc_id long, text string")).drop("text", "n_segments").toLocalIterator()
    assert tuple(row)[1:] == brute(5, text)
