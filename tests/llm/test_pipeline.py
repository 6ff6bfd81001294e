import numpy as np
import pytest

import corpus_pipeline as C
from galeframe.llm import packing
from tests.llm import test_lines, test_packing, test_secrets, test_similar

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = C.documents(spark, FOLDER)
    extra = [(9000, None, "en", "x", 0), (9001, "12 345 !", "en", None, 8), (9002, "", None, "x", 0), (9003, "The.", "en", "x", 4)]
    extra += [(9004, "the token = 0a1b2c3d4e of the house", "en", "x", 35)]
    docs = C.saved(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "start")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(C.saved(stage(spark, out[-1], FOLDER), name))
    return [sorted(df.toLocalIterator(), key=lambda r: r["doc_id"]) for df in out], docs.columns, out


def test_columns_of_documents_are_kept(stages):
    _, columns, frames = stages
    assert all(df.columns == columns for df in frames[:-1])
    assert all(df.schema == frames[0].schema for df in frames[:-1])


def test_language_stage_drops_what_has_no_language(stages):
    start, kept = stages[0][0], stages[0][1]
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in kept}
    assert gone == {9000, 9001, 9002}
    assert kept == [r for r in start if r["doc_id"] not in gone]


def test_line_stage(stages):
    before, after = stages[0][1], stages[0][2]
    expected = {d: text for d, _, _, text in test_lines.brute([(r["doc_id"], r["text"]) for r in before], 40, 5)}
    assert {r["doc_id"]: r["text"] for r in after} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup_stage(stages):
    before, after = stages[0][2], stages[0][3]
    kept, _ = test_similar.brute([(r["doc_id"], r["text"]) for r in before])
    assert after == [r for r in before if r["doc_id"] in kept] and len(after) < len(before)


def test_secret_stage(stages):
    before, after = stages[0][3], stages[0][4]
    changed = 0
    for b, a in zip(before, after, strict=True):
        text, spans = b["text"], sorted(test_secrets.base(b["text"]) + test_secrets.entropy(b["text"]))
        out, at = "", 0
        for start, _, end, _ in spans:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert a["text"] == out + text[at:]
        changed += a["text"] != text
    assert changed


def test_packing_stage(stages):
    before, after = stages[0][4], stages[0][5]
    t, expected = test_packing.library(), []
    for r in before:
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        cuts = enumerate(packing.cuts(len(ids), 1024))
        expected += [(r["doc_id"], k, s, n, packing.zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in cuts]
    assert sorted(tuple(r)[:5] for r in after) == sorted(expected)
    assert test_packing.valid(after, 1024) == test_packing.best_fit_decreasing([e[3] for e in expected], 1024)


def test_run_is_the_stages_one_after_another(spark):
    assert C.run(spark, FOLDER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
