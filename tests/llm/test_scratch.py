import os

import pytest

from galeframe.llm import common, lines, similar, substrings
from galeframe.llm import components as C
from tests.llm.test_similar import corpus
from tests.llm.test_simhash import SCHEMA


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))


def tables(spark):
    folder = f"{common.shared_dir(spark)}/llm"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def left(spark, before):
    return sorted(name.split("-")[0] for name in tables(spark) - before)


def test_tables_of_a_block_go_but_for_those_kept(spark):
    before = tables(spark)
    with common.scratch() as keep:
        with common.scratch() as still:
            common.saved(spark.range(2), "one")
            two, three = still(common.saved(spark.range(3), "two")), keep(still(common.saved(spark.range(4), "three")))
            assert left(spark, before) == ["one", "three", "two"]
        assert left(spark, before) == ["three", "two"] and two.count() == 3
    assert left(spark, before) == ["three"] and three.count() == 4
    with pytest.raises(ValueError), common.scratch():
        common.saved(spark.range(2), "four")
        raise ValueError
    assert left(spark, before) == ["three"]


def test_near_duplicates_leave_what_the_result_reads(spark):
    docs = spark.createDataFrame([(*r, "x", None) for r in corpus()[:150]], SCHEMA)
    before = tables(spark)
    similar.keep_one(docs).count()
    assert left(spark, before) == ["found", "repeated", "winners"]


def test_line_dedup_leaves_what_the_result_reads(spark):
    docs = spark.createDataFrame([(i, "x" * 50 + f"\n{i}") for i in range(8)], "doc_id long, text string")
    before, names = tables(spark), len(spark.catalog.listTables())
    assert sum(r["n_dropped"] for r in lines.drop_lines(docs).toLocalIterator()) == 7
    assert left(spark, before) == ["gone"] and len(spark.catalog.listTables()) == names


def test_substrings_leave_what_the_result_reads(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{text} v{i}") for i in range(4)], "doc_id long, text string")
    before = tables(spark)
    assert {r["longest"] for r in substrings.remove_repeats(docs).toLocalIterator()} == {200}
    assert left(spark, before) == ["spans"]


def test_doubling_deals_windows_once(spark):
    rows = [(1, 2, s, 10 + s, 20 + s, 0) for s in (0, 50, 51, 100, 100)] + [(3, 2, s, s, s, 0) for s in (7, 57)]
    rows = spark.createDataFrame(rows, "_order long, _text_hash long, s int, ha long, hb long, low long")
    out = substrings.doubled(rows, 50)
    assert sorted((r["_order"], r["s"]) for r in out.toLocalIterator()) == [(1, 0), (1, 50), (3, 7)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_components_need_no_round_to_see_stars(spark):
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    before = tables(spark)
    stars = C.components(links([(2, 1), (1, 3), (9, 8), (4, 4)]))
    assert sorted(map(tuple, stars.toLocalIterator())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert left(spark, before) == ["links"]  # written once
    chain = C.components(links([(i, i + 1) for i in range(40)] + [(50, 60), (70, 60)]))
    assert sorted(map(tuple, chain.toLocalIterator())) == [(i, 0) for i in range(41)] + [(50, 50), (60, 50), (70, 50)]
    assert left(spark, before) == ["links", "links"]
