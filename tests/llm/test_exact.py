import hashlib
import re

import pytest

from galeframe.llm import exact

SCHEMA = "doc_id long, text string, sha string"


def brute(rows):
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, len(text or "")))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(bare.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


ROWS = (
    [(i, f"text number {i}", None) for i in range(300)]
    + [(1000 + i, "a  copy" if i == 7 else "a copy", "x") for i in range(200)]
    + [(2000, "a\x0b\x0ccopy ", None), (2001, None, None), (2002, "", None), (2003, " \t\n", None)]
    + [(2004, "a copy", None), (None, "a copy", None), (None, "no id", None), (5, "text number 5", None)]
    + [(2005, "long " * 200_000, None), (2006, "long" * 200_000, None)]
)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"bits_per_row": 1}])
def test_against_brute_force(spark, limits):
    got = exact.deduplicate(spark.createDataFrame(ROWS, SCHEMA), **limits).toPandas()
    to_int = lambda x: None if x != x or x is None else int(x)
    found = [(to_int(r.doc_id), to_int(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got.itertuples()]
    assert sorted(found, key=str) == brute(ROWS)


def test_empty_table(spark):
    assert exact.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_most_unique_rows_pass_without_a_shuffle(spark):
    rows = exact.digests(spark.createDataFrame([(i, f"t{i}", None) for i in range(5000)], SCHEMA))
    bits = exact.repeated_bits(rows, 4)
    tested = exact.with_bits(rows, 4).join(bits, "block", "left")
    assert tested.filter(exact._set("bit1") & exact._set("bit2")).count() < 300
