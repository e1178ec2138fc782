"""Cheaper tests in front of the patterns, with the same matches."""

import re

from veilwork.fixed import SUBSCRIBER_HEADER
from veilwork.functions.text import free_mark, q
from veilwork.operators.spans import _found
from veilwork.rules import PROTECTED_RULES, RULES, listed


def test_listed_classes_match_the_same(spark):
    assert listed(r"[a-cX0-2_-]{2,3}\[a-c][^\]d-f-]") == r"[abcX012_-]{2,3}\[a-c][^\]def-]"
    texts = ["".join(map(chr, range(lo, lo + 600))) for lo in (1, 0x2000, 0x1E00)]
    chars = spark.createDataFrame([(c,) for t in texts for c in t], "c string")
    classes = {m for r in RULES + PROTECTED_RULES for m in re.findall(r"\[(?:[^\]\\]|\\.)+\]", r.value + r.before + r.after)}
    classes = sorted(c for c in classes if "-" in c)
    assert len(classes) > 20
    tests = [f"(c rlike {q('(?Ud)' + c)}) <> (c rlike {q('(?Ud)' + listed(c))})" for c in classes]
    assert chars.where(" or ".join(tests)).count() == 0


def test_neighbours_share_the_test_of_their_literals():
    sql = _found(RULES, "text", "_mark")
    assert sql.count(f"contains(text, {q(SUBSCRIBER_HEADER)})") == 1
    first = sql.index("contains(_low, 'instagram.com/')")
    assert "contains(_low, '.com/')" in sql[:first]


def test_texts_are_marked_by_one_byte(spark):
    marks = spark.createDataFrame([("plain",), ("with \u0001",)], "text string").selectExpr(f"{free_mark()} as m")
    assert [r.m for r in marks.collect()] == ["\u0001", "﷐"]
