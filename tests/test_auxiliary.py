"""Auxiliary verbs by hand."""

import pytest

from pagemill.functions.auxiliary import Auxiliary
from pagemill.operators import matching
from pagemill.sources.tables import Rule


def found(spark, text, *stems, allowed=()):
    rules = [Rule(k, "", auxiliary=Auxiliary(*s.split(" "), allowed=allowed)) for k, s in enumerate(stems)]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    return sorted(r.matched for r in matching.positions(docs, rules).collect())


def test_tails_that_begin_other_words(spark):
    assert found(spark, "묶어 주택담보증권 내어 지급하는 먹어 주고 늦어 지는", "어 주", "어 지") == ["늦어 지는", "먹어 주고"]


def test_no_break_spaces_and_objects(spark):
    assert found(spark, "역할을 해 왔다. 역할을해 왔다", "해 왔") == ["역할을해 왔다", "해 왔다"]
    assert found(spark, "통해 보고 대해 보는 사랑해 보라", "해 보") == []
    assert found(spark, "주장해 보고 해\n보라", "해 보") == []


def test_long_heads_only_if_allowed(spark):
    assert found(spark, "기다려 보고 매달려 보고", "려 보") == []
    assert found(spark, "기다려 보고 매달려 보고", "려 보", allowed=("기다리다", "기다려")) == ["기다려 보고"]


@pytest.mark.parametrize("head, tail, whole, other", [("어", "하", "싶어", True), ("어", "하", "먹어", False), ("아", "보", "것을", True), ("어", "보", "먹어도", True), ("어", "보", "", False)])
def test_glued(head, tail, whole, other):
    assert Auxiliary(head, tail, longest=3).is_other(whole, True) is other
    assert Auxiliary(head, tail, longest=3).is_other(whole, False) is False
