"""Traces of many components by one scan."""

from faultline import queries as q
from faultline.operators import traces as tr
from tests.test_compare import SF, scans


def test_many_components_equal_single_scans(spark):
    flat = tr.flatten(q.conversation_spans(spark, SF)).cache()
    names = [*q.RELEVANT, "USER-2", "nobody", "no de", "-", "1", "10"]
    got = {tuple(r) for r in tr.relevant_to(flat, names).collect()}
    assert got == {(c, r[0]) for c in names for r in tr.relevant(flat, c).collect()}
    assert {c for c, _ in got} >= {*q.RELEVANT, "USER-2", "-"}
    assert tr.relevant_to(flat, []).count() == 0


def test_one_scan(spark):
    assert scans(q.relevant_traces(spark, SF), "conversations") == 1
