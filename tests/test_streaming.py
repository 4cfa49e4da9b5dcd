"""Each streaming job equals its batch operator on the same rows."""

import __spark_entry__ as entry
from conftest import rows

SF = "/root/testdata/sf0.001"


def test_stream_vote_equals_batch(spark):
    q = entry.queries()
    assert rows(q["stream_vote"](spark, SF)) == rows(q["vote_decision"](spark, SF))


def test_stream_budget_equals_batch(spark):
    q = entry.queries()
    assert rows(q["stream_budget"](spark, SF)) == rows(q["within_budget"](spark, SF))


def test_stream_once_is_distinct(spark):
    out = entry.queries()["stream_once"](spark, SF)
    assert out.count() == out.distinct().count()


def test_stream_status_equals_batch_parse(spark):
    q = entry.queries()
    assert rows(q["stream_status"](spark, SF)) == rows(q["parse_logs"](spark, SF))
