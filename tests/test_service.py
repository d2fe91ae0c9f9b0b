"""Retries and kept reports."""

import pytest

from lumenq.plans.reports import Reports
from lumenq.streaming import retry


def test_causes():
    def chained():
        try:
            raise ConnectionResetError("x")
        except ConnectionResetError as e:
            raise RuntimeError("batch failed") from e

    with pytest.raises(RuntimeError) as e:
        chained()
    assert retry.transient(e.value) and retry.transient(RuntimeError("pool timed out")) and retry.transient(TimeoutError())
    assert not retry.transient(ValueError("connection reset")) and not retry.transient(KeyError("a"))


def test_parked_rows_come_back_later_each_time_and_die(spark):
    rows = spark.createDataFrame([("a",)], "value string")
    p = retry.park(rows, "db", 0)
    assert p.first()[1:3] == (1, 30_000_000)
    assert [x.count() for x in retry.due(p, 29_999_999)] == [0, 1, 0] and [x.count() for x in retry.due(p, 30_000_000)] == [1, 0, 0]
    again = retry.park(p, "db", 0)
    assert again.first()[1:3] == (2, 60_000_000)
    assert [x.count() for x in retry.due(again, 60_000_000, attempts=2)] == [0, 0, 1]


def test_reports_are_fresh_then_stale(spark):
    now = [0.0]
    r = Reports(spark, 10, lambda: now[0])
    one, two = (lambda: spark.range(1)), (lambda: spark.range(2))

    def broken():
        raise OSError("no")

    assert r.get("k", one)[0].count() == 1 and r.get("k", two)[0].count() == 1
    now[0] = 11
    df, stale = r.get("k", broken)
    assert stale and df.count() == 1
    df, stale = r.get("k", two)
    assert not stale and df.count() == 2
    with pytest.raises(OSError):
        r.get("other", broken)
