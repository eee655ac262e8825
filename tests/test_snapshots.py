from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.operators.snapshots import canonical_json, snapshot_changes

DOCS = "id long, sweep_id long, source string, external_id string, kind string, scope string, payload string, fetched_at timestamp"
SWEEPS = "id long, source string, scope string, started_at timestamp, complete boolean"
JOBS = "source string, scope string, external_id string, closed_at timestamp"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"a": 1, "b": [1, 2]}', '{"b":[1.0,2e0],"a":1}', True),
        ('{"a": 1, "views": 5, "x": {"trace_id": "q"}}', '{"a": 1, "x": {}}', True),
        ('{"a": null}', "{}", True),
        ('{"a": "\\u00fc"}', '{"a": "ü"}', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ('{"a": "1"}', '{"a": 1}', False),
        ('{"a": 0.5}', '{"a": 0.25}', False),
        ("no json ", "no json", True),
        ("", " ", True),
        ('{"a": 1e999999999}', '{"a": 2}', False),
    ],
)
def test_canonical(a, b, same):
    assert (canonical_json(a) == canonical_json(b)) == same


@given(st.dictionaries(st.text(max_size=5), st.integers() | st.text(max_size=5) | st.booleans(), max_size=5))
def test_layout_does_not_count(d):
    assert canonical_json(json.dumps(d)) == canonical_json(json.dumps(dict(reversed(d.items())), indent=3, ensure_ascii=False))


def test_changes(spark):
    t = "2026-01-0{} 00:00:00".format
    import datetime as dt

    at = lambda d, m=0: dt.datetime(2026, 1, d, 1, m, tzinfo=dt.timezone.utc)
    sweeps = [(1, "s", "b", at(1), True), (2, "s", "b", at(2), False), (3, "s", "b", at(3), True), (4, "s", "b", at(4), True), (5, "s", None, at(5), True)]
    docs = [
        (1, 1, "s", "X", "listing", "b", '{"v": 1}', at(1)),
        (2, 1, "s", "y", "listing", "b", '{"v": 1}', at(1)),
        (3, 2, "s", "z", "listing", "b", '{"v": 1}', at(2)),
        (4, 3, "s", " x\t", "listing", "b", '{"v": 9}', at(3)),
        (5, 3, "s", "x", "listing", "b", '{"v": 1.0, "views": 3}', at(3, 5)),
        (6, 3, "s", "w", "listing", "b", None, at(3)),
        (7, 3, "s", "y", "detail", "b", "{}", at(3)),
        (8, 4, "s", "x", "listing", "b", '{"v": 2}', at(9)),
        (9, 4, "s", "w", "listing", "b", None, at(4)),
        (10, 4, "s", None, "listing", "b", "{}", at(4)),
    ]
    jobs = [("s", "b", "x", at(4)), ("s", "b", "y", None), ("s", "b", "w", None), ("s", "b", "gone", None)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(docs, DOCS), spark.createDataFrame(sweeps, SWEEPS), spark.createDataFrame(jobs, JOBS)).collect()}
    assert got == {(3, "y", "removed"), (3, "w", "added"), (4, "x", "changed"), (4, "x", "closed_at_wrong"), (4, "y", "closed_at_wrong")}, t


def test_empty_sweep_removes_all_and_empty_tables(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2026, 1, d, tzinfo=dt.timezone.utc)
    sweeps = spark.createDataFrame([(1, "s", "b", at(1), True), (2, "s", "b", at(2), True)], SWEEPS)
    docs = spark.createDataFrame([(1, 1, "s", "x", "listing", "b", "{}", at(1))], DOCS)
    none = spark.createDataFrame([], JOBS)
    assert [tuple(r) for r in snapshot_changes(docs, sweeps, none).collect()] == [(2, "x", "removed")]
    assert snapshot_changes(spark.createDataFrame([], DOCS), sweeps, none).count() == 0
    assert snapshot_changes(docs, spark.createDataFrame([], SWEEPS), none).count() == 0
