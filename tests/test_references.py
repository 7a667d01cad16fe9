"""Broken references: every state, nulls, blanks, repeats, empty tables and clashing columns."""

from datetime import datetime

import numpy as np

from kgloom.operators import references as R

CHILD = "row_id long, subject string, at timestamp, tab string, key string, period int, id long"
PARENT = "name string, created_at timestamp, deleted_at timestamp, state string"


def t(month):
    return datetime(2025, month, 10)


def rows(spark, child, parent, deleted="deleted_at"):
    c = spark.createDataFrame([(*x, "x", "y", 1, 2) for x in child], CHILD)
    p = spark.createDataFrame([(*x, "z") for x in parent], PARENT)
    ref = R.Reference("facts", c, "subject", "at", "row_id", p, "name", "created_at", deleted)
    return {tuple(r) for r in R.orphan_references([ref]).collect()}


def test_states(spark):
    parent = [("a", t(1), None), ("b", t(1), t(2)), ("c", t(5), None), ("d", t(5), None), ("d", None, None), ("e", t(1), t(2)), ("e", t(3), None), (None, t(1), None), (" ", t(1), None)]
    child = [(1, "a", t(2)), (2, " b　", t(3)), (3, "c", t(4)), (4, "d", t(4)), (5, "e", t(1)), (6, "x", t(6)), (7, "x", None), (8, None, t(1)), (9, "  ", t(1)), (10, "c", t(5)), (11, "c", None), (3, "c", t(4))]
    assert rows(spark, child, parent) == {
        ("facts", "2", "deleted", "2025-03"),
        ("facts", "3", "late", "2025-04"),
        ("facts", "6", "missing", "2025-06"),
        ("facts", "7", "missing", "unknown"),
    }


def test_same_month_is_decided_by_time(spark):
    parent = [("a", datetime(2025, 5, 20), None)]
    child = [(1, "a", datetime(2025, 5, 1)), (2, "a", datetime(2025, 5, 25)), (3, "a", datetime(2025, 5, 20))]
    assert rows(spark, child, parent) == {("facts", "1", "late", "2025-05")}


def test_empty_tables(spark):
    assert rows(spark, [], []) == set()
    assert rows(spark, [(1, "a", t(1))], []) == {("facts", "1", "missing", "2025-01")}
    assert rows(spark, [], [("a", t(1), None)]) == set()


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500, 5000, 1 << R.RANGE_BITS):
        on = np.zeros(1 << R.RANGE_BITS, bool)
        on[rng.choice(len(on), n, replace=False)] = True
        raw = np.packbits(on, bitorder="little").tobytes()
        assert (R.expand(R.compress(raw)) == on).all()
        assert len(R.compress(raw)) <= len(raw) + 1
    assert not R.expand(None).any()


def test_many_keys_cross_ranges(spark):
    n = 70_000
    child = spark.range(n).selectExpr("id as row_id", "cast(id as string) as subject", "timestamp'2025-01-01' as at")
    parent = spark.range(0, n, 2).selectExpr("cast(id as string) as name", "timestamp'2024-01-01' as created_at")
    ref = R.Reference("facts", child, "subject", "at", "row_id", parent, "name", "created_at")
    got = R.orphan_references([ref])
    assert got.count() == n // 2
    assert got.filter("row_key % 2 = 0").count() == 0
