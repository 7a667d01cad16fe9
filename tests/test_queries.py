"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from kgloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if isinstance(value, (float, np.floating)):
        return float(f"{value:.9g}")
    if isinstance(value, (int, np.integer)) and not isinstance(value, bool):
        return float(f"{value:.15g}") if abs(value) < 1e15 else int(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    if name not in catalog.SQL:
        assert len(set(names)) == len(names)
        return
    found = duck.execute(catalog.SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(repr([plain(r[order.index(c)]) for c in names]) for r in found.fetchall())
    assert rows == want
