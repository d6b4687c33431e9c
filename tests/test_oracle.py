"""Every core query against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from quarrystone.queries import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(round(v, 6)))
    return plain(v.item()) if hasattr(v, "item") else v


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
