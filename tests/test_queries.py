"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from histomesh.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def same(a, b, digits: int) -> bool:
    """Equal but for a last digit that rounding may turn."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or abs(a - b) <= 1.01 * 10**-digits + 1e-12 * abs(a)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [[r[c] for c in cols] for r in got.collect()]
    there = [[dict(zip(want.columns, r, strict=True))[c] for c in cols] for r in want.fetchall()]
    key = lambda r: [str(v) for v in r if not isinstance(v, float)] + [v if v == v else 1e300 for v in r if isinstance(v, float)]
    rows, there = sorted(rows, key=key), sorted(there, key=key)
    assert len(rows) == len(there)
    assert all(same(x, y, catalog.DIGITS[name]) for r, s in zip(rows, there, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
