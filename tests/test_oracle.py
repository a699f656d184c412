"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    """Rows with columns by name; what isn't a float comes first and orders them."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    both = [([r[k] for k in order if not isinstance(r[k], float)], [r[k] for k in order if isinstance(r[k], float)]) for r in rows]
    return sorted(both, key=str)


def alike(x, y):
    return x[0] == y[0] and len(x[1]) == len(y[1]) and all(p == q or math.isnan(p) and math.isnan(q) or abs(p - q) <= 2e-6 * max(1, abs(q)) for p, q in zip(x[1], y[1]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = plain(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert all(alike(x, y) for x, y in zip(got, want))
