"""Every registered query with SQL against DuckDB on the smallest tables; the optional subpackage has tests of its own."""

import math

import duckdb
import pytest

from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    found = registry.queries()[name](spark, small)
    columns = sorted(found.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    ran = duck.execute(ORACLES[name])
    named = [d[0] for d in ran.description]
    want = sorted((tuple(_plain(r[named.index(c)]) for c in columns) for r in ran.fetchall()), key=repr)
    assert sorted(named) == columns
    assert got == want
