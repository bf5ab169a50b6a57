"""Every motion query that has SQL gives its rows; the others their properties."""

from __future__ import annotations

import os

import duckdb
import pytest

from framewright import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "part", "nation"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    ours = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(ours.columns) == sorted(names)
    want = sorted([tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()], key=repr)
    got = sorted([tuple(r[c] for c in sorted(names)) for r in ours.collect()], key=repr)
    assert got == want
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    rel = con.execute(queries.SQL[name])
    assert {c: kinds.get(t, t) for c, t in ours.dtypes} == {x[0]: str(x[1]) for x in rel.description}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
