"""Queries that SQL can state, against that SQL."""

import os

import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    tidy = lambda rows: sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)
    assert tidy(tuple(r) for r in df.select(*names).collect()) == tidy(want.fetchall())
