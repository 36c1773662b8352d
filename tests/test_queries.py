"""Every catalogue query against its SQL on the smallest tables, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in data) if all(v is not None for r in data for v in r) else sorted((tuple(repr(round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in data))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_only_texts_that_have_a_vector_are_cut_into_terms(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "_indexed", {})
    monkeypatch.setattr(catalog.postings, "write", lambda chunks, *_, **__: made.append(chunks))
    catalog.lexical_index(spark, SF, catalog.vector_chunks)
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Join")  # above it
    want = catalog.vector_chunks(spark, SF)
    assert sorted(r["id"] for r in made[0].select("id").collect()) == sorted(r["id"] for r in want.select("id").collect())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.dirname(__file__))
    for folder, _, files in os.walk(os.path.join(root, "quillspark")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read(), f
