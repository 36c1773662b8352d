"""The index of cells: recall, exactness, what is read, odd rows."""

import re

import numpy as np
import pytest

from quillspark.operators import ann, search


def clustered(n, groups=20, dim=16, seed=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 1, (groups, dim))
    return (middle[draw.integers(0, groups, n)] + 0.15 * draw.normal(0, 1, (n, dim))).astype(np.float32)


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in r]) for k, r in enumerate(rows)], "id long, embedding array<float>")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered(3000)
    vectors = frame(spark, rows)
    return vectors, ann.build(vectors, f"file://{tmp_path_factory.mktemp('cells')}/index", cells=40), rows


def queries(vectors, step):
    return vectors.filter(f"id % {step} = 0").selectExpr("id AS query_id", "embedding AS query")


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 7)) for r in df.collect())


def plain(rows, asked, limit):
    unit = rows / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    out = []
    for q in asked:
        d = np.round(1 - unit @ unit[q], 12)
        best = np.lexsort((np.arange(len(d)), d))[:limit]
        out += [(q, k + 1, int(b), round(float(d[b]), 7) + 0.0) for k, b in enumerate(best)]
    return sorted(out)


def test_few_cells_give_the_recall(spark, made):
    vectors, index, _ = made
    asked = queries(vectors, 20)
    assert index.probes < 20 and index.size.sum() == 3000 and all(b.shape[1] == ann.SUB for b in index.books)
    found = ann.recall(ann.search_all(index, asked, 30), ann.brute_force(vectors, asked, 30)).first()
    assert found["queries"] == 150 and found["recall"] >= 0.9


def test_reads_the_probed_cells_only(spark, made):
    vectors, index, rows = made
    for exact in (False, True):
        df = ann.nearest(spark, index, rows[7].tolist(), 10, exact=exact)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        cells = re.search(r"cell#\d+ IN \(([\d,]+)\)|cell#\d+ INSET ([\d, ]+)|cell#\d+ = (\d+)", plan)
        read = len(re.findall(r"\d+", next(g for g in cells.groups() if g)))
        assert read <= (20 if exact else index.probes)
        assert "PartitionFilters" in df._jdf.queryExecution().executedPlan().toString()
        assert [r["id"] for r in df.collect()][0] == 7


def test_exact_search_is_the_full_scan(spark, made):
    vectors, index, rows = made
    for q in (rows[3], clustered(1, seed=9)[0] * 5):
        want = [tuple(r) for r in search.dense_leg(vectors, q.tolist(), 30).collect()]
        assert [tuple(r) for r in ann.nearest(spark, index, q.tolist(), 30, exact=True).collect()] == want
    assert as_rows(ann.search_all(index, queries(vectors, 100), 30, exact=True)) == plain(rows, range(0, 3000, 100), 30)
    assert as_rows(ann.brute_force(vectors, queries(vectors, 100), 30)) == plain(rows, range(0, 3000, 100), 30)


def test_bounds_leave_cells_out(made):
    _, index, rows = made
    unit = rows[:1] / np.linalg.norm(rows[:1])
    least = index.least(index.gaps(unit))[0]
    assert (least > 0.2).sum() > 10  # farther than any of the 30 neighbours of a row in a group of 150


def test_tiles_and_crowded_cells(spark, tmp_path, monkeypatch):
    """A third of the rows are one vector; tiles hold 32 rows."""
    monkeypatch.setattr(ann, "TILE_BYTES", 8 * 16 * 32)
    rows = clustered(600)
    rows[::3] = rows[0]
    vectors = frame(spark, rows).repartition(5)
    index = ann.build(vectors, f"{tmp_path}/index", cells=6, probes=2)
    asked = queries(vectors, 20)
    want = plain(rows, range(0, 600, 20), 30)
    assert as_rows(ann.search_all(index, asked, 30, exact=True)) == want
    found = ann.recall(ann.search_all(index, asked, 30), ann.brute_force(vectors, asked, 30)).first()
    assert found["recall"] > 0.5  # two of six cells
    assert [r["id"] for r in ann.nearest(spark, index, rows[0].tolist(), 5, exact=True).collect()] == [0, 3, 6, 9, 12]
    assert [r["id"] for r in ann.nearest(spark, index, rows[0].tolist(), 5).collect()] == [0, 3, 6, 9, 12]


def test_odd_rows(spark, tmp_path):
    data = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, 2.0]), (6, [2.0, 0.0, 0.0]), (6, [2.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in data], "id long, embedding array<float>, cell string")
    index = ann.build(vectors, f"{tmp_path}/index")
    assert index.size.sum() == 4
    assert [r["id"] for r in ann.nearest(spark, index, [1.0, 0.1, 0.0], 9, exact=True).collect()] == [1, 6, 6, None]
    none = ann.nearest(spark, index, [0.0, 0.0, 0.0], 9)
    assert none.collect() == [] and none.columns == ["id", "dense_distance", "dense_rank"]
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", None), ("c", [0.0, 0.0, 0.0])], "query_id string, query array<double>")
    for exact in (False, True):
        assert {r["query_id"] for r in ann.search_all(index, asked, 2, exact=exact).collect()} == {"a"}
    empty = ann.build(vectors.filter("false"), f"{tmp_path}/empty")
    assert ann.nearest(spark, empty, [1.0], 3).collect() == [] and ann.search_all(empty, asked.selectExpr("query_id", "array(1.0) AS query"), 3).collect() == []


def test_opened_again_it_is_the_same(spark, made):
    index = ann.open_index(spark, made[1].folder)
    assert (index.centres == made[1].centres).all() and index.probes == made[1].probes and len(index.books) == len(made[1].books)
