"""The inverted index: blocks and bounds, segments that ingest replaces, what a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark import model
from quillspark.functions import lexical
from quillspark.functions.stem import stem
from quillspark.operators import index, postings, search
from quillspark.sources import store

WORDS = [f"w{k}" for k in range(40)]


def invented(n, seed=1):
    """Words of falling frequency; some names; ids with gaps, below zero too."""
    draw = random.Random(seed)
    return [(k * 37 - 900, f"r{k % 3}", draw.choice([None, "", "Alpha", "w1"]), " ".join(draw.choices(WORDS, [1 / (j + 1) for j in range(40)], k=draw.randint(0, 60)))) for k in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(invented(1500), "id long, repo_source string, symbol_name string, content string")
    rows = rows.withColumn("lexemes", lexical.lexemes(F.col("content"))).withColumn("doc_len", F.size(F.filter("lexemes", lambda t: t != "")))
    return rows.cache()


ASKED = ("w0", "w39", "w0 w1", "w5 w9 w30", '"w0 w1"', "w3 -w0", "w39 or w38", "alpha", "w1", '"w0 w0" or w37', "none", '"')


@pytest.mark.parametrize("first", [1, 4, 64])
def test_same_as_a_scan_whatever_is_scored_first(spark, chunks, tmp_path, monkeypatch, first):
    monkeypatch.setattr(postings, "FIRST_SPANS", first)
    folder = str(tmp_path / "index")
    postings.write(chunks, folder)
    for asked in ASKED:
        for limit in (3, 30):
            want = [tuple(r) for r in search.lexical_leg(chunks, asked, limit, 1.0).collect()]
            got = [tuple(r) for r in postings.lexical_leg(spark, folder, asked, limit, 1.0).collect()]
            assert [(i, r, pytest.approx(s)) for i, s, r in want] == [(i, r, s) for i, s, r in got], (asked, limit)
    want = [r["id"] for r in search.lexical_leg(chunks.filter("repo_source = 'r1'"), "w2", 5, 1.0).collect()]
    assert [r["id"] for r in postings.lexical_leg(spark, folder, "w2", 5, 1.0, repo="r1").collect()] == want


def test_blocks_hold_all_postings_and_their_best(spark, chunks, tmp_path):
    postings.write(chunks, str(tmp_path / "index"))
    found = postings.blocks(spark, str(tmp_path / "index"))
    assert found.agg(F.max(F.size("posts"))).first()[0] <= postings.SPAN
    flat = found.select("term", "span", "best", F.explode("posts").alias("p")).select("term", "best", (F.col("span") * postings.SPAN + F.col("p.off")).alias("id"), "p.*").filter("term not like '=%'")
    want = chunks.select("id", F.posexplode(F.filter("lexemes", lambda t: t != "")).alias("place", "term")).groupBy("id", "term").agg(F.sort_array(F.collect_list("place")).alias("places"))
    assert sorted(map(tuple, flat.select("id", "term", "places").collect())) == sorted(map(tuple, want.collect()))
    assert flat.filter("best + 1e-12 < times / (1 + ln(greatest(len, 1)))").count() == 0


def test_spans_below_the_running_score_are_not_read(spark, tmp_path, monkeypatch):
    """One span holds the best rows; the others' bounds stay below them, so the second reading does not take place."""
    monkeypatch.setattr(postings, "FIRST_SPANS", 1)
    rows = [(k, "r", None, "hit " * 9 if k < 40 else "hit and other words here") for k in range(3000)]
    table = spark.createDataFrame(rows, "id long, repo_source string, symbol_name string, content string").withColumn("lexemes", lexical.lexemes(F.col("content"))).withColumn("doc_len", F.size(F.filter("lexemes", lambda t: t != "")))
    postings.write(table, str(tmp_path / "index"))
    joined = []
    scored = postings._scored
    monkeypatch.setattr(postings, "_scored", lambda rows, *a: joined.append(1) or scored(rows, *a))
    got = postings.lexical_leg(spark, str(tmp_path / "index"), "hit", 30, 1.0)
    assert len(joined) == 1 and [r["id"] for r in got.collect()] == list(range(30))
    assert len(postings.lexical_leg(spark, str(tmp_path / "index"), "hit", 60, 1.0).collect()) == 60 and len(joined) == 3


def test_shards_are_known_from_the_term_alone(spark):
    for n in (1, 2, 64, 1 << 14):
        for term in ("a", "é漢", "=name", ""):
            made = spark.range(1).select(postings._shard(F.lit(term), n)).first()[0]
            assert made in postings.shards_of(term) and n <= made < 2 * n
    assert [postings.shards_for(n) for n in (0, 1, 4_000_000, 4_000_001, 10**13)] == [1, 1, 1, 2, 1 << 14]


def test_a_repository_has_as_many_shards_as_its_own_postings_need(spark, tmp_path, monkeypatch):
    """Not as many as all need together: a file for each shard of each small repository would cost more than its rows.  Spans cut into several rows are found whole."""
    monkeypatch.setattr(postings, "SHARD_ROWS", 100)
    rows = [(k, "small" if k % 100 == 7 else "large", None, ["hit", *(f"w{k * j % 50}" for j in range(9))], 10) for k in range(600)]
    table = spark.createDataFrame(rows, "id long, repo_source string, symbol_name string, lexemes array<string>, doc_len int")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        postings.write(table, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    folder = str(tmp_path / "index")
    assert postings.blocks(spark, folder).groupBy("term", "span", "repo_source").count().agg(F.max("count")).first()[0] > 1
    shards = lambda repo: {r["shard"] for r in postings.blocks(spark, folder, repo).select("shard").distinct().collect()}
    assert shards("small") == {1} and min(shards("large")) >= 32
    want = [r["id"] for r in search.lexical_leg(table, "hit w3", 30, 1.0).collect()]
    assert [r["id"] for r in postings.lexical_leg(spark, folder, "hit w3", 30, 1.0).collect()] == want
    assert spark.createDataFrame([(n, postings.shards_for(n)) for n in (0, 1, 100, 101, 200, 201, 800, 10**13)], "n long, want int").filter(postings._shards_for(F.col("n")) != F.col("want")).count() == 0


def test_a_span_of_several_rows_counts_once_in_its_bound(spark):
    heads = spark.createDataFrame([("r", 0, "x", 0.5), ("r", 0, "x", 2.0), ("r", 0, "y", 1.0), ("r", 1, "x", 9.0)], "repo_source string, span long, term string, best double")
    assert [tuple(r) for r in postings._bounds(heads, lexical.parse_query("x y"), "=x y", 1.0).collect()] == [("r", 0, 3.0)]


def chunk_rows(spark, texts, repo):
    fields = [f.split(" ")[0] for f in model.CHUNK_FIELDS.split(", ")]
    rows = [{"file_path": f"f{k}.md", "kind": "window", "start_line": 1, "end_line": 1, "is_exported": False, "language": "markdown", "chunker_kind": "generic", "part_index": 1, "part_total": 1, "content": t} for k, t in enumerate(texts)]
    made = spark.createDataFrame([tuple(r.get(f) for f in fields) + (k, f"hash {repo} {k}", r["content"]) for k, r in enumerate(rows)], f"{model.CHUNK_FIELDS}, seq long, content_hash string, embed_text string")
    return made


def test_ingest_keeps_the_index_in_step(spark, tmp_path):
    table, cache, folder = (str(tmp_path / x) for x in ("chunks", "cache", "postings"))
    put = lambda texts, repo: index.index_chunks(chunk_rows(spark, texts, repo), repo, table, cache, dim=8, postings_path=folder)
    found = lambda asked, repo=None: sorted(r["id"] for r in postings.lexical_leg(spark, folder, asked, 9, 1.0, stem, repo).collect())
    stored = lambda word: sorted(r["id"] for r in store.read_chunks(spark, table).filter(F.col("content").contains(word)).collect())
    assert not store.exists(spark, folder)
    put(["apple pear", "pear"], "one repo: a/b c")
    put(["apple", "plum"], "two")
    assert postings.covers(spark, folder, table) and postings.covers(spark, folder, table, "two")
    for word in ("apple", "pear", "plum"):
        assert found(word) == stored(word) != []
    assert len(found("apple", "two")) == 1 and found("apple", "three") == []
    put(["plum tree"], "one repo: a/b c")
    for word in ("apple", "pear", "plum", "tree"):
        assert found(word) == stored(word)
    put([], "two")
    assert found("apple") == [] and found("plum") == stored("plum") != [] and postings.covers(spark, folder, table)
    index.index_chunks(chunk_rows(spark, ["late"], "three"), "three", table, cache, dim=8)
    assert not postings.covers(spark, folder, table) and not postings.covers(spark, folder, table, "three") and postings.covers(spark, folder, table, "two")


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "r", "", [], 0), (3, None, "Name", ["", "zz", "", "zz"], 2), (4, "r", "zz", ["b"], 1)]
    chunks = spark.createDataFrame([(*r, "x") for r in rows], "id long, repo_source string, symbol_name string, lexemes array<string>, doc_len int, term string")
    postings.write(chunks, str(tmp_path / "index"))
    assert [r["id"] for r in postings.lexical_leg(spark, str(tmp_path / "index"), "zz", 9, 1.0).collect()] == [3, 4]
    assert [r["id"] for r in postings.lexical_leg(spark, str(tmp_path / "index"), '"zz zz"', 9, 1.0).collect()] == [3]
    postings.write(chunks.filter("false"), str(tmp_path / "empty"))
    assert postings.lexical_leg(spark, str(tmp_path / "missing"), "a", 9, 1.0).collect() == []


def test_rows_without_an_id_keep_their_postings(spark, tmp_path):
    rows = [(None, "r", None, ["a1", "b1", "a1"], 3), (0, "r", None, ["a1"], 1), (-1, "r", None, ["b1"], None)]
    postings.write(spark.createDataFrame(rows, "id long, repo_source string, symbol_name string, lexemes array<string>, doc_len int"), str(tmp_path / "index"))
    flat = postings.blocks(spark, str(tmp_path / "index")).select("term", "span", F.explode("posts").alias("p")).select("term", (F.col("span") * postings.SPAN + F.col("p.off")).alias("id"), "p.times", "p.places")
    assert sorted(map(str, map(tuple, flat.collect()))) == sorted(map(str, [("a1", None, 2, [0, 2]), ("b1", None, 1, [1]), ("a1", 0, 1, [0]), ("b1", -1, 1, [0])]))
