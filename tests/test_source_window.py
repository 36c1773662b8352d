"""The join of blocks and line ranges: against the plain one, and spread over keys."""

import random

from pyspark.sql import functions as F

from quillspark.operators import source_window


def plain(chunks, requests):
    meet = chunks.join(source_window.requested(requests), ["repo_source", "file_path"])
    return meet.filter((F.col("end_line") >= F.col("from_line")) & (F.col("start_line") <= F.col("to_line")))


def made(spark):
    draw, chunks = random.Random(7), []
    for k in range(1500):
        start = draw.choice([1, 399, 400, 401, 800, draw.randint(1, 50_000)])
        chunks.append((k, "r", f"f{k % 3}", start, start + draw.choice([0, 0, 1, 9, 399, 400, 401, 5000, 40_000, 3_000_000])))
    chunks += [(9000, "r", "f0", None, None), (9001, None, "f0", 1, 5), (9002, "r", "f0", 9, 5), (9003, "other", "f0", 1, 99)]
    requests = [(k, "r", f"f{k % 3}", start, start + draw.choice([0, 3, 40, 399, 4000])) for k, start in enumerate(draw.choice([1, 400, 401, draw.randint(1, 60_000)]) for _ in range(200))]
    requests += [(900, "r", "f0", 20, 10), (901, "r", None, 1, 9), (902, "r", "f0", None, None)]
    return spark.createDataFrame(chunks, "id long, repo_source string, file_path string, start_line int, end_line int"), spark.createDataFrame(requests, "request_id long, repo_source string, file_path string, start_line int, end_line int")


def test_same_pairs_as_the_plain_join(spark):
    chunks, requests = made(spark)
    got, want = source_window.blocks(chunks, requests), plain(chunks, requests)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select("request_id", "id", "from_line", "to_line", "start_line", "end_line").collect()))
    found = [r for r in rows(got) if r[0] != 900 and r[1] != 9002]
    assert found == [r for r in rows(want) if r[0] != 900 and r[1] != 9002] and len(found) > 1000
    assert len(rows(got)) == len(set(rows(got)))


def test_a_file_with_a_third_of_all_blocks_is_many_keys(spark):
    chunks = spark.range(30_000).selectExpr("id", "'r' AS repo_source", "IF(id % 3 = 0, 'huge', 'f' || id) AS file_path", "CAST(IF(id % 3 = 0, id * 4, 1) AS int) AS start_line", "CAST(IF(id % 3 = 0, id * 4 + 12, 9) AS int) AS end_line")
    requests = spark.range(300).selectExpr("id AS request_id", "'r' AS repo_source", "'huge' AS file_path", "CAST(id * 400 AS int) AS start_line", "CAST(id * 400 + 50 AS int) AS end_line")
    plan = source_window.blocks(chunks.hint("shuffle_hash"), requests)
    found = plan.groupBy("request_id").count().agg(F.max("count"), F.count("*")).first()
    assert found[0] < 20 and found[1] == 300
    level0 = chunks.filter("file_path = 'huge'").withColumn("bin", F.floor(F.col("start_line") / source_window.BIN)).groupBy("bin").count()
    assert level0.agg(F.max("count")).first()[0] <= 100  # of 10,000 blocks of that file


def test_gaps_from_covered_lines_are_those_of_all_pairs(spark):
    draw, span = random.Random(3), "repo_source string, file_path string, start_line int, end_line int"
    starts = [draw.randint(1, 9000) for _ in range(600)]
    chunks = [("r", f"f{k % 3}", a, a + draw.choice([0, 0, 1, 9, 40, 399])) for k, a in enumerate(starts)] + [("r", "f0", 20_000, 3_000_000), ("r", "f1", 2_147_400_000, 2_147_483_647), ("r", "f0", None, None)]
    requests = [(k, "r", f"f{k % 4}", a, a + draw.choice([0, 3, 40, 399, 4000])) for k, a in enumerate(draw.randint(1, 30_000) for _ in range(400))] + [(900, "r", "f0", 20, 10), (901, "r", "f1", 2_147_399_900, 2_147_400_100)]
    want = []
    for k, _, f, a, b in requests:
        lines = set(range(a, min(b, a + 399) + 1))
        free = sorted(lines - {x for _, g, s, e in chunks if g == f and s is not None and e >= a and s <= a + 399 for x in range(max(s, a), min(e, a + 399) + 1)})
        if len(free) < len(lines):
            want += [(k, x, next(y for y in range(x, b + 1) if y + 1 not in free)) for x in free if x - 1 not in free]
    found = source_window.uncovered(spark.createDataFrame(chunks, span), spark.createDataFrame(requests, f"request_id long, {span}"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50
    odd = spark.createDataFrame([("r", "f", 5, 6), ("r", "f", 20, 12), ("r", "f", 30, 30)], span)
    asked = spark.createDataFrame([(1, "r", "f", 1, 40)], f"request_id long, {span}")
    assert sorted(map(tuple, source_window.uncovered(odd, asked).collect())) == sorted(map(tuple, source_window.gaps(source_window.blocks(odd, asked), asked).collect()))


def test_blocks_with_the_same_lines_cross_the_join_and_the_sort_as_one_row(spark, monkeypatch):
    monkeypatch.setattr(source_window, "PACK", 7)
    monkeypatch.setattr(source_window, "TILE", 16)
    chunks = spark.range(600).selectExpr("id", "'r' AS repo_source", "'f' AS file_path", "CAST(1 + id % 3 * 10 AS int) AS start_line", "CAST(4 + id % 3 * 10 AS int) AS end_line")
    requests = spark.range(100).selectExpr("id AS request_id", "'r' AS repo_source", "'f' AS file_path", "CAST(1 + id % 20 AS int) AS start_line", "CAST(12 + id % 20 AS int) AS end_line")
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    want = plain(chunks, requests)
    assert rows(source_window.blocks_of_all(chunks, requests), "request_id", "id", "start_line") == rows(want, "request_id", "id", "start_line")
    listed = source_window.listing(chunks, requests)
    kept = [(r.request_id, r.start_line, r.end_line, r.kind) for r in listed.collect()]
    gaps = rows(source_window.gaps(want, requests).selectExpr("request_id", "start_line", "end_line", "'gap' AS kind"), "request_id", "start_line", "end_line", "kind")
    assert sorted(kept) == sorted([*((*r, "block") for r in rows(want, "request_id", "start_line", "end_line")), *gaps]) 
    for k in range(100):
        assert (mine := [r[1:3] for r in kept if r[0] == k]) == sorted(mine)
    assert source_window.covered(chunks).count() == 3
    packed = source_window._all_met(chunks.groupBy(*source_window._SPAN).count(), requests)
    assert packed.groupBy("request_id").count().agg(F.max("count")).first()[0] <= 3  # of up to 400 pairs
    every, plainly = made(spark)[0], plain(*made(spark))
    assert sorted(source_window.blocks_of_all(*made(spark)).columns) == sorted(plainly.columns)
    assert rows(source_window.blocks_of_all(every, made(spark)[1]).filter("request_id <> 900 and id <> 9002"), "request_id", "id") == rows(plainly.filter("request_id <> 900 and id <> 9002"), "request_id", "id")


def test_requests_for_one_range_cross_the_join_as_one_row_and_its_tasks_stay_many(spark, monkeypatch):
    monkeypatch.setattr(source_window, "TILE", 64)
    met, plainly_met = [], source_window._met
    monkeypatch.setattr(source_window, "_met", lambda *a: met.append(plainly_met(*a)) or met[-1])
    span = "CAST(1 + id % 3 * 10 AS int) AS start_line", "CAST(4 + id % 3 * 10 AS int) AS end_line"
    chunks = spark.range(60).selectExpr("id", "IF(id < 0, 's', 'r') AS repo_source", "IF(id < 0, 'g', 'f') AS file_path", *span)
    asked = "IF(id < 0, 's', 'r') AS repo_source", "IF(id < 0, 'g', 'f') AS file_path", "CAST(1 + id % 2 AS int) AS start_line", "CAST(12 + id % 2 AS int) AS end_line"
    requests = spark.range(640).selectExpr("IF(id < 600, id, 7) AS request_id", *asked).union(spark.range(4).selectExpr("CAST(NULL AS long) AS request_id", *asked))
    rows = lambda df: sorted(map(tuple, df.selectExpr("coalesce(request_id, -1)", "id", "start_line", "end_line", "from_line", "to_line").collect()))
    found = source_window.blocks_of_all(chunks, requests)
    assert rows(found) == rows(plain(chunks, requests)) and found.count() == 644 * 40
    assert met[0].count() < 200  # of 644 x 2 pairs of requests and spans
    assert len({r.task for r in found.withColumn("task", F.spark_partition_id()).select("id", "request_id", "task").collect()}) > 4


def test_a_listing_is_made_once_for_a_range(spark, monkeypatch):
    met, plainly_met = [], source_window._met
    monkeypatch.setattr(source_window, "_met", lambda *a: met.append(plainly_met(*a)) or met[-1])
    monkeypatch.setattr(source_window, "LISTED", 16, raising=False)
    place = "IF(id < 0, 's', 'r') AS repo_source", "IF(id < 0, 'g', 'f') AS file_path"
    chunks = spark.range(120).selectExpr("id", *place, "CAST(1 + id % 3 * 10 AS int) AS start_line", "CAST(4 + id % 3 * 10 AS int) AS end_line")
    requests = spark.range(200).selectExpr("IF(id = 198, 0, id) AS request_id", *place, "CAST(1 + id % 2 AS int) AS start_line", "CAST(32 + id % 2 AS int) AS end_line")
    kept = [tuple(r) for r in source_window.listing(chunks, requests).collect()]
    want = plain(chunks, requests)
    gaps = source_window.gaps(want, requests).selectExpr("request_id", "start_line", "end_line", "'gap' AS kind")
    assert sorted(kept) == sorted(map(tuple, want.selectExpr("request_id", "start_line", "end_line", "'block' AS kind").union(gaps).collect()))
    for k in range(1, 198):
        assert (mine := [r[1:3] for r in kept if r[0] == k]) == sorted(mine)
    assert sum(1 for a, b in zip(kept, kept[1:]) if a[0] != b[0]) == 198  # a request's rows lie together
    assert sum(df.count() for df in met) <= 12  # of 200 x 6 pairs of requests and lines
