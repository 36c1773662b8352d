"""The bucketed cache: one row a hash, the last wins, no shuffle of the cache, compaction."""

import os

from pyspark.sql import functions as F

from quillspark.operators import index, vector_cache


def rows(spark, hashes, model, value):
    return spark.createDataFrame([(h, model, [float(value)]) for h in hashes], vector_cache.COLUMNS)


def state(spark, path):
    return {r["content_hash"]: (r["model"], r["vector"][0]) for r in vector_cache.read(spark, path).collect()}


def test_last_model_wins_and_there_is_one_row_a_hash(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert state(spark, path) == {}
    vector_cache.append(rows(spark, "abc", "m", 1), path)
    vector_cache.append(rows(spark, "bcd", "n", 2), path)
    assert state(spark, path) == {"a": ("m", 1.0), "b": ("n", 2.0), "c": ("n", 2.0), "d": ("n", 2.0)}
    assert vector_cache.read(spark, path).count() == 4
    found = index.with_cache(spark.createDataFrame([("a",), ("b",), ("z",)], "content_hash string"), vector_cache.read(spark, path), "n")
    assert {r["content_hash"]: r["vector"] for r in found.collect()} == {"a": None, "b": [2.0], "z": None}


def test_looking_up_shuffles_no_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    vector_cache.append(rows(spark, [f"h{k}" for k in range(200)], "m", 1), path)
    vector_cache.append(rows(spark, [f"h{k}" for k in range(100, 300)], "m", 2), path)
    asked = spark.range(500).select(F.concat(F.lit("h"), "id").alias("content_hash"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = index.with_cache(asked, vector_cache.read(spark, path), "m")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 == plan.count("Exchange") and "SelectedBucketsCount: 8 out of 8" in plan
        assert found.filter("vector is not null").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_compaction_keeps_the_last_rows_in_fewer_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    monkeypatch.setattr(vector_cache, "MAX_FILES", 2)
    monkeypatch.setattr(vector_cache, "BUCKET_ROWS", 10)
    for k in range(3):
        vector_cache.append(rows(spark, [f"h{j}" for j in range(k * 50, k * 50 + 150)], f"m{k}", k), path)
    assert [d for d in os.listdir(path) if not d.startswith(".")] == ["g1-32"]
    files = [f for f in os.listdir(f"{path}/g1-32") if f.startswith("part-")]
    assert len(files) <= 32
    assert state(spark, path) == {f"h{j}": (f"m{min(2, j // 50)}", float(min(2, j // 50))) for j in range(250)}
    os.makedirs(f"{path}/g2-32")  # a rewrite that broke off has no mark
    assert len(state(spark, path)) == 250
    vector_cache.append(rows(spark, ["h0"], "late", 9), path)
    vector_cache.compact(spark, path)
    assert state(spark, path)["h0"] == ("late", 9.0)


def test_path_with_a_quote_and_nulls(spark, tmp_path):
    path = str(tmp_path / "it's a cache")
    vector_cache.append(spark.createDataFrame([(None, "m", [1.0]), ("a", None, None)], vector_cache.COLUMNS), path)
    assert vector_cache.read(spark, path).count() == 2
