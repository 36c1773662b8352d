import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, row string, slot int"


def docs_of(spark, counts, seed=1):
    rnd, rows, n = random.Random(seed), [], 0
    for source, k in counts.items():
        for _ in range(k):
            rows.append((n, f"text {n} " + "x" * rnd.randrange(50), source, "clash", 7))
            n += 1
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def plain_segments(blocks, weights):
    """(repeats, blocks of each source) from start to end, source by source."""
    ends = {Fraction(n, w) for n, w in zip(blocks, weights) if n}
    cuts = sorted({Fraction(0), *ends, *(Fraction(int(e)) for e in ends), *(Fraction(-int(-e // 1)) for e in ends if -int(-e // 1) <= max(ends))})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        whole = a.denominator == b.denominator == 1
        given = [(w if whole else int(w * b) - int(w * a)) if n and Fraction(n, w) >= b else 0 for n, w in zip(blocks, weights)]
        if sum(given):
            out.append((int(b - a) if whole else 1, given))
    return out


@pytest.mark.parametrize("counts,weights", [
    ({"a": 300, "b": 40, "c": 7}, {"a": 1, "b": 1, "c": 1}),
    ({"a": 100, "b": 210, None: 33, "d": 1}, {"a": 5, "b": 3, "d": 2}),
    ({"only": 37}, {"only": 9}),
    ({"a": 2, "b": 500}, {"a": 7, "b": 2}),
    ({"a": 90, "b": 61, "c": 33, "d": 33, "e": 5, "f": 77}, {"a": 3, "b": 3, "c": 3, "f": 2}),
])
def test_schedule_is_whole_and_less_than_a_block_off(spark, counts, weights):
    b = 4
    rows = mixing.schedule(docs_of(spark, counts), weights, block_rows=b).collect()
    assert sorted(r.position for r in rows) == list(range(sum(counts.values())))
    assert sorted(r.row.doc_id for r in rows) == list(range(sum(counts.values())))
    assert all(r.row.row == "clash" and r.row.slot == 7 for r in rows)
    named = {k if k is not None else "(null)": n for k, n in counts.items()}
    order = sorted(named)
    blocks = [-(-named[s] // b) for s in order]
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(sum(blocks)))
    for s, n in zip(order, blocks):  # blocks of a source in their order
        assert [slots[k][1] for k in sorted(slots) if slots[k][0] == s] == list(range(n))
    at, given = 0, dict.fromkeys(order, 0)
    for repeats, each in plain_segments(blocks, [weights.get(s, 1) for s in order]):
        level = dict(given)
        for step in range(1, repeats * sum(each) + 1):
            given[slots[at][0]] += 1
            at += 1
            for s, g in zip(order, each):
                assert abs(given[s] - level[s] - Fraction(g * step, sum(each))) < 1
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in ordered] == sorted(r.slot for r in rows)


def test_segments_are_those_of_every_source():
    rnd = random.Random(4)
    for _ in range(60):
        weights = [rnd.choice([1, 1, 1, 2, 3, 7]) for _ in range(rnd.randrange(1, 9))]
        blocks = [rnd.randrange(1, 40) for _ in weights]
        shapes = [(w, n, k) for (w, n), k in Counter(zip(weights, blocks)).items()]
        want = plain_segments(blocks, weights)
        got = mixing.segments(shapes)
        assert [r for r, _ in got] == [r for r, _ in want]
        for (_, each), (_, given) in zip(got, want):
            for w in set(weights):
                members = [g for g, x in zip(given, weights) if x == w and g]
                assert each.get(w, (0, 0))[0] == len(members) and set(members) <= {each.get(w, (0, 0))[1]}


@pytest.mark.parametrize("sources", [120, 409, 5000])
def test_any_number_of_sources(spark, sources):
    docs = spark.range(sources * 2 + sources // 2).selectExpr("id as doc_id", f"concat('s', id % {sources}) as source")
    got = mixing.schedule(docs, {"s0": 5, "s1": 3}, block_rows=2).selectExpr("count(*) as n", "count(distinct position) as p", "min(position) as low", "max(position) as high", "count(distinct row.doc_id) as d").first()
    n = docs.count()
    assert tuple(got) == (n, n, 0, n - 1, n)


def test_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(None, f"t{k}", "a") for k in range(300)] + [(k, f"u{k}", "a") for k in range(100)] + [(7, "same", "b")] * 150
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 2}, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows))) and Counter(r.row.text for r in got) == Counter(t for _, t, _ in rows)


def test_mix_keeps_rows_and_writes_them_in_order(spark, tmp_path):
    docs = docs_of(spark, {"a": 60, "b": 30, None: 10})
    mixed = mixing.mix(docs, {"a": 2, "b": 1}, block_rows=2)
    assert mixed.columns == docs.columns
    mixed.write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    want = {r.row.doc_id: r.position for r in mixing.schedule(docs, {"a": 2, "b": 1}, block_rows=2).collect()}
    assert [want[r.doc_id] for r in sorted(back, key=lambda r: (r.f, r.i))] == list(range(100))


def test_mix_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none, {}).collect() == [] and mixing.schedule(none, {}).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None)] * 5 + [(1, "", "a", None, None)] * 3, SCHEMA)
    assert sorted(r.position for r in mixing.schedule(odd, {"a": 3}, block_rows=2).collect()) == list(range(8))


def minimax(sizes, shards):
    low, high = 0, sum(sizes)
    while high - low > 1:
        mid, used, at = (low + high) // 2, 1, 0
        ok = max(sizes) <= mid
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if ok and used <= shards else (mid, high)
    cut, at, k = [], 0, 0
    for s in sizes:
        if at + s > high:
            k, at = k + 1, 0
        at += s
        cut.append(k)
    return cut


def expected(rows, shards):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text, []).append(doc)
    low = -(2**63)
    order = sorted(groups, key=lambda t: min(d if d is not None else low for d in groups[t]) if any(d is not None for d in groups[t]) else low)
    size = {t: (len(t.encode()) if t else 0) + 1 for t in groups}
    return dict(zip(order, minimax([size[t] * len(groups[t]) for t in order], shards))), size, order


@pytest.mark.parametrize("points,exact", [(8192, 40_000), (1, 20), (1, 3)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shards_are_the_minimax_partition(spark, monkeypatch, points, exact, seed):
    monkeypatch.setattr(sharding, "POINTS", points)
    monkeypatch.setattr(sharding, "EXACT", exact)
    rnd = random.Random(seed)
    texts = ["é" * rnd.choice([0, 1, 5, 40, 90]) + str(rnd.randrange(10**9)) for _ in range(150)] + ["copy"] * 60 + ["big" * 400] * (seed - 1)
    rnd.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9999, None), (10001, None), (10000, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where, size, _ = expected(rows, 8)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id]
        assert (r.shard, r.size, r.text_crc32, r.law, r.grown_shard) == (where[t], size[t], zlib.crc32((t or "").encode()), "bytes", None)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_nothing_of_one_row_and_of_repeated_ids(spark):
    schema = "doc_id long, text string, size int, shard string"
    assert sharding.shard(spark.createDataFrame([], schema)).collect() == []
    (one,) = sharding.shard(spark.createDataFrame([(None, None, 1, "x")], schema)).collect()
    assert (one.doc_id, one.size, one.text_crc32, one.shard, one.slot) == (None, 1, 0, 0, 0)
    same = sharding.shard(spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 1, "x"), (1, "a", 1, "x")], schema), 2).collect()
    assert sorted((r.shard, r.slot) for r in same) in ([(0, 0), (0, 1), (1, 0)], [(0, 0), (1, 0), (1, 1)])
