import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.workspace import Workspace

from .helpers import LOWER, components, odd_docs, words


def plain(text, n):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_hash_is_the_one_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("abc déf")).alias("h")).first()
    assert row.h == signed(xxhash.xxh64_intdigest("abc déf".encode(), 42))


@pytest.mark.parametrize("crowd", [1, 24])
def test_components_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(crowd)
    base = [[rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 60))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rnd.randrange(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(["Zz", "q"])
            texts.append(" ".join(w))
    texts += [None, "", "  \t"]
    ids = rnd.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), shingle=3).collect()}
    prints = {i: plain(t, 3) for i, t in zip(ids, texts)}
    want = components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_dense_cluster_of_fingerprints(spark, tmp_path):
    rnd = random.Random(3)
    found = {rnd.getrandbits(64)}
    while len(found) < 500:
        x = rnd.choice(sorted(found))
        for _ in range(rnd.choice([1, 2, 3])):
            x ^= 1 << rnd.randrange(64)
        found.add(x)
    nodes = [signed(f) for f in found]
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = {r.node: r.root for r in simhash.connected_components(simhash._links(df, 2), Workspace(spark, "t")).collect()}
    want = components(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in nodes} == want


def test_odd_inputs(spark):
    got = simhash.simhash_components(odd_docs(spark), shingle=3).collect()
    assert len(got) == odd_docs(spark).count()
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert {0, 1, 2, None} <= zero and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert simhash.simhash_components(odd_docs(spark).limit(0)).collect() == []


def test_similar_documents_are_found_and_others_left_alone(spark):
    rnd, rows, n = random.Random(7), [], 0
    vocabulary = [f"w{k}" for k in range(3000)]
    groups = {}
    for g in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 400))]
        for copy in range(rnd.choice([1, 2, 3])):
            w = list(base)
            for _ in range(len(w) // 60 if copy else 0):  # each change touches 5 shingles: similarity about 0.85
                w[rnd.randrange(len(w))] = "changed"
            rows.append((n, " ".join(w)))
            groups[n] = g
            n += 1
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
    assert all(groups[c] == groups[i] for i, c in got.items())
    copies = [i for i, g in groups.items() if first[g] != i]
    assert sum(got[i] == first[groups[i]] for i in copies) >= 0.95 * len(copies)


def test_wide_fingerprint_begins_with_no_bias():
    assert not simhash.wide_fingerprint(b"  ", 5).any() and len(set(simhash.wide_fingerprint(b"a b c d e f", 5).tolist())) == 8


def test_similar_of_odd_inputs(spark):
    got = simhash.similar_components(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert simhash.similar_components(odd_docs(spark).limit(0)).collect() == []


def test_drop_keeps_one_of_each_group(spark):
    docs = odd_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7] and ids.count(None) == 1  # the null text is like the empty one
    same = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (2, "p q r", "z"), (2, "u v w", "z"), (2, "a B c", "z"), (None, "u v w", "z"), (None, "n", "z"), (None, "n", "z")], "doc_id long, text string, source string")
    assert sorted(simhash.drop_near_duplicates(same).collect(), key=str) == sorted([(1, "a b c", "x"), (2, "p q r", "z"), (2, "u v w", "z"), (None, "n", "z")], key=str)
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_drop_takes_columns_of_any_name_and_type(spark):
    docs = spark.sql("select k % 3 as doc_id, 'one two three' as text, map(k, 'v') as `a.b`, k as t0, k as row from range(4) as r(k)")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == 1 and kept[0].doc_id == 0 and kept[0]["a.b"] == {0: "v"} and simhash.drop_near_duplicates(docs).columns == docs.columns
