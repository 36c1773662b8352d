"""The near-duplicate stage against brute force over whole shingle sets."""

import random
from collections import Counter, defaultdict

import pytest

from quillspark.llm import simhash

from .helpers import LOWER, words


def sets(rows, n=5):
    out = {}
    for i, text in rows:
        w = words(text.translate(LOWER))
        out[i] = {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else {""}  # no words are like no words
    return out


def brute(rows):
    """doc_id -> smallest doc_id of its component, by the similarity of every pair with a common shingle."""
    of, holds = sets(rows), defaultdict(list)
    for i, s in of.items():
        for x in s:
            holds[x].append(i)
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in of.items():
        for j, both in Counter(j for x in s for j in holds[x] if j < i).items():
            if 5 * both >= 4 * (len(s) + len(of[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in of}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}


def with_changes(rnd, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def test_every_pair_is_found_under_a_passage_that_thousands_share(spark):
    rnd = random.Random(5)
    passage = " ".join(f"passage{k}" for k in range(60))
    texts = []
    for _ in range(2000):
        own = " ".join(f"w{rnd.randrange(20_000)}" for _ in range(rnd.randrange(40, 120)))
        texts.append(f"{passage} {own}" if rnd.random() < 0.5 else f"{own} {passage}")
    texts += [with_changes(rnd, t, rnd.choice([1, 2, 3, 4])) for t in texts[:400]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(i != c for i, c in want.items()) > 200
    assert found(spark, rows) == want


@pytest.mark.parametrize("pivots", [0, 1, 2])
def test_a_large_group_of_copies_and_chains(spark, monkeypatch, pivots):
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rnd = random.Random(pivots)
    base = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(3, 200))) for _ in range(8)]
    texts = [with_changes(rnd, rnd.choice(base), rnd.randrange(5)) for _ in range(200)]
    chain = base[0]
    for _ in range(60):
        texts.append(chain := with_changes(rnd, chain, 2))
    rows = list(enumerate([*texts, "", " \t", "a", "A b", "a B"]))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("earlier", [0, 4, 64])
def test_pairs_leave_the_last_join_once(spark, monkeypatch, earlier):
    """Members of a group that are all a little under the threshold to one another, and a few that are not."""
    monkeypatch.setattr(simhash, "PIVOTS", 0)
    monkeypatch.setattr(simhash, "EARLIER", earlier)
    rnd = random.Random(9)
    base = " ".join(f"w{k}" for k in range(150))
    rows = list(enumerate(with_changes(rnd, base, rnd.choice([1, 2, 3, 4])) for _ in range(120)))
    assert found(spark, rows) == brute(rows)


def test_documents_below_the_similarity_stay(spark):
    rows = []
    for g in range(40):
        w = [f"g{g}w{k}" for k in range(304)]  # 300 shingles
        v = list(w)
        for k in range(10, 290, 40):  # 7 changes of 5 shingles each: 265 of 335 are common, 0.79
            v[k] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    assert all(i == c for i, c in found(spark, rows).items())
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_fingerprints_link_near_copies_before_any_other_way(spark, monkeypatch):
    """Without the rounds over first shingles, SimHash links alone drop near copies; pairs that are not similar enough stay."""
    whole = simhash._shared_firsts
    monkeypatch.setattr(simhash, "_shared_firsts", lambda nodes, similarity: whole(nodes, similarity).limit(0))
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(5000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "other"])), (2, " ".join([*base, "more"])), (3, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(5000))), (4, ""), (5, "a b"), (6, "c d")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6]
