"""Periodic runs against a plain version; toxicity on invented texts with known words."""

import hashlib
import random
import zlib

import pytest

from quillspark.llm import runs, toxicity

from .helpers import DOCS, odd_docs, words


def plain_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def invented(seed, n):
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        letters, size = draw.choice(["ab", "abc", "a", "abcdefgh"]), draw.randint(0, 70)
        w = [draw.choice(letters) for _ in range(size)]
        for _ in range(draw.randint(0, 3) if size else 0):
            a, p = draw.randrange(size), draw.randint(1, 9)
            for i in range(a + p, min(size, a + p * draw.randint(2, 9))):
                w[i] = w[i - p]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("min_length,exponent", [(6, 4), (4, 2), (2, 2), (9, 3)])
def test_runs_as_plain(spark, min_length, exponent):
    texts = invented(min_length, 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs, min_length=min_length, exponent=exponent).collect()}
    for k, t in enumerate(texts):
        want = plain_runs(t.split(), min_length, exponent)
        assert [tuple(r) for r in got[k]["runs"]] == want, t
        assert got[k]["collapsed"] == plain_collapse(t.split(), want)


def test_overlap_is_the_least_over_all_periods():
    assert runs.overlap(6, 4) == 5
    for m in range(2, 30):
        for e in range(2, 8):
            assert runs.overlap(m, e) == max(1, min(max(m, e * q) - q for q in range(1, 100)))
    with pytest.raises(ValueError):
        runs.overlap(6, 1)


def test_names_tell_texts_apart_that_rolling_hashes_confuse(spark):
    """Thue-Morse words: their polynomials agree modulo 2**64, so a hash alone would see a run."""
    w = ["a"]
    for _ in range(12):
        w += ["b" if x == "a" else "a" for x in w]
    text = " ".join(w)
    got = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == plain_runs(w) == []
    assert got["collapsed"] == text


def test_long_runs(spark):
    w = [f"w{k}" for k in range(4999)] * 5 + ["z"] * 30_000
    got = runs.periodic_runs(spark.createDataFrame([(1, "\n ".join(w)), (2, " x" * 100_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 5 * 4999, 4999), (5 * 4999, 30_000, 1)]
    assert got[0]["collapsed"] == " ".join(w[:4999] + ["z"])
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 100_000, 1)]


def planted(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_digests_as_plain(spark):
    texts = invented(3, 400) + [" \t\n", None, "é漢 😀\x0bx", "one\x1ftwo " * 9]
    docs = spark.createDataFrame([(k * 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.digests(runs.periodic_runs(runs.with_periodic_tails(docs))).collect()}
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in got) > 20
    for k, t in enumerate(texts):
        w = planted(k * 7, t)
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = got[k * 7]
        assert row["n_runs"] == len(found) and (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(w, found).encode()).hexdigest()


def test_runs_of_odd_inputs(spark):
    docs = odd_docs(spark)
    got = runs.digests(runs.periodic_runs(runs.with_periodic_tails(docs))).collect()
    assert len(got) == docs.count()
    assert {r["n_runs"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert runs.digests(runs.periodic_runs(runs.with_periodic_tails(spark.createDataFrame([], DOCS)))).collect() == []
    assert len({tuple(r) for r in got if r["doc_id"] == 8}) == 1


INSULTS = ["grobnak", "vilzurt", "smudwick", "plorgish"]


def labelled(seed, n):
    """(id, text, toxic): clean words, and in every fourth text one insult or more."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        w = ["".join(draw.choice(["ta", "re", "mi", "so", "nel", "dan"]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(5, 200))]
        if k % 4 == 0:
            for _ in range(1 + len(w) // 40):
                w[draw.randrange(len(w))] = draw.choice(INSULTS)
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    return rows


def tables(spark, rows, more=()):
    return spark.createDataFrame([(k, t) for k, t, _ in rows] + list(more), "doc_id long, text string"), spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    rows = labelled(1, 1600)
    odd = [(10_000 + k, f"ta remi so {w[:3]}{w[4:]} nel") for k, w in enumerate(INSULTS)]
    docs, labels = tables(spark, rows, odd)
    got = {r["doc_id"]: r for r in toxicity.rate(docs, labels).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [(y, got[k]["predicted"]) for k, _, y in rows if got[k]["held_out"]]
    assert sum(y == p for y, p in held) >= 0.97 * len(held)
    assert sum(got[k]["predicted"] for k, _ in odd) >= 3  # words no training text has
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_score_is_the_softmax_of_averaged_vectors():
    """Folding the softmax into the vectors changes nothing: against a plain loop over words and n-grams."""
    import numpy as np
    import pyarrow as pa

    from quillspark.llm.bytetext import mix

    weight = np.random.default_rng(5).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = ["", None, "Ab, c! déjà-vu 42", "x" * 300, "the the the cat"]
    got = toxicity.Model(0.25, weight).score(pa.array(texts))
    for text, score in zip(texts, got):
        low, of_words = (text or "").lower().encode(), []
        import re

        for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
            w = b" " + w + b" "
            keys = [int.from_bytes(w[i : i + n], "little") ^ n << 56 for n in toxicity.ORDERS for i in range(len(w) - n + 1)]
            of_words.append(np.mean([weight[int(mix(np.array([k], np.uint64))[0]) % toxicity.BUCKETS] for k in keys], dtype=np.float64))
        logit = 0.25 + toxicity.GAIN * sum(of_words) / max(len(of_words), toxicity.LEAST_WORDS)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_only_the_training_fold_teaches(spark):
    rows = labelled(2, 400)
    docs, labels = tables(spark, rows)
    flipped = tables(spark, [(k, t, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, t, y in rows])[1]
    a, b = (sorted(tuple(r) for r in toxicity.rate(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_of_odd_inputs(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, None), (None, 1), (5, 0), (8, 0), (8, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.rate(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = {round(r["score"], 9) for r in got if r["doc_id"] in (0, 1, 2)}
    assert len(empty) == 1  # the bias alone
    assert toxicity.rate(spark.createDataFrame([], DOCS), labels).collect() == []
    none = toxicity.rate(docs, labels.filter("toxic = 7")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert {r["score"] for r in toxicity.rate(docs, labels.filter("doc_id = 3")).collect()} == {1.0}


def test_one_id_with_many_rows_keeps_the_sample_small(spark):
    rows = labelled(4, 300)
    docs, labels = tables(spark, rows, [(4, f"ta re mi so nel {k} grobnak") for k in range(3000)])
    got = toxicity.rate(docs, labels, sample=100).collect()
    assert len(got) == 3300
