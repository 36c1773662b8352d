import random

import pytest

from quillspark.llm import linededup
from quillspark.workspace import Workspace

from .helpers import components, odd_docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n, letters):
    t = list(text)
    for _ in range(n):
        kind, i = rnd.randrange(3), rnd.randrange(len(t))
        if kind == 0:
            t.insert(i, rnd.choice(letters))
        elif kind == 1:
            t[i] = rnd.choice(letters)
        elif len(t) > 3:
            del t[i]
    return "".join(t)


def test_banded_distance(spark):
    rnd, rows = random.Random(5), []
    for _ in range(1200):
        a = "".join(rnd.choice("abcé😀") for _ in range(rnd.randrange(4, 40)))
        b = edited(rnd, a, rnd.randrange(0, 5), "abcx")
        a, b = max(a, b, key=len), min(a, b, key=len)
        if len(a) - len(b) <= 2:
            rows.append((a, b))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.banded_distance("a", "b").alias("d")).collect():
        want = distance(r.a, r.b)
        assert r.d == want if want <= 2 else r.d > 2, r


@pytest.mark.parametrize("crowd", [6, 4096])
def test_classes_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefg hijk") for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    base += [f"page {rnd.randrange(10**n)} of {rnd.randrange(10**m)} ready" for n, m in ((3, 2), (4, 3), (6, 6), (9, 4), (1, 1)) for _ in range(12)]
    lines = base + [edited(rnd, b, rnd.randrange(0, 4), "zy") for b in base for _ in range(5)]
    crowd = base[0] * 3
    for _ in range(50):
        at = rnd.randrange(len(crowd) - 6)
        lines.append(crowd[:at] + rnd.choice(["q", "qz", "xyzuv"]) + crowd[at + rnd.randrange(0, 5) :])
    rnd.shuffle(lines)
    lines += [" ", "", "x", "x", lines[0]]
    docs = [(i, "\n".join(lines[7 * i : 7 * i + 7])) for i in range(len(lines) // 7 + 1)] + [(1000, None), (None, lines[3])]
    got = {(r.doc_id, r.line_no): r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    places = [(d, k, x) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    distinct = sorted({x for _, _, x in places})
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, max(len(a), len(b)) // 10)
    root = components(distinct, near)
    degree = {a: sum(near(a, b) for b in distinct if a != b) for a in distinct}
    order = lambda d, k: (d if d is not None else 2**63 - 1, k)
    head = {}
    for d, k, x in places:
        head[root[x]] = min(head.get(root[x], (2**64, 0)), order(d, k))
    assert len(got) == len(places)
    for d, k, x in places:
        h, r = head[root[x]], got[(d, k)]
        assert (r.class_doc_id, r.class_line_no, r.n_links, r.kept) == (None if h[0] == 2**63 - 1 else h[0], h[1], degree[x], order(d, k) == h)


def test_a_hundred_thousand_variants_of_one_line(spark):
    """Lines that share everything but a number meet by their digits, in rows that grow with the lines."""
    numbers = random.Random(1).sample(range(10**8, 10**9), 100_000)
    text = [f"all rights reserved, document {n} of the archive of the town" for n in numbers] + [f"all rights reserved, document {numbers[0]}9 of the archive of the town"]
    lines = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(text)], "id long, line string, len int").repartition(8)
    work = Workspace(spark, "lines")
    assert linededup._all_keyed(lines, work).count() < 160 * len(text)
    found = {(r.u, r.v) for r in linededup.line_links(lines, work).collect()}
    kinds, want = {}, set()
    for k, n in enumerate(str(n) for n in numbers):
        for cut in range(9):
            kinds.setdefault((cut, n[:cut] + n[cut + 1 :]), []).append(k)
    for same in kinds.values():  # one substitution
        want |= {(a, b) for a in same for b in same if a < b}
    assert want <= found and (0, 100_000) in found
    assert all(distance(text[a], text[b]) <= 2 for a, b in random.Random(2).sample(sorted(found), 200))


def test_odd_inputs(spark):
    docs = odd_docs(spark)
    got = linededup.dedup_lines(docs).collect()
    assert {r.doc_id for r in got} == {3, 4, 5, 6, 7, 8, None} and [r.kept for r in got if r.doc_id == 7] == [True] and not any(r.kept for r in got if r.doc_id == 8)
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
