import hashlib
import os
from collections import defaultdict

import pytest

import corpus_pipeline
from quillspark.llm import decontam, mixing, quality, simhash
from quillspark.llm.queries import QUERIES, WEIGHTS

from .helpers import odd_docs, words
from .test_mixing_sharding import plain_segments
from .test_similar import brute
from .test_text_operators import base_figures, plain_hits, repeated_share

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id for r in quality.repetition_quality(docs).collect() if r.kept}
    assert verdict and all(len(words(rows[i].text)) >= 20 for i in verdict)
    kept = docs.filter(docs.doc_id.isin(list(verdict)))
    single = {r.doc_id for r in simhash.similar_components(kept).collect() if r.doc_id == r.component_id}
    kept = kept.filter(kept.doc_id.isin(list(single)))
    found = decontam.verdicts(decontam.find_contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect()
    clean = [r.doc_id for r in found if not r.contaminated]
    order = [r.doc_id for r in mixing.schedule(kept.filter(kept.doc_id.isin(clean)), WEIGHTS).orderBy("position").select("row.doc_id").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order
    assert {r.shard for r in got} <= set(range(8)) and len(got) == len(clean)


def plain_order(rows, weights, block):
    """Ids in mixed order: every block's release and deadline, then earliest deadline first, slot by slot."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source if r.source is not None else "(null)"].append(r.doc_id)
    cut = {}
    for s, ids in by_source.items():
        ids.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        cut[s] = [ids[k : k + block] for k in range(0, len(ids), block)]
    names = sorted(cut, key=lambda s: (-weights.get(s, 1), -len(cut[s]), s))
    share, begin, done, jobs = [weights.get(s, 1) for s in names], 0, dict.fromkeys(names, 0), []
    for repeats, given in plain_segments([len(cut[s]) for s in names], share):
        length = sum(given)
        for _ in range(repeats):
            for w in set(share):
                members = [(s, g) for s, g, x in zip(names, given, share) if x == w and g]
                for m, (s, g) in enumerate(members):  # members of a class take turns
                    for i in range(g):
                        x, of = i * len(members) + m, g * len(members)
                        jobs.append((begin + -(-(x + 1) * length // of), -w, begin, x, begin + x * length // of, s, done[s] + i))
            for s, g in zip(names, given):
                done[s] += g
            begin += length
    out = []
    for slot in range(len(jobs)):
        job = min(j for j in jobs if j[4] <= slot)
        assert slot < job[0]
        jobs.remove(job)
        out += cut[job[5]][job[6]]
    return out


def plain_shards(sizes, shards):
    """Shard of each of the sizes in order, at the smallest capacity that greedy filling needs."""

    def fill(capacity):
        out, at, k = [], 0, 0
        for n in sizes:
            if at + n > capacity:
                at, k = 0, k + 1
            at += n
            out.append(k)
        return out

    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle)[-1] < shards else (middle, high)
    return fill(high)


def test_against_plain_stages(spark):
    """The whole pipeline against versions that share no code with it."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def clean(text):
        seen, repeated = set(), 0
        for line in (text or "").split("\n"):
            repeated += sum(map(len, words(line))) if line in seen else 0
            seen.add(line)
        chars = max(1, sum(map(len, words(text))))
        return not base_figures(text)[5] and repeated <= 0.30 * chars and all(repeated_share(text, n) <= limit for n, limit in quality.NGRAM_LIMITS.items())

    kept = [r for r in rows.values() if clean(r.text)]
    head = brute([(r.doc_id, r.text) for r in kept])
    single = [r for r in kept if head[r.doc_id] == r.doc_id]
    free = []
    for r in single:
        n, hit, _ = plain_hits(r.text, items)
        if not (hit and 20 * hit >= n):
            free.append(r)
    assert len(rows) > len(kept) > len(single) > len(free) > 50
    order = plain_order(free, WEIGHTS, mixing.BLOCK_ROWS)
    want = list(zip(order, plain_shards([len(rows[i].text.encode()) + 1 for i in order], corpus_pipeline.SHARDS)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert [(r.doc_id, r.shard) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want
    assert all(r.size == len(rows[r.doc_id].text.encode()) + 1 for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, None, None, None, None), (4, "", None, None, None), (None, long + " more", None, None, None), (5, long.replace("word", "term"), "de", None, 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "sharding":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                path = str(tmp_path / f"{len(data)}-{name}")
                docs.write.parquet(path)
                docs = spark.read.parquet(path)
        assert sorted(r.doc_id or 0 for r in docs.collect()) == ([1, 5] if data else [])


def test_all_queries_are_there():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 13))


def test_columns_with_backticks(spark):
    docs = odd_docs(spark).withColumnRenamed("fp", "a`b.c")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.mix_sources):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() >= 0
