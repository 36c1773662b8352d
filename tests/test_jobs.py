"""The jobs on growing and odd input, after failures, and against their SQL."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

from jobs import common, preflight_audit, queries, refresh_index

from .test_queries import SF, rows

DOCS = "doc_id long, text string, source string, lang string, file_path string"


def add(spark, path, data):
    spark.createDataFrame([(*r, "clash") for r in data], DOCS).coalesce(1).write.mode("append").parquet(path)


def texts(*numbers):
    return [(k, "\n".join(f"line {j} of {k} " + "x" * (k % 50) for j in range(k % 120 + 1)), f"s{k % 3}", "en") for k in numbers]


def state(spark, out):
    found = refresh_index.current(spark, out).select("source", "file_path", "part_index", "start_line", "end_line", "content_hash", "content", "vector")
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in found.collect())


@pytest.fixture
def places(tmp_path):
    return tuple(str(tmp_path / x) for x in ("documents", "out", "checkpoint"))


def test_second_run_takes_only_what_is_new(spark, places):
    docs, out, mark = places
    add(spark, docs, texts(*range(1, 200)))
    first = refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})
    assert (first["rows"], first["files"], first["batches"]) == (199, 199, 1) and first["chunks"] == first["embedded"] > 400
    before = state(spark, out)
    assert refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})["batches"] == 0
    assert state(spark, out) == before
    add(spark, docs, texts(*range(200, 230)))
    second = refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})
    assert (second["rows"], second["files"]) == (30, 30)
    assert set(before) < set(state(spark, out))
    whole = [p + "-whole" for p in places]
    add(spark, whole[0], texts(*range(1, 230)))
    refresh_index.refresh(spark, *whole, {"chunk_tokens": 64})
    assert state(spark, out) == state(spark, whole[1])


def test_a_new_version_replaces_and_keeps_vectors_of_unchanged_chunks(spark, places):
    docs, out, mark = places
    (_, text, source, lang), other = texts(119)[0], texts(1)[0]
    add(spark, docs, [(119, text, source, lang), other])
    refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})
    before = {r[5]: r for r in state(spark, out)}
    add(spark, docs, [(119, text + " changed", source, lang)])
    counts = refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})
    after = {r[5]: r for r in state(spark, out)}
    assert counts["chunks"] == len(before) - 1 and counts["embedded"] == 1
    assert len(after) == len(before) and len(set(after) - set(before)) == 1
    assert all(after[h] == before[h] for h in set(after) & set(before))
    add(spark, docs, [(119, None, source, lang)])
    assert refresh_index.refresh(spark, docs, out, mark, {"chunk_tokens": 64})["files"] == 1
    assert {r[1] for r in state(spark, out)} == {"s1/1.md"}


@pytest.mark.parametrize("table", ["chunks", "vectors", "files"])
def test_a_batch_that_breaks_off_is_done_again(spark, places, monkeypatch, table):
    docs, out, mark = places
    add(spark, docs, texts(*range(1, 40)))
    refresh_index.refresh(spark, docs, out, mark)
    before = state(spark, out)
    add(spark, docs, texts(*range(30, 60)))

    def broken(rows, path, name, *rest, **more):
        counts = common.written(rows, path, name, *rest, **more)
        if name == table:
            raise OSError("lost")
        return counts

    if table == "files":  # before it is written: readers still see the old index
        monkeypatch.setattr(refresh_index, "written", lambda rows, path, name, *rest, **more: 1 / 0 if name == "files" else common.written(rows, path, name, *rest, **more))
    else:
        monkeypatch.setattr(refresh_index, "written", broken)
    with pytest.raises(Exception):
        refresh_index.refresh(spark, docs, out, mark)
    assert state(spark, out) == before
    monkeypatch.setattr(refresh_index, "written", common.written)
    refresh_index.refresh(spark, docs, out, mark)
    whole = [p + "-whole" for p in places]
    add(spark, whole[0], texts(*range(1, 60)))
    refresh_index.refresh(spark, *whole)
    assert state(spark, out) == state(spark, whole[1])


def test_several_batches_and_odd_rows(spark, places):
    docs, out, mark = places
    for part in ([(1, None, None, None), (2, "", "", None), (3, " \n\t", "s", "en")], [(4, "a\nb", "s/x=y", "en")] * 3, [(None, "no id", "s", "en"), (5, "x" * 100_000, "s", "en"), (5, "short", "s", "en")], texts(7)):
        add(spark, docs, part)
    counts = refresh_index.refresh(spark, docs, out, mark, {"max_files_per_batch": 1})
    assert (counts["batches"], counts["rejected"], counts["rows"]) == (4, 1, 10)
    files = spark.read.parquet(f"{out}/files")
    assert {r["file_path"]: r["outcome"] for r in files.collect()} == {"(none)/1.md": "no-text", "(none)/2.md": "no-text", "s/3.md": "no-text", "s/x=y/4.md": "chunked", "s/5.md": "chunked", "s1/7.md": "chunked"}
    assert len({r[6] for r in state(spark, out) if r[1] == "s/5.md"}) == 1
    empty = [p + "-empty" for p in places]
    add(spark, empty[0], [])
    refresh_index.refresh(spark, *empty)
    assert state(spark, empty[1]) == []


def test_larger_order_value_wins_within_a_batch(spark, places):
    docs, out, mark = places
    spark.createDataFrame([(1, "old", "s", 1), (1, "new", "s", 2), (1, "older", "s", None)], "doc_id long, text string, source string, v int").coalesce(1).write.parquet(docs)
    refresh_index.refresh(spark, docs, out, mark, {"order_column": "v"})
    assert [r[6] for r in state(spark, out)] == ["new"]


def audited(spark, out, name, snapshot="a"):
    return spark.read.schema(getattr(preflight_audit, name.upper())).parquet(f"{out}/{name}/snapshot={snapshot}")


def test_audit_findings_and_reruns(spark, places):
    docs, out, _ = places
    long = "w " * 20_000
    add(spark, docs, [(1, None, None, None), (2, " ", "s", "en"), (3, long, "s", "en"), (4, "y" * 1_100_000, "t", "en"), (5, "a\x00b", "t", "en"), (None, "no id", "s", "en")] + [(k, "same\ntext", f"s{k % 2}", "en") for k in (9, 10, 100)])
    counts = preflight_audit.audit(spark, docs, out, "a")
    assert counts["profile"] == 9
    found = sorted((r["id"], r["kind"], r["amount"], r["related"]) for r in audited(spark, out, "findings").collect())
    assert found == [("1", "empty", 0, None), ("10", "copy", 3, "9"), ("100", "copy", 3, "9"), ("2", "empty", 1, None), ("3", "long-line", 10_000, None), ("3", "over-budget", 10_000, None),
                     ("4", "long-line", 275_000, None), ("4", "over-budget", 275_000, None), ("4", "too-large", 1_100_000, None), ("5", "binary-content", 3, None)]
    sums = {(r["source"], r["language"]): r for r in audited(spark, out, "summary").collect()}
    assert sums[("s0", "en")]["copies"] == 2 and sums[("s1", "en")]["tokens_to_embed"] == 3 and sums[("(none)", "(none)")]["documents"] == 1
    assert sums[("t", "en")]["tokens_to_embed"] == 0 and sums[("s", "en")]["cost_microcents"] == 15 * (10_000 + 2)
    before = sorted(map(tuple, audited(spark, out, "summary").collect()))
    preflight_audit.audit(spark, docs, out, "a")
    assert sorted(map(tuple, audited(spark, out, "summary").collect())) == before
    other = docs + "-other"
    add(spark, other, [(1, "only one", "z", "en")])
    preflight_audit.audit(spark, other, out, "a")  # a snapshot is replaced as a whole: no folder of an old source stays
    assert [r["source"] for r in audited(spark, out, "profile").collect()] == ["z"] and audited(spark, out, "findings").count() == 0
    preflight_audit.audit(spark, docs, out, "b")
    assert audited(spark, out, "profile", "a").count() == 1 and audited(spark, out, "profile", "b").count() == 9


def test_crowded_copies_are_found_without_a_crowded_key(spark):
    made = spark.range(0, 6000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 3 = 0 THEN 'crowd' WHEN id % 100 = 1 THEN 'pair' || id % 2000 ELSE 'd' || id END AS digest")
    got = {r["id"]: (r["first"], r["copies"]) for r in preflight_audit.with_first_copy(made, 0.001).collect()}
    assert len(got) == 6000 and got["5997"] == ("0", 2000) and got["0"] == ("0", 2000)
    assert got["4001"][0] == "1" and got["2"] == ("2", 1)


def test_settings_are_read_and_checked(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"chunk_tokens": 9}')
    assert common.settings(spark, str(path), refresh_index.DEFAULTS)["chunk_tokens"] == 9
    path.write_text('{"chunk_token": 9}')
    with pytest.raises(ValueError):
        common.settings(spark, str(path), refresh_index.DEFAULTS)
    root = os.path.dirname(os.path.dirname(__file__))
    for job in (refresh_index, preflight_audit):
        common.settings(spark, f"{root}/jobs/{job.__name__.split('.')[-1]}.json", job.DEFAULTS)


def test_command_lines(spark, places):
    """Each in a program of its own, the second time over a table that has grown."""
    docs, out, mark = places
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def call(job, *arguments):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", docs, "--config", f"{root}/jobs/{job}.json", *arguments], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stderr

    add(spark, docs, texts(1, 2))
    assert "'files': 2" in call("refresh_index", "--out", out, "--checkpoint", mark)
    add(spark, docs, texts(3))
    assert "'files': 1" in call("refresh_index", "--out", out, "--checkpoint", mark)
    assert {r[1] for r in state(spark, out)} == {"s1/1.md", "s2/2.md", "s0/3.md"}
    assert "'profile': 3" in call("preflight_audit", "--out", f"{out}-audit", "--snapshot", "x")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
    assert kept == {k: spark.conf.get(k) for k in kept}


def test_jobs_stand_alone():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "jobs")
    for f in os.listdir(root):
        if f.endswith(".py"):
            assert not re.search(r"llm|corpus_pipeline", open(os.path.join(root, f)).read()), f
