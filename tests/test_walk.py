"""The repository source: who lists, what filters leave out, what a stream reads again."""

import os
import time

import pytest

from quillspark.sources import walk


def put(root, path, text):
    where = os.path.join(root, path)
    os.makedirs(os.path.dirname(where), exist_ok=True)
    with open(where, "w") as f:
        f.write(text)


@pytest.fixture
def repo(tmp_path):
    root = str(tmp_path / "repo")
    for k in range(12):
        put(root, f"src/m{k}/deep/f{k}.ts", f"const a = {k};")
        put(root, f"docs/m{k}/g{k}.md", f"# {k}")
    put(root, "top.py", "x = 1")
    put(root, "src/package-lock.json", "{}")
    put(root, "node_modules/x/y.ts", "never")
    os.symlink(f"{root}/top.py", f"{root}/src/link.py")
    return root


def rows(df):
    return sorted((r["file_path"], r["skip_reason"], r["source"]) for r in df.collect())


def read(spark, root, **options):
    spark.dataSource.register(walk.RepoWalk)
    return spark.read.format("repo_walk").options(**options).load(root)


@pytest.mark.parametrize("folders", [1, 2, 5, 1000])
def test_same_rows_whoever_lists(spark, repo, folders):
    got = rows(read(spark, repo, foldersListed=str(folders)))
    assert got == rows(walk.walk(spark, repo)) and len(got) == 28
    assert {p: r for p, r, _ in got if r} == {"src/package-lock.json": "lockfile", "node_modules": "ignored-dir", "src/link.py": "symlink"}


def test_driver_lists_only_until_there_are_enough_folders(repo):
    parts = walk._Reader(repo, 128, 2).partitions()
    assert [f for p in parts for f, _ in p.folders] == ["docs/", "src/"]
    assert sum(len(p.rows) for p in parts) == 2  # top.py and node_modules


def test_filters_reach_the_source(spark, repo, monkeypatch):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition, want in (("extension = '.md'", 12), ("extension IN ('.py', '.md') AND file_path LIKE 'docs/m1%'", 3), ("file_path = 'src/m3/deep/f3.ts'", 1), ("extension = '.md' AND size > 100", 0), ("extension = '.ts' AND extension = '.md'", 0)):
            df = read(spark, repo, foldersListed="3", pushFilters="true").filter(condition)
            assert df.count() == want, condition
        plan = walk.walk(spark, repo).filter("extension = '.md'")._jdf.queryExecution().executedPlan().toString()
        assert "isnotnull(extension" in plan and ".md" not in plan  # the source decides it, so Spark does not filter again
        open_plan = read(spark, repo).filter("extension = '.md'")._jdf.queryExecution().executedPlan().toString()
        assert ".md" in open_plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    wanted = walk.Wanted()
    assert wanted.take(walk.StringStartsWith(("file_path",), "docs/m1")) and not wanted.take(walk.EqualTo(("size",), 3))
    assert wanted.folder("docs/") and wanted.folder("docs/m1/") and wanted.folder("docs/m11/") and not wanted.folder("src/") and not wanted.folder("docs/m2/")


def test_a_stream_reads_changed_files_only(spark, repo, tmp_path):
    spark.dataSource.register(walk.RepoWalk)
    out, mark = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        spark.readStream.format("repo_walk").load(repo).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination()
        return sorted(r["source"] or "" for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 28
    time.sleep(0.05)
    put(repo, "src/m3/deep/f3.ts", "changed")
    put(repo, "new/file.md", "new")
    second = run()
    assert len(second) == len(first) + 2 and {"changed", "new"} <= set(second)
    assert run() == second
