"""``python -m quillspark.cli --repo <path or GitHub URL>``: ingest a repository and report."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chunking, index
from .sources import config, store, walk
from .streaming.ingest import with_seq
from .workspace import Workspace


def main(argv: list[str], spark: SparkSession | None = None, log: Callable[[str], None] = print, env: dict | None = None, git: Callable = walk.run_git, **options) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--repo")
    parser.add_argument("--refresh", action="store_true")
    parser.add_argument("--out", default="chunks.json")
    args = parser.parse_args(argv)
    if not args.repo:
        log("usage: quillspark --repo <path-or-github-url> [--refresh] [--out chunks.json]")
        return 1
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    work = Workspace(spark, "ingest")
    try:
        repo = walk.acquire(args.repo, refresh=args.refresh, git=git)
        entries = work.table(walk.walk(spark, walk.ship(spark, repo.root, work.path("repository"))), "entries")
        read, failed = entries.filter("skip_reason is null").agg(F.count("source"), F.count("error")).first()
        if failed and not read:
            raise OSError(f"none of {failed} files could be read; nothing is replaced")
        files = work.table(chunking.chunk_files(entries.filter("skip_reason is null")), "files")
        chunks = work.table(with_seq(chunking.explode_chunks(files)), "chunks")
        report = chunking.ingest_report(files, entries.filter("skip_reason is not null"), repo.commit).first()
        store.write_json(chunks, args.out)
        # The labels of the report, as published.
        for name, value in (("Files seen", report.files_seen), ("Chunked", report.files_chunked), ("Degraded", report.files_degraded), ("No declarations", report.no_declarations), ("Failed", report.files_failed), ("Skipped", report.files_skipped), ("Total chunks", report.chunks), ("Commit SHA", report.commit_sha or "(none)")):
            log(f"{name + ':':<16} {value}")
        log(f"Wrote {args.out}")
        settings = config.load(env)
        done = index.index_chunks(chunks, args.repo, f"{settings.table_uri}/chunks", f"{settings.table_uri}/embeddings", settings.embed_model, postings_path=f"{settings.table_uri}/postings", **options)
        for name, value in (("Unique hashes", done.unique_hashes), ("Cache hits", done.cache_hits), ("Embedded", done.embedded), ("Deleted", done.deleted), ("Inserted", done.inserted)):
            log(f"{name + ':':<16} {value}")
        return 0
    except (ValueError, OSError, index.EmbedError) as problem:
        log(f"Ingest failed: {problem}")
        return 1
    finally:
        work.drop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
