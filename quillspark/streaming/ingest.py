"""Continuous ingest: files that arrive as rows are chunked and replace their repository's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, index


def ingest_stream(files: DataFrame, table: str, cache_path: str, checkpoint: str, **options):
    """``files``: a streaming DataFrame of repo_source, file_path, source.  Each micro-batch holds whole
    repositories; it is idempotent, because a repository is replaced as a whole."""

    def replace(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for (repo,) in batch.select("repo_source").distinct().collect():  # repositories of one micro-batch
            chunks = chunking.explode_chunks(chunking.chunk_files(batch.filter(F.col("repo_source") == repo)))
            index.index_chunks(with_seq(chunks), repo, table, cache_path, **options)
        batch.unpersist()

    return files.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_seq(chunks: DataFrame) -> DataFrame:
    """Number the chunks of a repository in order of path and place (rising, not gapless; no task sees all)."""
    return chunks.orderBy("file_path", "place").withColumn("seq", F.monotonically_increasing_id()).drop("place")
