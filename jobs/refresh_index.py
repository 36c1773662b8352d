"""Keep a chunk index in step with a growing table of documents: each run takes only files it has not seen.

    python -m jobs.refresh_index --documents PATH --out PATH --checkpoint PATH [--config jobs/refresh_index.json]

``documents`` is a Parquet table that grows by files; a row is one version of a document, and a later file
may bring a new version.  A file stream with a checkpoint (trigger ``availableNow``) hands over what is new.  For each
of its batches the job cuts texts into windows of lines within a token budget, looks up which chunks have a vector, embeds the others, and writes

    out/chunks/batch=N/source=S/    the chunks of the batch
    out/vectors/batch=N/            content_hash, vector: chunks that had none
    out/files/batch=N/source=S/     one row a document of the batch: outcome, chunks

in this order.  A batch that runs twice (after a failure) overwrites its own folders with the same rows and does not
look at what its first run left.  ``current`` reads the index: of each document the newest batch that is
complete, which a row in ``files`` marks; so a reader in the middle of a run sees the old chunks of a document.  A chunk that
is unchanged (same file, place and content) keeps its vector, also when the rest of its document changes.

Null ids are rejected and counted in the log; a null or blank text has the outcome ``no-text`` and no chunks, which
removes the document's older ones; of rows with one id in one batch that with the largest ``order_column`` counts
(ties, or without such a column: the largest digest of the text); a document that changes its source is another
document; repeated rows and other columns do not matter.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import model
from quillspark.functions import text
from quillspark.operators import chunking, index

from .common import log, new_files, partition_value, read, session, settings, written

DEFAULTS = {
    "id_column": "doc_id",
    "text_column": "text",
    "source_column": "source",
    "order_column": None,
    "suffix": ".md",
    "chunk_tokens": model.MAX_CHUNK_TOKENS,
    "vector_size": 64,
    "embed_model": "hashing",
    "embed_tasks": 8,
    "max_files_per_batch": 1000,
}
CHUNKS = "file_path string, start_line int, end_line int, part_index int, part_total int, tokens int, content_hash string, content string, batch long, source string"
FILES = "file_path string, outcome string, n_chunks int, batch long, source string"
VECTORS = "content_hash string, model string, vector array<float>, batch long"


HAS_WORD = r"[^\x20\x09-\x0D]"


def newest(rows: DataFrame, config: dict, *wanted: Column) -> DataFrame:
    """source, file_path and ``wanted`` of one row a document."""
    path = F.concat(partition_value(config["source_column"]), F.lit("/"), F.col(config["id_column"]).cast("string"), F.lit(config["suffix"]))
    order = F.col(config["order_column"]) if config["order_column"] else F.lit(0)
    rank = F.struct(order.alias("at"), F.sha2(F.coalesce(F.col(config["text_column"]), F.lit("")), 256).alias("digest"))
    named = rows.filter(F.col(config["id_column"]).isNotNull()).select(path.alias("file_path"), partition_value(config["source_column"]).alias("source"), rank.alias("rank"), F.struct(*wanted).alias("wanted"))
    return named.groupBy("file_path", "source").agg(F.max_by("wanted", "rank").alias("wanted")).select("file_path", "source", "wanted.*")  # combined before the shuffle


def cut(documents: DataFrame, budget: int) -> DataFrame:
    """Chunks of the documents that have a word, with their hash."""
    windows = chunking.line_windows(documents.filter(F.col("text").rlike(HAS_WORD)).select(F.struct("file_path", "source").alias("of"), "text"), "of", "text", budget)
    rows = windows.select("of.*", "part_index", "part_total", "start_line", "end_line", "content", F.lit("generic").alias("chunker_kind"), F.lit(None).cast("string").alias("symbol_name"))
    return rows.withColumns({"content_hash": text.content_hash(), "tokens": text.estimate_tokens("content")})


def refresh(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Index what is new in ``documents``; returns what was read and written."""
    config = DEFAULTS | (config or {})
    total = {"batches": 0, "rows": 0, "rejected": 0, "files": 0, "chunks": 0, "embedded": 0}
    stream = new_files(spark, documents, config["max_files_per_batch"])

    def one(rows: DataFrame, number: int) -> None:
        session, body, ident = rows.sparkSession, F.col(config["text_column"]), F.col(config["id_column"])
        counted = {"batches": 1} | rows.agg(F.count("*").alias("rows"), F.count(F.when(ident.isNull(), 1)).alias("rejected")).first().asDict()
        made = cut(newest(rows, config, body.alias("text")), config["chunk_tokens"])
        counted["chunks"] = written(made.select(*[f.split(" ")[0] for f in CHUNKS.split(", ")[:-2]], "source"), f"{out}/chunks", "chunks", ["source"], number)
        chunks = read(session, f"{out}/chunks", CHUNKS).filter(F.col("batch") == number)

        known = read(session, f"{out}/vectors", VECTORS).filter((F.col("batch") < number) & (F.col("model") == config["embed_model"]))
        wanted = chunks.groupBy("content_hash").agg(F.first(F.struct("file_path", "content")).alias("c")).join(known.select("content_hash"), "content_hash", "left_anti")
        none = F.lit(None).cast("string")
        told = wanted.select("content_hash", "c.*").select("content_hash", "file_path", "content", F.lit("window").alias("kind"), *[none.alias(c) for c in ("symbol_name", "parent_symbol", "signature", "js_doc")])
        vectors = index.embed_contents(told.withColumn("embed_text", text.embed_text()), index.HashingEmbedder(config["vector_size"]), config["vector_size"], config["embed_tasks"])
        counted["embedded"] = written(vectors.select("content_hash", F.lit(config["embed_model"]).alias("model"), "vector"), f"{out}/vectors", "vectors", [], number)

        files = newest(rows, config, F.coalesce(body.rlike(HAS_WORD), F.lit(False)).alias("has_text"))
        files = files.join(chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("n_chunks")), "file_path", "left")
        files = files.select("file_path", F.when(F.col("has_text"), "chunked").otherwise("no-text").alias("outcome"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "source")
        counted["files"] = written(files, f"{out}/files", "files", ["source"], number)
        log.info("batch %d of %s: %s", number, documents, counted)
        for k, v in counted.items():
            total[k] += v

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s, wrote %s: %s", documents, out, total)
    return total


def current(spark: SparkSession, out: str) -> DataFrame:
    """The index as it stands: source, file_path, lines, part, tokens, content_hash, content, vector."""
    last = read(spark, f"{out}/files", FILES).groupBy("file_path").agg(F.max("batch").alias("batch"))
    vectors = read(spark, f"{out}/vectors", VECTORS).groupBy("content_hash").agg(F.max_by("vector", "batch").alias("vector"))
    chunks = read(spark, f"{out}/chunks", CHUNKS).join(last, ["file_path", "batch"], "left_semi").drop("batch")
    return chunks.join(vectors, "content_hash", "left")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("refresh_index")
    try:
        refresh(spark, args.documents, args.out, args.checkpoint, settings(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
