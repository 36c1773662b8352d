"""What indexing a table of documents will cost, and which documents to look at first.

    python -m jobs.preflight_audit --documents PATH --out PATH --snapshot NAME [--config jobs/preflight_audit.json]

The rules are those of the library's ingest (skip rules, token estimate, chunk and context budgets).  Output, each
replaced as a whole when the snapshot is run again (other snapshots stay):

    out/profile/snapshot=NAME/source=S/     one row a document: language, bytes, lines, tokens, longest line, digest, first copy
    out/findings/snapshot=NAME/kind=K/      one row a document and reason to look at it
    out/summary/snapshot=NAME/              per source and language: documents, bytes, tokens, copies, tokens to embed, cost

Findings: ``empty`` (no word), ``too-large`` and ``binary-content`` (ingest skips it), ``over-budget`` (more tokens than a prompt's
context), ``long-line`` (a line longer than a chunk), ``copy`` (same text as the document with the smallest id, which is ``related``).

Texts are read once: everything after the profile works on its narrow rows.  Copies are found by an aggregate; the
digests of crowded groups (at most ``1 / crowd`` of them, so few enough to be sent to every task) are looked up without a shuffle, the others by a
join in which no key has more than ``crowd`` of the rows.

Null text counts as empty; null or empty source and language are ``(none)``; a null id is
kept, and is ``first`` only where all copies lack an id; rows that share id and text count one by one and are no copies of each other.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import model
from quillspark.functions import text
from quillspark.sources import walk

from .common import log, partition_value, read, session, settings, written

DEFAULTS = {
    "id_column": "doc_id",
    "text_column": "text",
    "source_column": "source",
    "language_column": "lang",
    "suffix": ".md",
    "chunk_tokens": model.MAX_CHUNK_TOKENS,
    "context_tokens": model.CONTEXT_BUDGET,
    "microcents_per_token": 15,
    "crowd": 0.0005,
}
PROFILE = "id string, file_path string, language string, bytes long, lines long, tokens long, longest_line long, has_word boolean, skip string, digest string, source string"
FINDINGS = "source string, language string, id string, amount long, related string, kind string"
SUMMARY = "source string, language string, documents long, bytes long, tokens long, copies long, findings long, tokens_to_embed long, cost_microcents long"


def profile(documents: DataFrame, config: dict) -> DataFrame:
    """One narrow row a document; no shuffle."""
    body = F.coalesce(F.col(config["text_column"]), F.lit(""))
    name = F.concat(F.coalesce(F.col(config["id_column"]).cast("string"), F.lit("")), F.lit(config["suffix"]))
    sized = documents.select(F.col(config["id_column"]).cast("string").alias("id"), partition_value(config["source_column"]).alias("source"), partition_value(config["language_column"]).alias("language"), body.alias("text"), name.alias("name"))
    lines = F.split("text", "\n", -1)
    return sized.select(
        "id", F.concat("source", F.lit("/"), "name").alias("file_path"), "language", F.octet_length("text").cast("long").alias("bytes"), F.size(lines).cast("long").alias("lines"), text.estimate_tokens("text").cast("long").alias("tokens"),
        F.array_max(F.transform(lines, text.estimate_tokens)).cast("long").alias("longest_line"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("has_word"),
        walk.skip_reason(F.col("name"), F.octet_length("text"), F.substring(F.encode("text", "UTF-8"), 1, model.NUL_PROBE_BYTES)).alias("skip"), F.sha2("text", 256).alias("digest"), "source",
    )


def with_first_copy(rows: DataFrame, crowd: float) -> DataFrame:
    """Adds ``first``: the smallest id among rows of equal ``digest``, and ``copies``: how many there are."""
    number = F.expr("try_cast(id AS decimal(38, 0))")
    first = F.min_by("id", F.when(F.col("id").isNotNull(), F.struct(number.isNull(), number, "id")))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("copies"))
    bound = max(1, int(crowd * rows.count()))
    large = groups.filter(F.col("copies") > bound)  # fewer than 1 / crowd
    met = rows.join(F.broadcast(large.withColumnsRenamed({"first": "first_large", "copies": "copies_large"})), "digest", "left")
    found = met.filter(F.col("copies_large").isNotNull()).drop("first_large", "copies_large"), met.filter(F.col("copies_large").isNull()).drop("first_large", "copies_large")
    crowded = found[0].join(F.broadcast(large), "digest")
    return crowded.unionByName(found[1].join(groups.filter(F.col("copies") <= bound), "digest"))


def findings(rows: DataFrame, config: dict) -> DataFrame:
    """A row for each reason that a document gives."""

    def reason(kind: Column, when: Column, amount: Column, related: Column | None = None) -> Column:
        return F.when(when, F.struct(amount.alias("amount"), (F.lit(None).cast("string") if related is None else related).alias("related"), kind.alias("kind")))

    reasons = F.array(
        reason(F.lit("empty"), ~F.col("has_word"), F.col("bytes")),
        reason(F.col("skip"), F.col("skip").isNotNull(), F.col("bytes")),
        reason(F.lit("over-budget"), F.col("tokens") > config["context_tokens"], F.col("tokens")),
        reason(F.lit("long-line"), F.col("longest_line") > config["chunk_tokens"], F.col("longest_line")),
        reason(F.lit("copy"), (F.col("copies") > 1) & F.col("has_word") & ~F.col("id").eqNullSafe(F.col("first")), F.col("copies"), F.col("first")),
    )
    return rows.select("source", "language", "id", F.inline(F.array_compact(reasons))).select("source", "language", "id", "amount", "related", "kind")


def summary(rows: DataFrame, found: DataFrame, config: dict) -> DataFrame:
    copy = (F.col("copies") > 1) & ~F.col("id").eqNullSafe(F.col("first"))
    ready = F.col("has_word") & F.col("skip").isNull() & ~copy
    totals = rows.groupBy("source", "language").agg(
        F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.when(copy & F.col("has_word"), 1)).alias("copies"),
        F.sum(F.when(ready, F.col("tokens")).otherwise(0)).alias("tokens_to_embed"),
    )
    counted = found.groupBy("source", "language").agg(F.count("*").alias("findings"))
    joined = totals.join(counted, ["source", "language"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return joined.withColumn("cost_microcents", F.col("tokens_to_embed") * config["microcents_per_token"]).select(*[f.split(" ")[0] for f in SUMMARY.split(", ")])


def audit(spark: SparkSession, documents: str, out: str, snapshot: str, config: dict | None = None) -> dict:
    """Write the three tables of the snapshot; returns what was written."""
    config = DEFAULTS | (config or {})
    at = {name: f"{out}/{name}/snapshot={snapshot}" for name in ("profile", "findings", "summary")}
    log.info("reading %s", documents)
    counts = {"profile": written(profile(spark.read.parquet(documents), config), at["profile"], "profile", ["source"])}
    rows = with_first_copy(read(spark, at["profile"], PROFILE), config["crowd"])
    counts["findings"] = written(findings(rows, config), at["findings"], "findings", ["kind"])
    counts["summary"] = written(summary(rows, read(spark, at["findings"], FINDINGS), config), at["summary"], "summary", [])
    log.info("audited %s as %s: %s", documents, snapshot, counts)
    return counts


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "snapshot"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("preflight_audit")
    try:
        audit(spark, args.documents, args.out, args.snapshot, settings(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
