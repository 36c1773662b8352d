"""The opN_<name> queries: thin bindings of the operators to the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, kneser_ney, langid, linededup, mixing, oracles, quality, runs, sharding, simhash, tokens, toxicity, warc


#: Target weights of the sources; sources that are not named here weigh 1 each.
WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), folds=3, held=1)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = tokens.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, WEIGHTS).select("row.doc_id", "source", "block", "slot", "position")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(_table(spark, sf_dir, "documents"), folds=7, held=2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return decontam.verdicts(found, percent=5).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return runs.digests(runs.periodic_runs(runs.with_periodic_tails(docs)))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, held=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_tokens": op3_tokens,
    "op4_mixing": op4_mixing,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_decontam": op9_decontam,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
}
ORACLES: dict[str, str] = {
    "op4_mixing": oracles.mixing(WEIGHTS),
    "op6_sharding": oracles.sharding(8),
    "op7_warc": oracles.WARC,
    "op8_quality": oracles.QUALITY,
    "op9_decontam": oracles.DECONTAMINATION,
    "op11_periodic_runs": oracles.periodic_runs(),
}
