"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.  Mixing decides
an order; it takes effect in the order of the written files and of the rows in them, which sharding
reads back, so the shards are contiguous runs of the mixed order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, mixing, quality, sharding, simhash
from quillspark.llm.queries import WEIGHTS
from quillspark.workspace import Workspace

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    A null, empty or blank text has no words and goes; of rows that are equal each is judged by itself, so all stay or all go; nulls in
    other columns and further columns are carried as they are; an empty table stays empty.
    """
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts without words are one group; rows equal in id and text are one document, of rows that share an id only those with
    similar texts are; a null id counts as an id, after all others; ties go to the smaller digest of the text; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5 of 100 lie in benchmark windows.

    A null or empty text has no words and stays; equal rows are judged alike; benchmark items without text or words find nothing;
    with an empty benchmark all rows stay.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule.

    A null source is a source of its own (``(null)``, weight 1); within a source rows follow the digest of their id, then the id;
    equal rows stay as often as they came; nulls in other columns and further columns are carried as they are; an empty table stays empty.
    """
    return mixing.mix(docs, WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; shards follow the order of ``docs``.

    That is the order of the part files by number and of the rows in them; a table that was not read from
    files has no order but that of its ids, and is sharded in that.
    """
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    order = [number, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:  # not read from files: no order but that of the ids
        order = None
    return sharding.shard(docs, SHARDS, order=order)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL has no 64-bit XXH64 with a seed, so the near-duplicate stage cannot be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; all but the last are written in the shared folder."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(work.path(f"{k}-{name}"))
            docs = spark.read.parquet(work.path(f"{k}-{name}"))
    return docs
