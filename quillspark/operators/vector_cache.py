"""The cache of vectors: a Parquet table bucketed and sorted by content hash; of a hash the last row wins, whatever its model.

Looking hashes up shuffles the hashes only: the table lies in buckets already, so its side of the join has no exchange, nor has the
aggregate that picks a hash's last row.  Every run appends one file a bucket; ``compact`` rewrites the table with one row a hash, in
as many buckets as it then needs, as a new generation beside the old one.  A generation counts once its writer has marked it complete,
so a reader sees the old one or the new one.  One run at a time writes a cache.
"""

from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

COLUMNS = "content_hash string, model string, vector array<float>"
FIRST_BUCKETS, BUCKET_ROWS, MAX_BUCKETS = 8, 200_000, 1 << 14
#: Files a bucket that are read before the table is rewritten.
MAX_FILES = 8


def _generations(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(number, buckets, folder) of the generations that are complete, the last one first."""
    fs, where = store.hadoop(spark, path)
    found = []
    for s in fs.listStatus(where) if fs.exists(where) else []:
        named = re.match(r"g(\d+)-(\d+)$", s.getPath().getName())
        if named and store.exists(spark, f"{s.getPath().toString()}/_SUCCESS"):
            found.append((int(named[1]), int(named[2]), s.getPath().toString()))
    return sorted(found, reverse=True)


def _table(spark: SparkSession, folder: str, buckets: int) -> str:
    """The folder as a table of this session's catalogue, which knows its buckets."""
    name = f"vector_cache_{hashlib.md5(folder.encode()).hexdigest()}"
    place = folder.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}, written long) USING parquet CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return name


def read(spark: SparkSession, path: str) -> DataFrame:
    """content_hash, model, vector: one row a hash."""
    found = _generations(spark, path)
    if not found:
        return spark.createDataFrame([], COLUMNS)
    rows = spark.table(_table(spark, found[0][2], found[0][1]))
    return rows.groupBy("content_hash").agg(F.max_by(F.struct("model", "vector"), "written").alias("last")).select("content_hash", "last.*")


def append(rows: DataFrame, path: str) -> None:
    """``rows``: content_hash, model, vector.  They win over what the cache holds of their hashes."""
    spark = rows.sparkSession
    found = _generations(spark, path)
    _, buckets, folder = found[0] if found else (0, FIRST_BUCKETS, f"{path.rstrip('/')}/g0-{FIRST_BUCKETS}")
    made = rows.select("content_hash", "model", F.col("vector").cast("array<float>").alias("vector"), F.lit(time.time_ns()).alias("written"))
    made.repartition(buckets, "content_hash").write.insertInto(_table(spark, folder, buckets))
    if len(spark.table(_table(spark, folder, buckets)).inputFiles()) > MAX_FILES * buckets:
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the cache: one row a hash, one file a bucket, buckets by the number of rows."""
    number, _, old = _generations(spark, path)[0]
    rows = read(spark, path)
    n = rows.count()
    buckets = min(MAX_BUCKETS, max(FIRST_BUCKETS, 1 << max(0, (n - 1) // BUCKET_ROWS).bit_length()))
    fs = store.hadoop(spark, path)[0]
    folder = f"{path.rstrip('/')}/g{number + 1}-{buckets}"
    fs.delete(store.hadoop(spark, folder)[1], True)  # what a run that broke off has left
    name = _table(spark, folder, buckets)
    rows.withColumn("written", F.lit(time.time_ns())).repartition(buckets, "content_hash").write.insertInto(name)
    fs.delete(store.hadoop(spark, old)[1], True)
