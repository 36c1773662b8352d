"""What the jobs share: configuration, logging and the command line's session."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger("quillspark.jobs")

#: Stands for a missing or empty partition value, which a folder's name cannot tell apart.
NONE = "(none)"


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overridden by the JSON file at ``path`` (read through Spark: it may be remote)."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return defaults | given


def partition_value(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.when(value.isNull() | (value == ""), F.lit(NONE)).otherwise(value)


def _status(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(where) if system.exists(where) else None


def exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def new_files(spark: SparkSession, path: str, per_batch: int) -> DataFrame:
    """A stream of the Parquet files of a table, which is a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch)
    if _status(spark, path).isFile():  # a file stream takes folders only
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table, or no rows if it was never written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def written(rows: DataFrame, path: str, name: str, parts: list[str], batch: int | None = None) -> int:
    """Replace the table at ``path``, or only the folders of ``batch`` in it, by ``rows``; returns and logs their number.

    Rows are rebalanced by the folders first: Spark splits a folder that holds many rows over several files
    and packs small ones together, whatever the sizes are.
    """
    spark, parts = rows.sparkSession, parts if batch is None else ["batch", *parts]
    if batch is not None:
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
    schema = rows.schema
    rows.hint("rebalance", *[F.col(c) for c in parts if c != "batch"]).write.mode("overwrite").option("partitionOverwriteMode", "static" if batch is None else "dynamic").partitionBy(*parts).parquet(path)
    found = read(spark, path, schema)
    number = (found if batch is None else found.filter(F.col("batch") == batch)).count()  # from the files' footers
    log.info("wrote %d rows of %s to %s%s", number, name, path, "" if batch is None else f"/batch={batch}")
    return number


def session(app: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    return SparkSession.builder.appName(app).getOrCreate()
