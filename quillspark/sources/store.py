"""The chunk table: Parquet, one folder a repository; replaced whole, all or nothing.

A replacement is written beside the table and moved in only when it is complete, so a failure
leaves the old rows; one that was killed between its two moves is undone by ``recover``, which
every replacement calls first.  One run at a time writes a repository.  An empty replacement clears the repository.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first one in ``order``."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")  # combined before the shuffle


def folder_of(table: str, repo: str) -> str:
    return f"{table.rstrip('/')}/repo_source={quote(repo, safe='')}"


def hadoop(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = hadoop(spark, uri)
    return fs.exists(path)


def recover(spark: SparkSession, table: str, repo: str) -> None:
    """If a replacement broke off after it had moved the old rows away, move them back."""
    fs, final = hadoop(spark, folder_of(table, repo))
    old = hadoop(spark, _kept(table, repo))[1]
    if fs.exists(old):
        if fs.exists(final):
            fs.delete(old, True)
        else:
            fs.rename(old, final)


def _kept(table: str, repo: str) -> str:
    return f"{table.rstrip('/')}/_old-{quote(repo, safe='')}"


def read_chunks(spark: SparkSession, table: str, repo: str | None = None) -> DataFrame:
    """The table, or one repository of it (a folder: other repositories are not even listed)."""
    reader = spark.read.schema(model.STORED).option("basePath", table)
    fs, path = hadoop(spark, table if repo is None else folder_of(table, repo))
    if not fs.exists(path):
        return spark.createDataFrame([], model.STORED)
    return reader.parquet(path.toString())


def swap(spark: SparkSession, table: str, repo: str, staged: str) -> None:
    """Move the folder ``staged`` to the place of the repository's rows; if it does not exist, the repository is cleared."""
    recover(spark, table, repo)
    fs, final = hadoop(spark, folder_of(table, repo))
    new, old = (hadoop(spark, x)[1] for x in (staged, _kept(table, repo)))
    had = fs.exists(final)
    if had and not fs.rename(final, old):
        raise OSError(f"cannot move {final.toString()}")
    if fs.exists(new):
        fs.mkdirs(final.getParent())
        if not fs.rename(new, final):
            if had:
                fs.rename(old, final)
            raise OSError(f"cannot move {staged}")
    fs.delete(old, True)


def replace_chunks(spark: SparkSession, table: str, repo: str, rows: DataFrame) -> tuple[int, int]:
    """After it, the rows of ``repo`` are exactly ``rows``; returns (deleted, inserted)."""
    fs, final = hadoop(spark, folder_of(table, repo))
    staged = f"{table.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    recover(spark, table, repo)
    try:
        rows.drop("repo_source").write.parquet(staged)
        deleted = spark.read.parquet(final.toString()).count() if fs.exists(final) else 0
        inserted = spark.read.schema(rows.drop("repo_source").schema).parquet(staged).count()
        swap(spark, table, repo, staged if inserted else f"{staged}-none")
        return deleted, inserted
    finally:
        fs.delete(hadoop(spark, staged)[1], True)


def write_json(chunks: DataFrame, path: str) -> None:
    """Dump of the chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)
