"""Settings from the environment, and which migrations are still to be applied."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import store

#: Layouts of the stored tables, in the order in which they came.
MIGRATIONS = ("001_init",)


@dataclass(frozen=True)
class Settings:
    table_uri: str
    embed_model: str
    gen_model: str
    port: int = 8080


def load(env: Mapping[str, str] | None = None) -> Settings:
    """Raises one readable message that names every missing or wrong setting."""
    env = os.environ if env is None else env
    wrong = [f"{k}: required" for k in ("TABLE_URI", "EMBED_MODEL", "GEN_MODEL") if not env.get(k)]
    port = env.get("PORT", "8080")
    if not port.isdigit() or not 0 < int(port) < 65536:
        wrong.append("PORT: expected a port number")
    if wrong:
        raise ValueError("invalid configuration: " + "; ".join(wrong))
    return Settings(env["TABLE_URI"], env["EMBED_MODEL"], env["GEN_MODEL"], int(port))


def pending_migrations(expected: DataFrame, applied: DataFrame) -> DataFrame:
    """Names that are expected and not applied."""
    return expected.select("name").join(applied.select("name"), "name", "left_anti")


def ready(expected: DataFrame, applied: DataFrame, shutting_down: bool) -> bool:
    return not shutting_down and pending_migrations(expected, applied).isEmpty()


def applied_migrations(spark: SparkSession, ledger: str) -> DataFrame:
    """Names in the ledger, a folder of Parquet files; none where it does not exist."""
    fs, path = store.hadoop(spark, ledger)
    return spark.read.schema("name string").parquet(ledger) if fs.exists(path) else spark.createDataFrame([], "name string")


def record_migrations(spark: SparkSession, ledger: str) -> list[str]:
    """Enter what is expected and not yet there; returns the new names."""
    expected = spark.createDataFrame([(name,) for name in MIGRATIONS], "name string")
    new = sorted(r.name for r in pending_migrations(expected, applied_migrations(spark, ledger)).collect())
    if new:
        spark.createDataFrame([(name,) for name in new], "name string").coalesce(1).write.mode("append").parquet(ledger)
    return new
