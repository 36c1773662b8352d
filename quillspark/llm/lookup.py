"""Small tables: made on the driver, joined by equality or by spans (DataFrame and SQL operations only)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def column(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[column(c) for c in df.columns])


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from the driver: one literal, whatever its length."""
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def small(df: DataFrame) -> DataFrame:
    """Broadcast where its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def inside(rows: DataFrame, value: Column, on: list[str], spans: DataFrame) -> DataFrame:
    """Rows with the columns of the span ``begin`` <= value < ``end`` (among those equal in ``on``).

    A span is listed under every stretch of values that it touches; stretches are about as many as spans.
    """
    n, top = spans.agg(F.count("*"), F.max("end")).first()
    width = max(1, (top or 1) // max(1, 16 * n))
    listed = spans.withColumn("__stretch", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(end - 1) div {width}"))))
    asked = rows.withColumn("__value", value.cast("long")).withColumn("__stretch", F.expr(f"__value div {width}"))
    met = asked.join(small(listed), [*on, "__stretch"])
    return met.filter((F.col("__value") >= F.col("begin")) & (F.col("__value") < F.col("end"))).drop("__value", "__stretch", "begin", "end")
