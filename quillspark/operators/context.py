"""Context for an answer: one chunk a file, packed into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text


def best_per_file(retrieved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``retrieved``: pos, file_path, fused_score, ...; adds ``kept`` (highest score of its file, the earlier
    of equals) and ``file_pos`` (where the file first appears).  ``by``: columns that name a request."""
    by_file = Window.partitionBy(*by, "file_path")
    rank = F.row_number().over(by_file.orderBy(F.desc("fused_score"), "pos"))
    return retrieved.withColumn("kept", rank == 1).withColumn("file_pos", F.min("pos").over(by_file))


def pack(kept: DataFrame, budget: int = model.CONTEXT_BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks in order of score until the first that does not fit; the first always fits.  Adds place,
    block, tokens, used and included.  A request (all rows, or those equal in ``by``) has at most top_k rows."""
    order = Window.partitionBy(*by).orderBy(F.desc("fused_score"), "file_pos")
    rows = kept.withColumn("block", text.context_block()).withColumn("tokens", text.estimate_tokens("block"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("included", (F.col("place") == 1) | (F.col("used") <= budget))


def assemble(retrieved: DataFrame, budget: int = model.CONTEXT_BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """Every retrieved row with included / dropped_as (duplicate-file or budget); the trace of each request."""
    marked = best_per_file(retrieved, by)
    packed = pack(marked.filter("kept"), budget, by).select(*by, "pos", "place", "block", "tokens", "included")
    rows = marked.join(packed, [*by, "pos"], "left").withColumn("included", F.coalesce("included", F.lit(False)))
    return rows.withColumn("dropped_as", F.when(~F.col("kept"), "duplicate-file").when(~F.col("included"), "budget")).orderBy(*by, "pos")


def context_text(assembled: DataFrame, budget: int = model.CONTEXT_BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a request: the joined blocks, their estimated tokens, whether the budget is exceeded."""
    blocks = F.transform(F.array_sort(F.collect_list(F.when(F.col("included"), F.struct("place", "block")))), lambda x: x["block"])
    joined = assembled.groupBy(*by).agg(F.concat_ws("\n\n", blocks).alias("context_text"))
    return joined.withColumn("context_tokens", text.estimate_tokens("context_text")).withColumn("budget_exceeded", F.col("context_tokens") > budget)


def trace_table(retrieved: DataFrame) -> DataFrame:
    """The retrieved rows as a table to read: path:start-end, ranks (a dash for none), score to 3 decimals."""

    def rank(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("—")).alias(name)

    span = F.concat("file_path", F.lit(":"), "start_line", F.lit("-"), "end_line").alias("span")
    return retrieved.select(span, rank("dense_rank"), rank("lexical_rank"), F.format_number("fused_score", 3).alias("score"))
