"""Conversations as prompt contents: the last turns, roles renamed, context put before the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def last_turns(turns: DataFrame, cap: int = model.MAX_HISTORY_TURNS) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("__back", back).filter(F.col("__back") <= cap).drop("__back")


def last_user_message(turns: DataFrame) -> DataFrame:
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


def prompt_contents(turns: DataFrame, contexts: DataFrame, cap: int = model.MAX_HISTORY_TURNS) -> DataFrame:
    """conv_id, turn, role (model for the assistant, else user), text; ``contexts``: conv_id, context_text."""
    kept = last_turns(turns, cap)
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = kept.withColumn("asked", asked).join(contexts, "conv_id", "left")
    framed = F.concat(F.lit(f"{model.CONTEXT_MARKER}\n"), F.coalesce("context_text", F.lit("")), F.lit("\n\n"), F.col("text"))
    role = F.when(F.col("role") == "assistant", "model").otherwise("user")
    return rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("turn") == F.col("asked"), framed).otherwise(F.col("text")).alias("text"))


def chat_history(turns: DataFrame) -> DataFrame:
    """One row a conversation: its messages in order."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return turns.groupBy("conv_id").agg(messages.alias("messages"))
