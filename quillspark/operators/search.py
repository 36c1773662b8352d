"""Hybrid retrieval: exact cosine top-k and lexical top-k, fused by reciprocal rank.

Plan: each leg is a filter and a top-k (``TakeOrderedAndProject``: every task keeps its best k rows,
nothing is shuffled or sorted as a whole); only ids and scores go on.  The two legs of at most
``per_leg_limit`` rows meet in an aggregate by id, and only the winners' wide columns are fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..model import SearchOptions
from . import postings


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine_distance(vector: Column, query: Sequence[float], vector_norm: Column | None = None) -> Column:
    """1 - cosine in double precision; null for a zero vector."""
    q = [float(x) for x in query]
    if not q:
        raise ValueError("an empty query vector")
    literal = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    size = sum(x * x for x in q) ** 0.5
    return F.lit(1.0) - dot / F.nullif((norm(vector) if vector_norm is None else vector_norm) * F.lit(size), F.lit(0.0))


def symbol_boost(symbol: Column, query: str, boost: float) -> Column:
    return F.when(exact_symbol(symbol, query), F.lit(float(boost))).otherwise(F.lit(0.0))


def exact_symbol(symbol: Column, query: str) -> Column:
    return F.coalesce(F.lower(symbol) == F.lit(query.strip(" ").lower()), F.lit(False))


def scoped(chunks: DataFrame, repo: str | None) -> DataFrame:
    """On a table partitioned by repository this prunes partitions."""
    return chunks if repo is None else chunks.filter(F.col("repo_source") == repo)


def dense_leg(chunks: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """id, dense_distance, dense_rank of the nearest; ties and zero vectors by id, zero vectors last."""
    known = F.col("norm") if "norm" in chunks.columns else None
    near = chunks.filter(F.col("embedding").isNotNull()).select("id", cosine_distance(F.col("embedding"), query, known).alias("dense_distance"))
    best = near.orderBy(F.col("dense_distance").asc_nulls_last(), "id").limit(limit)
    return best.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.col("dense_distance").asc_nulls_last(), "id")).cast("long"))


def lexical_leg(chunks: DataFrame, query: str, limit: int, boost: float, stem=None) -> DataFrame:
    """id, lexical_score, lexical_rank of chunks that match the query or bear its name."""
    parsed = lexical.parse_query(query, stem or (lambda w: w))
    words, symbol = F.col("lexemes"), F.col("symbol_name")
    match = lexical.matches(words, parsed)
    score = F.when(match, lexical.rank(words, F.col("doc_len"), parsed)).otherwise(F.lit(0.0)) + symbol_boost(symbol, query, boost)
    hits = chunks.filter(match | exact_symbol(symbol, query)).select("id", score.alias("lexical_score"))
    best = hits.orderBy(F.desc("lexical_score"), "id").limit(limit)
    return best.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc("lexical_score"), "id")).cast("long"))


def fuse(dense: DataFrame, lexical_: DataFrame, options: SearchOptions) -> DataFrame:
    """Full outer union of the legs by id and the best ``top_k`` by fused score.  A leg that lacks an id
    adds nothing; weight 0 keeps a leg's rows with score 0."""
    nothing = F.lit(None)
    rows = dense.select("id", "dense_rank", "dense_distance", nothing.cast("long").alias("lexical_rank"), nothing.cast("double").alias("lexical_score")).unionByName(
        lexical_.select("id", nothing.cast("long").alias("dense_rank"), nothing.cast("double").alias("dense_distance"), "lexical_rank", "lexical_score")
    )
    both = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in ("dense_rank", "dense_distance", "lexical_rank", "lexical_score")])

    def term(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(float(weight)) / (F.lit(float(options.rrf_k)) + F.col(rank)), F.lit(0.0))

    fused = both.withColumn("fused_score", term(options.dense_weight, "dense_rank") + term(options.lexical_weight, "lexical_rank"))
    return fused.orderBy(F.desc("fused_score"), "id").limit(options.top_k)


def hybrid_search(chunks: DataFrame, query_vector: Sequence[float], query: str, options: SearchOptions = SearchOptions(), stem=None, lexical_index: str | None = None, dense: DataFrame | None = None) -> DataFrame:
    """Retrieved chunks with their ranks and scores, best first.

    ``lexical_index``: folder of postings of these chunks.  ``dense``: the dense leg, if an index gave it already (``ann.nearest``).
    """
    scope = scoped(chunks, options.repo_source)
    if lexical_index:
        words = postings.lexical_leg(chunks.sparkSession, lexical_index, query, options.per_leg_limit, options.symbol_boost, stem, options.repo_source)
    else:
        words = lexical_leg(scope, query, options.per_leg_limit, options.symbol_boost, stem)
    best = fuse(dense_leg(scope, query_vector, options.per_leg_limit) if dense is None else dense, words, options)
    hidden = {"embedding", "norm", "lexemes", "doc_len", "embed_text", "content_hash", "created_at"}
    wide = scope.select(*[c for c in scope.columns if c not in hidden])
    # The fused side has at most 2 * per_leg_limit rows, so its broadcast is of bounded size.
    return wide.join(F.broadcast(best), "id").orderBy(F.desc("fused_score"), "id")
