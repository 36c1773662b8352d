"""From chunks to stored rows: embed each distinct content once, keep vectors in a cache table.

Only distinct hashes without a cached vector reach the embedder; its result is written before it is
used, so the paid call is made once whatever the plan does with the rows.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import lexical
from ..functions.stem import stem_words
from ..sources import store
from ..workspace import Workspace
from . import postings, quota, vector_cache
from .search import norm


class EmbedError(RuntimeError):
    """kind: rate-limit, daily-quota, aborted or other."""

    def __init__(self, kind: str, message: str, retry_after_ms: int | None = None):
        super().__init__(message)
        self.kind, self.retry_after_ms = kind, retry_after_ms


@dataclass(frozen=True)
class HashingEmbedder:
    """Deterministic offline stand-in for an embedding service: signed feature hashing, unit length."""

    dim: int = model.EMBEDDING_DIM

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                vector[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = float(np.linalg.norm(vector))
            if size == 0:
                vector[0] = size = 1.0
            out.append((vector / size).astype(np.float32).tolist())
        return out


def wait_ms(attempt: int, hint: int | None, base_ms: float, draw: Callable[[], float] = random.random) -> float:
    return min(hint if hint is not None else base_ms * 2**attempt + draw() * base_ms, model.MAX_DELAY_MS)


def embed_texts(texts: Sequence[str], embedder: Callable, dim: int, retries: int = model.MAX_RETRIES, base_ms: float = model.BASE_DELAY_MS, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in the order of the texts, a batch at a time; only rate limits are tried again."""
    out: list[list[float]] = []
    for at in range(0, len(texts), model.BATCH_SIZE):
        batch, attempt = list(texts[at : at + model.BATCH_SIZE]), 0
        while True:
            try:
                vectors = embedder(batch)
                break
            except EmbedError as error:
                if error.kind != "rate-limit" or attempt >= retries:
                    raise
                sleep(wait_ms(attempt, error.retry_after_ms, base_ms) / 1000)
                attempt += 1
        if len(vectors) != len(batch) or any(v is None or len(v) != dim for v in vectors):
            raise EmbedError("other", f"expected {len(batch)} vectors of {dim} values")
        out += vectors
    return out


#: Texts whose vectors a worker holds as numbers of Python at once, whatever a batch holds; whole calls of the service.
EMBED_ROWS = 32 * model.BATCH_SIZE


def _embed(batches: Iterator[pa.RecordBatch], embedder: Callable, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, EMBED_ROWS) for whole in batches for at in range(0, whole.num_rows, EMBED_ROWS)):
        vectors = embed_texts(batch.column(1).to_pylist(), embedder, dim)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["content_hash", "vector"])


def _vectors(texts: Sequence[str], vectors: Sequence, dim: int) -> pa.Array:
    if len(vectors) != len(texts) or any(v is None or len(v) != dim for v in vectors):
        raise EmbedError("other", f"expected {len(texts)} vectors of {dim} values")
    return pa.array(vectors, pa.list_(pa.float32()))


def _refused(error: Exception, attempt: int) -> float | None:
    """Seconds until another try; only rate limits are tried again."""
    if not isinstance(error, EmbedError) or error.kind != "rate-limit":
        return None
    return wait_ms(attempt, error.retry_after_ms, model.BASE_DELAY_MS) / 1000


def embed_contents(contents: DataFrame, embedder: Callable, dim: int, tasks: int | None = None, per_minute: int | None = None, minute: float = 60.0) -> DataFrame:
    """content_hash, vector of rows content_hash, embed_text.

    ``tasks``: how many call the service at once (None: as many as there are).  ``per_minute``: texts that the service takes within
    ``minute`` seconds from all tasks together; without it each task tries again on its own when it is refused.
    """
    rows, schema = contents.select("content_hash", "embed_text"), "content_hash string, vector array<float>"
    if per_minute is not None:
        return quota.mapped(rows, embedder, partial(_vectors, dim=dim), _refused, schema, tasks or model.CONCURRENCY, per_minute, minute)
    rows = rows if tasks is None else rows.repartition(tasks)
    return rows.mapInArrow(partial(_embed, embedder=embedder, dim=dim), schema)


def distinct_contents(chunks: DataFrame) -> DataFrame:
    """content_hash, embed_text of its first chunk (by ``seq``), copies."""
    return chunks.groupBy("content_hash").agg(F.min_by("embed_text", "seq").alias("embed_text"), F.count("*").alias("copies"))


def with_cache(contents: DataFrame, cache: DataFrame, embed_model: str) -> DataFrame:
    """Adds ``vector``: the cached one of this model, or null (a miss).  ``cache``: one row a hash."""
    known = cache.filter(F.col("model") == embed_model).select("content_hash", "vector")
    return contents.join(known, "content_hash", "left")


def attach(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every chunk of a hash gets its vector; chunks without a vector are left out."""
    return chunks.join(vectors.filter(F.col("vector").isNotNull()).select("content_hash", F.col("vector").alias("embedding")), "content_hash")


@dataclass(frozen=True)
class IndexReport:
    total_chunks: int
    unique_hashes: int
    cache_hits: int
    embedded: int
    deleted: int
    inserted: int


def stored_rows(chunks: DataFrame, repo: str, first_id: int) -> DataFrame:
    """Columns of the chunk table; ids follow ``seq`` from ``first_id`` on, so they are unique in the table."""
    words = lexical.lexemes(lexical.indexed_text(), stem_words)
    ready = chunks.withColumn("lexemes", words).withColumn("doc_len", F.size(F.filter("lexemes", lambda t: t != "")))
    ready = ready.withColumn("norm", norm(F.col("embedding"))).withColumn("created_at", F.current_timestamp()).withColumn("repo_source", F.lit(repo)).withColumn("id", F.col("seq") + F.lit(first_id).cast("long"))
    return ready.select(*[f.split(" ")[0] for f in model.STORED.split(", ")])


def index_chunks(chunks: DataFrame, repo: str, table: str, cache_path: str, embed_model: str = "hashing", embedder: Callable | None = None, dim: int = model.EMBEDDING_DIM, postings_path: str | None = None, per_minute: int | None = None) -> IndexReport:
    """``chunks``: chunk rows with ``seq`` (their order).  All or nothing: a failure stores and caches nothing.

    ``postings_path``: where the inverted index is kept in step with the table; the repository's segment is replaced after its rows.
    ``per_minute``: the service's quota of texts, shared by all tasks.
    """
    spark = chunks.sparkSession
    work = Workspace(spark, "index")
    try:
        chunks = work.table(chunks, "chunks")
        known = work.table(with_cache(distinct_contents(chunks), vector_cache.read(spark, cache_path), embed_model), "known")
        new = work.table(embed_contents(known.filter(F.col("vector").isNull()), embedder or HashingEmbedder(dim), dim, model.CONCURRENCY, per_minute), "new")
        vectors = known.filter(F.col("vector").isNotNull()).select("content_hash", "vector").union(new)
        rows = store.first_wins(attach(chunks, vectors), ["content_hash"], ["seq"])
        counts = known.agg(F.count("*").alias("unique"), F.count("vector").alias("hits"), F.sum("copies").alias("total")).first()
        top = store.read_chunks(spark, table).agg(F.max("id")).first()[0]  # one run at a time writes a table
        deleted, inserted = store.replace_chunks(spark, table, repo, stored_rows(rows, repo, 0 if top is None else top + 1))
        if postings_path:
            postings.replace(store.read_chunks(spark, table, repo), postings_path, repo)
        vector_cache.append(new.withColumn("model", F.lit(embed_model)), cache_path)
        return IndexReport(counts["total"] or 0, counts["unique"], counts["hits"], counts["unique"] - counts["hits"], deleted, inserted)
    finally:
        work.drop()
