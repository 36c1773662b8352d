"""An inverted index of the lexical leg: segments by repository, postings in blocks of neighbouring ids.

``write`` makes one table: for each term, repository and span of ``SPAN`` ids one or more rows with the postings of that span (offset
in the span, occurrences, length of the chunk, places) and ``best``, the best score that any of the row gets from the
term.  The chunks of a span are brought together first, and a worker makes rows of what it holds, so postings are not grouped
again; a span is cut where it holds more than a worker takes at once.  Names of symbols are terms too, with ``=`` before them.  Folders are the repository and a shard by the term's hash; a repository has as
many shards (a power of two) as its postings need, and the folder's number tells both (shards + hash modulo
shards), so a reader knows the few folders that can hold a term without knowing the numbers of shards.  ``replace`` swaps one
repository's segment for another.

``lexical_leg`` gives what :func:`search.lexical_leg` gives on the indexed rows.  It first reads the heads of
the blocks only: blocks of all terms share the same spans, so the sum of their ``best`` bounds every score in a span.  The spans with the highest
bounds are scored; of the others only those are read whose bound reaches the last score found.  Places
are read for phrases only.  A term that a third of the chunks hold is many short rows, spread over spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..sources import store

SPAN = 512
#: Spans that are scored before the others are held against the last of their scores.
FIRST_SPANS = 64
#: Lexemes that a worker turns into rows at once, whatever a batch holds; a longer chunk is taken alone.
SLICE_LEXEMES = 1 << 17
SHARD_ROWS, MAX_SHARDS = 4_000_000, 1 << 14
_POST = "struct<off: smallint, times: int, len: int, places: array<int>>"
_BLOCKS = f"term string, span long, best double, posts array<{_POST}>, repo_source string, shard int"


def _weight(times: Column, length: Column) -> Column:
    return times / (F.lit(1.0) + F.log(F.greatest(length, F.lit(1)).cast("double")))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(4)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_LEXEMES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, repo_source, doc_len, symbol, lexemes -> a row a chunk and term, with the places among the terms that are kept."""
    for batch in (part for whole in batches for part in _slices(whole)):
        lists = batch.column(4)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        chunk, flat = np.repeat(np.arange(batch.num_rows), n), lists.flatten()
        kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        chunk, coded = chunk[kept], flat.filter(pa.array(kept)).dictionary_encode()
        begun = np.searchsorted(chunk, np.arange(batch.num_rows))
        place = np.arange(len(chunk)) - begun[chunk]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = chunk * (len(coded.dictionary) + 1) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
        bounds = np.append(first, len(key))
        of = pa.array(chunk[order][first])
        columns = [coded.dictionary.take(pa.array(code[order][first])), *(batch.column(k).take(of) for k in range(3)), pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place[order].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "repo_source", "doc_len", "times", "places"])
        named = pa.array(np.flatnonzero(pc.fill_null(pc.greater(pc.utf8_length(batch.column(3)), 0), False).to_numpy(zero_copy_only=False)))
        symbols = pc.binary_join_element_wise("=", batch.column(3).take(named), "")
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(named) + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([symbols, *(batch.column(k).take(named) for k in range(3)), pa.array(np.zeros(len(named), np.int32)), none], names=["term", "id", "repo_source", "doc_len", "times", "places"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, repo_source, doc_len, symbol, lexemes -> term, repo_source, span, best, posts: a row for all postings of a slice that share the first three."""
    for rows in _terms(batches):
        null, ids = rows.column(1).is_null().to_numpy(zero_copy_only=False), pc.fill_null(rows.column(1), 0).to_numpy()
        repo, term = rows.column(2).dictionary_encode("encode"), rows.column(0).dictionary_encode("encode")
        spans, span = np.unique(ids // SPAN, return_inverse=True)
        span = np.where(null, len(spans), span)  # rows without an id are a span of their own
        key = (repo.indices.to_numpy().astype(np.int64) * (len(spans) + 1) + span) * (len(term.dictionary) + 1) + term.indices.to_numpy()
        order = np.lexsort((ids, key))
        key, ids, null = key[order], ids[order], null[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows, head = rows.take(pa.array(order)), pa.array(order[first])
        length, times = pc.fill_null(rows.column(3), 1).to_numpy(zero_copy_only=False), rows.column(4).to_numpy()
        best = np.maximum.reduceat(times / (1.0 + np.log(np.maximum(length, 1).astype(np.float64))), first) if len(first) else np.zeros(0)
        posts = pa.StructArray.from_arrays([pa.array((ids % SPAN).astype(np.int16), mask=null), *(rows.column(k) for k in (4, 3, 5))], names=["off", "times", "len", "places"])
        columns = [term.take(head).dictionary_decode(), repo.take(head).dictionary_decode(), pa.array((ids // SPAN)[first], mask=null[first]), pa.array(best), pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), posts)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "repo_source", "span", "best", "posts"])


def _shard(term: Column, shards: int | Column) -> Column:
    shards = F.lit(shards) if isinstance(shards, int) else shards
    return (shards + F.pmod(F.xxhash64(term), shards)).cast("int")


def span_of(ident: Column) -> Column:
    return F.floor((ident - F.pmod(ident, F.lit(SPAN))) / SPAN).cast("long")


def shards_of(term: str) -> list[int]:
    """The shards that can hold a term, whatever the number of shards; Spark's hash is XXH64 with seed 42."""
    h = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return [n + h % n for n in (1 << j for j in range(MAX_SHARDS.bit_length()))]


def shards_for(occurrences: int) -> int:
    return min(MAX_SHARDS, 1 << max(0, (max(occurrences, 1) - 1) // SHARD_ROWS).bit_length())


def _shards_for(occurrences: Column) -> Column:
    doubled = [(occurrences > SHARD_ROWS << k).cast("int") for k in range(MAX_SHARDS.bit_length() - 1)]
    return F.pow(F.lit(2), sum(doubled, F.lit(0))).cast("int")


def write(chunks: DataFrame, folder: str, occurrences: DataFrame | None = None, parts: tuple[str, ...] = ("repo_source", "shard"), together: bool = False) -> None:
    """``chunks``: id, repo_source, symbol_name, lexemes, doc_len.  ``occurrences``: repo_source, occurrences (about how many terms
    a repository holds), if that is known.  ``together``: the chunks of a span follow each other already.

    Rows are made where a span's chunks are; one shuffle brings a shard's rows into few files.
    """
    if occurrences is None:
        occurrences = chunks.groupBy("repo_source").agg(F.sum("doc_len").alias("occurrences"))
    slim = chunks.select("id", "repo_source", F.col("doc_len").cast("int").alias("doc_len"), F.lower("symbol_name").alias("symbol"), "lexemes")
    if not together:
        slim = slim.repartition(span_of(F.col("id"))).sortWithinPartitions(span_of(F.col("id")))
    rows = slim.mapInArrow(_blocks, f"term string, repo_source string, span long, best double, posts array<{_POST}>")
    sizes = occurrences.select(F.col("repo_source").alias("repo"), _shards_for(F.coalesce("occurrences", F.lit(0))).alias("shards"))
    rows = rows.join(F.broadcast(sizes), F.col("repo_source").eqNullSafe(F.col("repo")), "left")  # a row a repository
    rows = rows.withColumns({"shard": _shard(F.col("term"), F.coalesce("shards", F.lit(1))), "spread": F.pmod("span", F.lit(8))})
    blocks = rows.repartition("repo_source", "shard", "spread").sortWithinPartitions("repo_source", "shard", "term", "span")
    blocks.select("term", "span", "best", "posts", *parts).write.partitionBy(*parts).parquet(folder)


def replace(chunks: DataFrame, folder: str, repo: str) -> None:
    """Make ``chunks`` the segment of ``repo``; other repositories' segments stay as they are."""
    spark, staged = chunks.sparkSession, f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    try:
        write(chunks.withColumn("repo_source", F.lit(repo)), staged, parts=("shard",))
        rows = spark.read.parquet(staged).limit(1).count() if any("shard=" in f for f in _names(spark, staged)) else 0
        store.swap(spark, folder, repo, staged if rows else f"{staged}-none")
    finally:
        fs, path = store.hadoop(spark, staged)
        fs.delete(path, True)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = store.hadoop(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def covers(spark: SparkSession, folder: str, table: str, repo: str | None = None) -> bool:
    """Whether every repository of the chunk table (or that one) has a segment: one that ingest stored before there was an index has none."""
    stored = {n for n in _names(spark, table) if n.startswith("repo_source=")}
    if repo is not None:
        stored &= {store.folder_of("", repo).lstrip("/")}
    return stored <= set(_names(spark, folder))


def blocks(spark: SparkSession, folder: str, repo: str | None = None) -> DataFrame:
    """All blocks, or those of one repository (other folders are not even listed)."""
    where = folder if repo is None else store.folder_of(folder, repo)
    if not store.exists(spark, where):
        return spark.createDataFrame([], _BLOCKS)
    return spark.read.schema(_BLOCKS).option("basePath", folder).parquet(where)


def _of_terms(found: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks of some terms: the folders that can hold them, and in their files the row groups."""
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | (F.col("shard").isin(shards_of(t)) & (F.col("term") == F.lit(t)))
    return found.filter(wanted)


def _holds(found: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the map of places has the phrase."""
    first = F.try_element_at(found, F.lit(phrase[0]))
    if len(phrase) == 1:
        return first.isNotNull()

    def follows(p: Column) -> Column:
        every = F.lit(True)
        for k, w in enumerate(phrase[1:], 1):
            every = every & F.array_contains(F.try_element_at(found, F.lit(w)), p + k)
        return every

    return F.coalesce(F.exists(first, follows), F.lit(False))


def _matches(query: lexical.Query, holds, excluded: bool = True) -> Column:
    if not query.phrases:
        return F.lit(False)
    result = F.lit(True)
    for phrase in query.phrases:
        result = result & holds(phrase)
    for phrase in query.excluded if excluded else ():
        result = result & ~holds(phrase)
    for other in query.others:
        result = result | _matches(other, holds, excluded)
    return result


def _words(query: lexical.Query) -> set[str]:
    return {w for p in query.phrases + query.excluded for w in p}.union(*(_words(q) for q in query.others))


def _long(query: lexical.Query) -> bool:
    return any(len(p) > 1 for p in query.phrases + query.excluded) or any(_long(q) for q in query.others)


def _bounds(heads: DataFrame, parsed: lexical.Query, name: str, boost: float) -> DataFrame:
    """repo_source, span, bound of the spans that can hold a match."""
    best = {w: f"best{k}" for k, w in enumerate([*sorted(_words(parsed)), name])}
    by_span = heads.groupBy("repo_source", "span").agg(*[F.max(F.when(F.col("term") == w, F.col("best"))).alias(c) for w, c in best.items()])  # of all rows of the term
    has = lambda phrase: F.col(best[phrase[0]]).isNotNull() if len(phrase) == 1 else has(phrase[:1]) & has(phrase[1:])
    match, total = _matches(parsed, has, excluded=False), F.lit(0.0)
    for w in parsed.words:
        total = total + F.coalesce(best[w], F.lit(0.0))
    named = F.col(best[name]).isNotNull()
    bound = F.when(match, total).otherwise(F.lit(0.0)) + F.when(named, F.lit(float(boost))).otherwise(F.lit(0.0))
    return by_span.filter(match | named).select("repo_source", "span", bound.alias("bound"))


def _scored(rows: DataFrame, parsed: lexical.Query, name: str, boost: float) -> DataFrame:
    """id, lexical_score of the chunks in some blocks that match the query or bear its name."""
    places = F.col("p.places") if _long(parsed) else F.array().cast("array<int>")
    posts = rows.select("term", "span", F.explode("posts").alias("p")).select((F.col("span") * SPAN + F.col("p.off")).alias("id"), "term", F.col("p.times").alias("times"), F.col("p.len").alias("doc_len"), places.alias("places"))
    is_name = F.col("term") == F.lit(name)
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(~is_name, F.struct("term", c))))
    by_id = posts.groupBy("id").agg(entry("times").alias("times"), entry("places").alias("found"), F.max("doc_len").alias("doc_len"), F.max(is_name).alias("named"))
    hits = F.lit(0)
    for w in parsed.words:
        hits = hits + F.coalesce(F.try_element_at("times", F.lit(w)), F.lit(0))
    match = _matches(parsed, lambda phrase: _holds(F.col("found"), phrase))
    score = F.when(match, _weight(hits, F.col("doc_len"))).otherwise(F.lit(0.0)) + F.when(F.col("named"), F.lit(float(boost))).otherwise(F.lit(0.0))
    return by_id.filter(match | F.col("named")).select("id", score.alias("lexical_score"))


def lexical_leg(spark: SparkSession, folder: str, query: str, limit: int, boost: float, stem=None, repo: str | None = None) -> DataFrame:
    """id, lexical_score, lexical_rank of indexed chunks that match the query or bear its name."""
    parsed, name = lexical.parse_query(query, stem or (lambda w: w)), "=" + query.strip(" ").lower()
    rows = _of_terms(blocks(spark, folder, repo), [*sorted(_words(parsed)), name])
    bounds = _bounds(rows.select("repo_source", "span", "term", "best"), parsed, name, boost)
    ahead = bounds.orderBy(F.desc("bound"), "repo_source", "span").limit(FIRST_SPANS + 1).collect()
    top = lambda df: df.orderBy(F.desc("lexical_score"), "id").limit(limit)
    best = top(_scored(rows.filter(F.col("span").isin([r["span"] for r in ahead[:FIRST_SPANS]])), parsed, name, boost))
    if len(ahead) > FIRST_SPANS:
        held = best.collect()  # ``limit`` rows
        last = held[-1]["lexical_score"] if len(held) == limit else float("-inf")
        if ahead[-1]["bound"] >= last - 1e-9:
            best = top(_scored(rows.join(bounds.filter(F.col("bound") >= last - 1e-9), "span", "left_semi"), parsed, name, boost))
        else:
            best = spark.createDataFrame(held, best.schema)
    return best.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc("lexical_score"), "id")).cast("long"))
