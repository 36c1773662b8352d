"""Catalogue of the library's queries and of the DuckDB SQL that states the same results.

The tables of the driver stand in for a chunk table: ``documents`` joined with ``embeddings`` on the id
gives chunks with vectors; line spans, citations and messages that the tables lack are derived from
ids with the same arithmetic on both sides.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import lexical, tables, text
from ..model import SearchOptions
from ..operators import ann, chunk_generic, chunking, citations, context, history, index, postings, search, source_window, vector_cache
from ..sources import config, store, walk
from ..streaming import sessions
from ..workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TERMS, SYMBOL, VECTOR = "thre thin", "the", 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- chunks from documents ------------------------------------------------------------------------


def document_chunks(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    d = (table(spark, sf_dir, "documents") if documents is None else documents).withColumn("symbol_name", F.regexp_extract("text", "^([A-Za-z]+)", 1)).withColumn("content", F.col("text")).withColumn("signature", F.lit(None).cast("string"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("repo_source"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file_path"), "symbol_name", F.lit("file").alias("kind"), "signature",
        F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.lit("markdown").alias("language"), "content",
        F.filter(lexical.lexemes(F.col("text")), lambda t: t != "").alias("lexemes"),
    ).withColumn("doc_len", F.size("lexemes"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return document_chunks(spark, sf_dir).join(v, "id")


_indexed: dict[tuple, Workspace] = {}


def _files(df: DataFrame) -> tuple:
    """The files of a table and when they were written: another table under the same path is another key."""
    found = [store.hadoop(df.sparkSession, f) for f in sorted(df.inputFiles())]
    return tuple((path.toString(), fs.getFileStatus(path).getModificationTime()) for fs, path in found)


def lexical_index(spark: SparkSession, sf_dir: str, chunks: Callable[[SparkSession, str], DataFrame]) -> str:
    """Folder of the postings of these chunks: made once a session, as at ingest, and read by every search."""
    documents = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, chunks.__name__, _files(documents), _files(table(spark, sf_dir, "embeddings")))
    if key not in _indexed:
        work, span = Workspace(spark, "postings"), postings.span_of(F.col("doc_id"))
        # Texts meet by spans of ids before they are cut into terms: a file with few row groups is spread, and few rows are made of a span.
        together = documents.withColumn("span", span).repartition("span")
        if chunks is vector_chunks:
            ids = _vectors(spark, sf_dir).groupBy(postings.span_of(F.col("id")).alias("span")).agg(F.collect_set("id").alias("ids"))  # at most SPAN ids
            together = together.join(ids, "span").filter(F.array_contains("ids", F.col("doc_id")))
        sizes = documents.groupBy(F.col("source").alias("repo_source")).agg((F.sum("n_chars") / 6).cast("long").alias("occurrences"))
        postings.write(document_chunks(spark, sf_dir, together.sortWithinPartitions("span")), work.path("index"), occurrences=sizes, together=True)
        _indexed[key] = work
    return _indexed[key].path("index")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR).first()["embedding"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
_CHUNKS = rf"""c AS (SELECT doc_id AS id, source AS repo_source, source || '/' || doc_id || '.md' AS file_path, regexp_extract(text, '^([A-Za-z]+)', 1) AS symbol_name, text AS content,
    list_filter(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda t: t NOT IN ({_STOP})) AS lx FROM documents)"""
_DIST = "1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _legs(words: str, symbol: str, where: str = "true", limit: int = 30) -> str:
    found = " AND ".join(f"list_contains(lx, '{w}')" for w in words.split() if w not in lexical.STOP_WORDS) or "false"
    among = ", ".join(f"'{w}'" for w in words.split())
    exact = f"lower(symbol_name) = '{symbol}'"
    return rf"""{_CHUNKS}, v AS (SELECT c.*, e.embedding FROM c JOIN embeddings e ON c.id = e.vec_id WHERE {where}),
    dense AS (SELECT id, d AS dense_distance, row_number() OVER (ORDER BY d, id) AS dense_rank FROM (SELECT e.id, {_DIST} AS d FROM v e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR}) q ORDER BY d, e.id LIMIT {limit})),
    lex AS (SELECT id, s AS lexical_score, row_number() OVER (ORDER BY s DESC, id) AS lexical_rank FROM (
        SELECT id, CASE WHEN {found} THEN len(list_filter(lx, lambda t: t IN ({among}))) / (1 + ln(greatest(len(lx), 1)::DOUBLE)) ELSE 0 END + CASE WHEN {exact} THEN 1.0 ELSE 0 END AS s FROM v WHERE ({found}) OR {exact} ORDER BY s DESC, id LIMIT {limit}))"""


def _fused(words: str, symbol: str, where: str = "true", dense: str = "1.0", lex: str = "1.0") -> str:
    return f"""WITH {_legs(words, symbol, where)}, f AS (SELECT coalesce(dense.id, lex.id) AS id, dense_rank, dense_distance, lexical_rank, lexical_score,
        coalesce({dense} / (60 + dense_rank), 0) + coalesce({lex} / (60 + lexical_rank), 0) AS fused_score FROM dense FULL OUTER JOIN lex ON dense.id = lex.id ORDER BY fused_score DESC, id LIMIT 10)
    SELECT f.id, v.file_path, dense_rank, lexical_rank, round(dense_distance, 6) AS dense_distance, round(lexical_score, 6) AS lexical_score, round(fused_score, 6) AS fused_score FROM f JOIN v ON f.id = v.id"""


def _hybrid(spark: SparkSession, sf_dir: str, words: str, options: SearchOptions) -> DataFrame:
    found = search.hybrid_search(vector_chunks(spark, sf_dir), query_vector(spark, sf_dir), words, options, lexical_index=lexical_index(spark, sf_dir, vector_chunks))
    return rounded(found.select("id", "file_path", "dense_rank", "lexical_rank", "dense_distance", "lexical_score", "fused_score"), "dense_distance", "lexical_score", "fused_score")


@query(_fused(TERMS, TERMS))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, TERMS, SearchOptions())


@query(_fused(TERMS, TERMS, dense="2.0", lex="0.5"))
def hybrid_rrf_weighted(spark, sf_dir):
    return _hybrid(spark, sf_dir, TERMS, SearchOptions(dense_weight=2.0, lexical_weight=0.5))


@query(_fused("thin", "thin", where="repo_source = 'src3'"))
def hybrid_repo_scoped(spark, sf_dir):
    return _hybrid(spark, sf_dir, "thin", SearchOptions(repo_source="src3"))


@query(_fused(SYMBOL, SYMBOL))
def symbol_boost(spark, sf_dir):
    return _hybrid(spark, sf_dir, SYMBOL, SearchOptions())


@query(f"WITH {_legs(TERMS, TERMS)} SELECT id, round(dense_distance, 6) AS dense_distance, dense_rank FROM dense")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "id")
    return rounded(search.dense_leg(v, query_vector(spark, sf_dir), model.PER_LEG_LIMIT), "dense_distance")


# --- nearest neighbours by an index of cells ------------------------------------------------------

_cells: dict[tuple, tuple[Workspace, ann.Index]] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> ann.Index:
    """The index of all vectors, made once a session."""
    vectors = _vectors(spark, sf_dir)
    key = (spark.sparkContext.applicationId, _files(vectors))
    if key not in _cells:
        work = Workspace(spark, "cells")
        _cells[key] = work, ann.build(vectors, work.path("index"))
    return _cells[key][1]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_NEAR = f"SELECT id, round(d, 6) AS dense_distance, row_number() OVER (ORDER BY d, id) AS dense_rank FROM (SELECT e.vec_id AS id, {_DIST} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR}) q ORDER BY d, id LIMIT 30)"


@query(_NEAR)
def ann_topk(spark, sf_dir):
    """One query through the index, read on until no cell can hold a nearer row."""
    return rounded(ann.nearest(spark, vector_index(spark, sf_dir), query_vector(spark, sf_dir), model.PER_LEG_LIMIT, exact=True), "dense_distance")


@query(f"SELECT query_id, id, rank::INT AS rank, round(d, 6) + 0.0 AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 30")
def ann_neighbours(spark, sf_dir):
    return rounded(ann.search_all(vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), model.PER_LEG_LIMIT, exact=True), "distance").withColumn("distance", F.col("distance") + 0.0)


@query("SELECT count(*)::BIGINT AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, sf_dir):
    """The approximate search, by codes of the nearest cells, against all distances: is its recall at 30 at least 0.9?"""
    asked = _vector_queries(spark, sf_dir)
    found = ann.search_all(vector_index(spark, sf_dir), asked, model.PER_LEG_LIMIT)
    truth = ann.brute_force(_vectors(spark, sf_dir), asked, model.PER_LEG_LIMIT)
    return ann.recall(found, truth).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"WITH {_legs(TERMS, TERMS)}, w AS (SELECT * FROM c), l AS (SELECT id, len(list_filter(lx, lambda t: t IN ('thre', 'thin'))) / (1 + ln(greatest(len(lx), 1)::DOUBLE)) AS s FROM w WHERE list_contains(lx, 'thre') AND list_contains(lx, 'thin') ORDER BY s DESC, id LIMIT 30) SELECT id, round(s, 6) AS lexical_score, row_number() OVER (ORDER BY s DESC, id) AS lexical_rank FROM l")
def lexical_topk(spark, sf_dir):
    return rounded(postings.lexical_leg(spark, lexical_index(spark, sf_dir, document_chunks), TERMS, model.PER_LEG_LIMIT, model.SYMBOL_BOOST), "lexical_score")


@query(f"WITH {_legs(TERMS, TERMS)}, w AS (SELECT * FROM c), l AS (SELECT id, len(list_filter(lx, lambda t: t IN ('thre', 'thin'))) / (1 + ln(greatest(len(lx), 1)::DOUBLE)) AS s FROM w WHERE list_contains(lx, 'thre') AND list_contains(lx, 'thin') ORDER BY s DESC, id LIMIT 30) SELECT id, round(s, 6) AS lexical_score, row_number() OVER (ORDER BY s DESC, id) AS lexical_rank FROM l")
def lexical_topk_scan(spark, sf_dir):
    """The same leg without an index, by a scan of all texts."""
    return rounded(search.lexical_leg(document_chunks(spark, sf_dir), TERMS, model.PER_LEG_LIMIT, model.SYMBOL_BOOST), "lexical_score")


@query("WITH t AS (SELECT doc_id AS id, source, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS x FROM documents), l AS (SELECT id, source, list_filter(x, lambda t: t <> '' AND t NOT IN (" + _STOP + ")) AS lx FROM t), p AS (SELECT id, source, unnest(lx) AS term, len(lx) AS n FROM l) SELECT term, id, source AS repo_source, count(*) AS times, any_value(n)::INT AS doc_len FROM p GROUP BY ALL")
def inverted_index(spark, sf_dir):
    """The postings themselves: how often each chunk holds each term."""
    found = postings.blocks(spark, lexical_index(spark, sf_dir, document_chunks)).filter(~F.col("term").startswith("="))
    return found.select("term", "repo_source", "span", F.explode("posts").alias("p")).select("term", (F.col("span") * postings.SPAN + F.col("p.off")).alias("id"), "repo_source", F.col("p.times").cast("long").alias("times"), F.col("p.len").alias("doc_len"))


@query("WITH t AS (SELECT doc_id, lower(text) AS x FROM documents) SELECT doc_id FROM t WHERE list_contains(regexp_extract_all(x, '[a-z0-9\\x{80}-\\x{10FFFF}]+'), 'thin') AND NOT list_contains(regexp_extract_all(x, '[a-z0-9\\x{80}-\\x{10FFFF}]+'), 'thre')")
def lexical_exclusion(spark, sf_dir):
    parsed = lexical.parse_query("thin -thre")
    return document_chunks(spark, sf_dir).filter(lexical.matches(F.col("lexemes"), parsed)).select(F.col("id").alias("doc_id"))


# --- scalar expressions ---------------------------------------------------------------------------


@query("SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens, greatest(0, 2048 - ceil(length(text) / 4.0))::INT AS tokens_left FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"), text.tokens_left("text").alias("tokens_left"))


_NAMES = ["a.ts", "b.PY", "c.md", "d.tar.gz", "noext", ".bashrc", "e.hpp", "f.yml", "package-lock.json", "x.min.js", "logo.png", "g.cxx"]
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES) + 1).cast("int")).alias("name"))


@query(f"""WITH n AS (SELECT doc_id, lower(regexp_extract({_NAME_SQL}[doc_id % {len(_NAMES)} + 1], '^.+(\\.[^.]*)$', 1)) AS ext FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in model.LANGUAGES.items())} ELSE 'unknown' END AS language,
CASE WHEN ext IN ({', '.join(f"'{x}'" for x in model.TSJS_EXTENSIONS)}) THEN 'ts-morph' ELSE 'generic' END AS chunker FROM n""")
def language_classify(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", text.language_of("name").alias("language"), text.route("name").alias("chunker"))


_BINARY = ", ".join(f"'{x}'" for x in model.BINARY_EXTENSIONS)


@query(f"""WITH n AS (SELECT doc_id, n_chars * 400 AS size, {_NAME_SQL}[doc_id % {len(_NAMES)} + 1] AS name FROM documents)
SELECT doc_id, CASE WHEN name IN ({', '.join(f"'{x}'" for x in model.LOCKFILES)}) THEN 'lockfile' WHEN suffix(name, '.min.js') THEN 'minified'
WHEN lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) IN ({_BINARY}) THEN 'binary-extension' WHEN size > 1048576 THEN 'too-large' WHEN doc_id % 7 = 0 THEN 'binary-content' END AS skip_reason FROM n""")
def skip_rules(spark, sf_dir):
    head = F.when(F.col("doc_id") % 7 == 0, F.lit(b"hi\x00bye")).otherwise(F.lit(b"hi0bye"))
    return _names(spark, sf_dir).select("doc_id", walk.skip_reason(F.col("name"), F.col("n_chars") * 400, head).alias("skip_reason"))


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("generic").alias("chunker_kind"), F.concat(F.lit("docs/"), F.col("doc_id") % 50, F.lit(".md")).alias("file_path"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s"), F.col("doc_id") % 9)).alias("symbol_name"), F.lit("block").alias("kind"), F.lit(None).cast("string").alias("parent_symbol"), F.when(F.col("doc_id") % 4 == 0, F.lit("")).alias("signature"), F.when(F.col("doc_id") % 5 == 0, F.lit("/** d */")).alias("js_doc"), F.lit(1).alias("part_index"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.lit("markdown").alias("language"), F.col("text").alias("content"))


_RECORDS = "r AS (SELECT doc_id, 'docs/' || (doc_id % 50) || '.md' AS file_path, CASE WHEN doc_id % 3 = 0 THEN 's' || (doc_id % 9) END AS symbol_name, CASE WHEN doc_id % 5 = 0 THEN '/** d */' END AS js_doc, len(string_split(text, chr(10))) AS end_line, text AS content FROM documents)"


@query(f"WITH {_RECORDS} SELECT doc_id, sha256('generic' || chr(0) || file_path || chr(0) || coalesce(symbol_name, '') || chr(0) || '1' || chr(0) || content) AS content_hash FROM r")
def content_hash(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", text.content_hash().alias("content_hash"))


@query(f"WITH {_RECORDS} SELECT doc_id, md5('file: ' || file_path || chr(10) || 'kind: block' || CASE WHEN symbol_name <> '' THEN chr(10) || 'symbol: ' || symbol_name ELSE '' END || CASE WHEN js_doc <> '' THEN chr(10) || 'jsDoc: ' || js_doc ELSE '' END || chr(10) || chr(10) || content) AS embed_text_md5 FROM r")
def embed_text(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", F.md5(text.embed_text()).alias("embed_text_md5"))


@query(f"WITH {_RECORDS} SELECT doc_id, md5('--- ' || file_path || ':1-' || end_line || CASE WHEN symbol_name <> '' THEN ' (' || symbol_name || ')' ELSE '' END || ' [markdown] ---' || chr(10) || content) AS block_md5 FROM r")
def context_block(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", F.md5(text.context_block()).alias("block_md5"))


_MESSAGES = ["quota exceeded: 429", "RESOURCE_EXHAUSTED PerDay limit", 'status 429 {"retryDelay": "1.5s"}', "bad request", "resource_exhausted perminute", 'code 429 "retryDelay" : "37s" x', '429 retryDelay: 5s', '429 "retryDelay":"2"']
_MESSAGE_SQL = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "]"


@query(f"""WITH m AS (SELECT event_id, {_MESSAGE_SQL}[event_id % {len(_MESSAGES)} + 1] AS msg FROM events), k AS (SELECT *, nullif(regexp_extract(msg, '"retryDelay"\\s*:\\s*"(\\d+(?:\\.\\d+)?)s"', 1), '') AS sec FROM m)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'aborted' WHEN NOT regexp_matches(msg, '(?i)429|RESOURCE_EXHAUSTED') THEN 'other' WHEN regexp_matches(msg, '(?i)PerDay') THEN 'daily-quota' ELSE 'rate-limit' END AS kind,
ceil(sec::DOUBLE * 1000)::BIGINT AS retry_ms, least(coalesce(ceil(sec::DOUBLE * 1000), 500 * pow(2.0, event_id % 12) + 250), 65000)::DOUBLE AS wait_ms FROM k""")
def error_classify(spark, sf_dir):
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    name = F.when(F.col("event_id") % 11 == 0, "AbortError").otherwise("Error")
    hint = text.retry_delay_ms(message)
    return table(spark, sf_dir, "events").select("event_id", text.error_class(name, message).alias("kind"), hint.alias("retry_ms"), text.backoff_ms((F.col("event_id") % 12).cast("int"), hint, F.lit(0.5)).alias("wait_ms"))


@query("SELECT event_id, 'data: {\"type\":\"' || event_type || '\",\"id\":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.sse_frame(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("frame"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place, '{\"t\":\"' || event_type || '\"}' AS event FROM events")
def sse_parse(spark, sf_dir):
    from ..streaming.answer import parse_frame_table

    frames = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(F.lit('data: {"t":"'), x["event_type"], F.lit('"}\n\n')))
    streams = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.array_join(frames, ""), F.lit("data: {cut")).alias("buffer"))
    return parse_frame_table(streams, "user_id", "buffer")


# --- sessions as a stateful stream ----------------------------------------------------------------


def _sessions(spark, sf_dir):
    """The conversations as received event streams, cut into reads that arrive over three batches and not in order."""
    frame = F.concat(F.when(F.col("turn") % 3 == 1, ": ping\n\n").otherwise(""), text.sse_frame(F.struct(F.lit("token").alias("type"), "text")))
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("frame")))), lambda t: t["frame"]), "")
    end = F.when(F.col("conv_id") % 3 == 0, 'data: {"type":"done"}\n\ndata: {"type":"token","text":"late"}\n\n').otherwise('data: {"type":"tok')
    streams = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("text")).select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.concat("text", end).alias("text"))
    work = Workspace(spark, "sessions")
    reads = work.table(sessions.cut(streams, 400), "cut")
    for k in range(3):
        reads.filter(F.pmod(F.xxhash64("session_id", "seq"), F.lit(3)) == k).write.mode("append").parquet(work.path("reads"))
    clock = spark.range(2, numPartitions=1).select(F.lit("clock").alias("session_id"), F.col("id").cast("int").alias("seq"), F.timestamp_seconds(F.lit(1_700_003_600)).alias("ts"), F.lit(": ping\n\n").alias("piece"))
    clock.write.mode("append").parquet(work.path("reads"))
    files = len(spark.read.parquet(work.path("reads")).inputFiles())
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", max(1, (files - 1) // 3)).parquet(work.path("reads"))
    sessions.run(stream, work.path("events"), work.path("checkpoint"))
    return spark.read.schema("session_id string, place int, type string, event string").parquet(work.path("events")).filter("session_id <> 'clock'")


_SESSIONS = """WITH t AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text FROM conversations),
e AS (SELECT session_id, place, 'token' AS type, coalesce(text, '') AS text FROM t UNION ALL SELECT conv_id::VARCHAR, count(*), CASE WHEN conv_id % 3 = 0 THEN 'done' ELSE 'cancelled' END, NULL FROM conversations GROUP BY conv_id)"""


@query(f"{_SESSIONS} SELECT session_id, place::INT AS place, type, md5(text) AS text_md5 FROM e")
def session_events(spark, sf_dir):
    said = F.coalesce(F.get_json_object("event", "$.text"), F.when(F.col("type") == "token", F.lit("")))
    return _sessions(spark, sf_dir).select("session_id", "place", "type", F.md5(said).alias("text_md5"))


@query(f"{_SESSIONS} SELECT session_id, max(type) FILTER (type <> 'token') AS status, md5(string_agg(text, '' ORDER BY place)) AS text_md5, count(*)::INT AS events FROM e GROUP BY session_id")
def session_states(spark, sf_dir):
    return sessions.states(_sessions(spark, sf_dir)).select("session_id", "status", F.md5("text").alias("text_md5"), "events")


# --- chunking -------------------------------------------------------------------------------------


@query("SELECT doc_id, part_index::INT AS part_index, len(ls)::INT AS part_total, ls[part_index] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(part_index)")
def line_explode(spark, sf_dir):
    return chunking.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, 1::BIGINT AS k, 1::BIGINT AS s, length(ls[1])::BIGINT AS held FROM l
 UNION ALL SELECT doc_id, ls, k + 1, CASE WHEN held + 1 + length(ls[k + 1]) > 400 THEN k + 1 ELSE s END, CASE WHEN held + 1 + length(ls[k + 1]) > 400 THEN length(ls[k + 1]) ELSE held + 1 + length(ls[k + 1]) END FROM w WHERE k < len(ls))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s))::INT AS part_index, (count(*) OVER (PARTITION BY doc_id))::INT AS part_total, s::INT AS start_line, max(k)::INT AS end_line, array_to_string(any_value(ls)[s:max(k)], chr(10)) AS content FROM w GROUP BY doc_id, s""")
def line_windows(spark, sf_dir):
    return chunking.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 100)


_SIGNS = "\"'`/\\{}@"  # what opens strings, comments, blocks and decorators


def _braced(spark, sf_dir):
    """Texts of odd ids with blocks put in: nested, unbalanced, some with a definition in the first line."""
    plain = F.translate("text", _SIGNS, "")
    nested = F.replace(F.replace(plain, F.lit(" e"), F.lit(" {\n e")), F.lit(" s"), F.lit("\n}\nfunction s"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 1, nested).otherwise(plain).alias("text"))


_BLANK = "' \t' || chr(10)"
_BRACED = f"""p AS (SELECT doc_id, translate(text, '{_SIGNS.replace("'", "''")}', '') AS t FROM documents),
d AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 1 THEN replace(replace(t, ' e', ' {{' || chr(10) || ' e'), ' s', chr(10) || '}}' || chr(10) || 'function s') ELSE t END, chr(10)) AS ls FROM p),
l AS (SELECT doc_id, k, ls[k] AS line, CASE WHEN ls[k] LIKE '%{{' THEN 1 WHEN ls[k] = '}}' THEN -1 ELSE 0 END AS step FROM d, unnest(range(1, len(ls) + 1)) t(k)),
h AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY k) AS height FROM l),
v AS (SELECT *, height - least(0, min(height) OVER (PARTITION BY doc_id ORDER BY k)) AS depth FROM h),
z AS (SELECT *, depth = 0 AND lag(depth, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) = 1 AS closes FROM v),
c AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM z),
g AS (SELECT doc_id, min(k)::INT AS start_line, max(k)::INT AS end_line, string_agg(line, chr(10) ORDER BY k) AS content, bool_or(closes) AS closed FROM c GROUP BY doc_id, block),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS n, start_line, end_line, content FROM g WHERE closed OR trim(content, {_BLANK}) <> '')"""


@query(f"WITH {_BRACED} SELECT doc_id, n::INT AS part_index, (count(*) OVER (PARTITION BY doc_id))::INT AS part_total, start_line, end_line, content FROM blocks")
def brace_blocks(spark, sf_dir):
    return chunking.spans(_braced(spark, sf_dir), "doc_id", "text", chunk_generic.brace_blocks)


@query(f"""WITH RECURSIVE {_BRACED},
m AS (SELECT doc_id, n, 1 AS run, start_line AS s, end_line AS e, content AS t FROM blocks WHERE n = 1
 UNION ALL SELECT b.doc_id, b.n, run + (length(t) > {4 * (model.MIN_CHUNK_TOKENS - 1)})::INT, CASE WHEN length(t) > {4 * (model.MIN_CHUNK_TOKENS - 1)} THEN b.start_line ELSE s END, b.end_line, CASE WHEN length(t) > {4 * (model.MIN_CHUNK_TOKENS - 1)} THEN b.content ELSE t || chr(10) || b.content END FROM m JOIN blocks b ON b.doc_id = m.doc_id AND b.n = m.n + 1),
q AS (SELECT doc_id, run, max_by(s, n) AS s, string_split(max_by(t, n), chr(10)) AS ls FROM m GROUP BY doc_id, run),
y AS (SELECT *, regexp_extract(trim(list_filter(ls, lambda x: trim(x, ' \t') <> '')[1], ' \t'), '{chunk_generic.DEFINITION.pattern}', 1) AS symbol FROM q),
w AS (SELECT doc_id, run, s, ls, symbol, 1::BIGINT AS k, 1::BIGINT AS a, length(ls[1])::BIGINT AS held FROM y
 UNION ALL SELECT doc_id, run, s, ls, symbol, k + 1, CASE WHEN held + 1 + length(ls[k + 1]) > {4 * model.MAX_CHUNK_TOKENS} THEN k + 1 ELSE a END, CASE WHEN held + 1 + length(ls[k + 1]) > {4 * model.MAX_CHUNK_TOKENS} THEN length(ls[k + 1]) ELSE held + 1 + length(ls[k + 1]) END FROM w WHERE k < len(ls)),
o AS (SELECT doc_id || '.md' AS file_path, run, any_value(symbol) AS symbol, any_value(s) + a - 1 AS start_line, any_value(s) + max(k) - 1 AS end_line, array_to_string(any_value(ls)[a:max(k)], chr(10)) AS content FROM w GROUP BY doc_id, run, a),
i AS (SELECT *, row_number() OVER (PARTITION BY file_path, run ORDER BY start_line) AS part_index, count(*) OVER (PARTITION BY file_path, run) AS part_total FROM o)
SELECT file_path, nullif(symbol, '') AS symbol_name, start_line::INT AS start_line, end_line::INT AS end_line, part_index::INT AS part_index, part_total::INT AS part_total, sha256('generic' || chr(0) || file_path || chr(0) || symbol || chr(0) || part_index || chr(0) || content) AS content_hash FROM i""")
def generic_chunks(spark, sf_dir):
    files = _braced(spark, sf_dir).select(F.concat("doc_id", F.lit(".md")).alias("file_path"), F.col("text").alias("source"))
    return chunking.explode_chunks(chunking.chunk_files(files)).select("file_path", "symbol_name", "start_line", "end_line", "part_index", "part_total", "content_hash")


@query(ORACLES["generic_chunks"])
def lateral_chunks(spark, sf_dir):
    """The chunker as a table function of SQL."""
    tables.register(spark)
    files = _braced(spark, sf_dir).select(F.concat("doc_id", F.lit(".md")).alias("path"), F.col("text").alias("source"))
    found = spark.sql("SELECT c.* FROM {files} f, LATERAL chunks(f.path, f.source) c", files=files)
    return found.withColumn("content_hash", text.content_hash()).select("file_path", "symbol_name", "start_line", "end_line", "part_index", "part_total", "content_hash")


@query(ORACLES["line_windows"])
def lateral_windows(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, w.* FROM {documents} d, LATERAL windows(d.text, 100) w", documents=table(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, k, ls[k] AS line, trim(ls[k], ' \t') <> '' AND NOT regexp_matches(ls[k], '^[ \\t]') AS top FROM l, unnest(range(1, len(ls) + 1)) t(k)),
b AS (SELECT doc_id, k, line, greatest(sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k), 1) AS block FROM u),
g AS (SELECT doc_id, min(k)::INT AS start_line, max(k)::INT AS end_line, string_agg(line, chr(10) ORDER BY k) AS content FROM b GROUP BY doc_id, block)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_line))::INT AS part_index, (count(*) OVER (PARTITION BY doc_id))::INT AS part_total, start_line, end_line, content FROM g WHERE trim(content, ' \t' || chr(10)) <> ''""")
def indent_blocks(spark, sf_dir):
    return chunking.spans(table(spark, sf_dir, "documents"), "doc_id", "text", chunk_generic.indent_blocks)


@query()
def tsjs_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("/** doc */\nexport function f"), "doc_id", F.lit("(a: number): string {\n  return `"), F.regexp_replace("text", r"[`\\$]", ""), F.lit("`;\n}\nexport class C"), "doc_id", F.lit(" { m() { return 1; } }\n"))
    files = d.select(F.concat("doc_id", F.lit(".ts")).alias("file_path"), source.alias("source"))
    return chunking.explode_chunks(chunking.chunk_files(files)).select("file_path", "symbol_name", "kind", "signature", "js_doc", "start_line", "end_line", "part_index", "part_total", "is_exported")


#: Files of seven forms; ID is the document's id, BODY its text with anything but letters as blanks.
_FORMS = [
    "/** doc */\nexport function fID(a: number): string {\n  return `BODY`;\n}\n",
    "import { x } from './x';\n\n/** C doc */\nexport class CID {\n  /** m doc */\n  mID(a: number): number {\n    // BODY\n    return a;\n  }\n}\n",
    "export interface IID {\n  a: string;\n}\n// BODY\nexport type TID = string | number;\n",
    "export enum EID {\n  A,\n  B, // BODY\n}\nexport const gID = (a: number) => {\n  return \"BODY\";\n};\n",
    "export * from './aID';\nfunction hID() {\n  return 'BODY';\n}\n",
    "// BODY\nconsole.log('BODY');\n",
    "export function brokenID( {\n  return 'BODY';\n",
]
_FORM_SQL = "[" + ", ".join("'" + f.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for f in _FORMS) + "]"
_BIG = 4 * model.MAX_CHUNK_TOKENS


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS id, doc_id % 7 AS form, regexp_replace(text, '[^A-Za-z]', ' ', 'g') AS b FROM documents),
f AS (SELECT id, form, b, string_split(replace(replace({_FORM_SQL}[form + 1], 'ID', id::VARCHAR), 'BODY', b), chr(10)) AS ls FROM d),
one AS (SELECT id, 'function' AS kind, 'f' || id AS symbol_name, 'export function f' || id || '(a: number): string' AS signature, '/** doc */' AS js_doc, NULL::VARCHAR AS parent_symbol, true AS is_exported, ls, 2 AS s, 4 AS e, 3 AS s2, 3 AS e2 FROM f WHERE form = 0
 UNION ALL SELECT id, 'function', 'h' || id, 'function h' || id || '()', NULL::VARCHAR, NULL::VARCHAR, false, ls, 2, 4, 3, 3 FROM f WHERE form = 4
 UNION ALL SELECT id, 'interface', 'I' || id, 'export interface I' || id, NULL::VARCHAR, NULL::VARCHAR, true, ls, 1, 3, 1, 3 FROM f WHERE form = 2
 UNION ALL SELECT id, 'type-alias', 'T' || id, 'export type T' || id || ' = string | number', NULL::VARCHAR, NULL::VARCHAR, true, ls, 5, 5, 5, 5 FROM f WHERE form = 2
 UNION ALL SELECT id, 'enum', 'E' || id, 'export enum E' || id || ' {{ A, B }}', NULL::VARCHAR, NULL::VARCHAR, true, ls, 1, 4, 1, 4 FROM f WHERE form = 3
 UNION ALL SELECT id, 'const', 'g' || id, 'const g' || id || ' = (a: number) => …', NULL::VARCHAR, NULL::VARCHAR, true, ls, 5, 7, 5, 7 FROM f WHERE form = 3),
single AS (SELECT id, kind, symbol_name, signature, js_doc, parent_symbol, is_exported, CASE WHEN big THEN s2 ELSE s END AS start_line, CASE WHEN big THEN e2 ELSE e END AS end_line, 1 AS part_index, 1 AS part_total, array_to_string(CASE WHEN big THEN ls[s2:e2] ELSE ls[s:e] END, chr(10)) AS content
 FROM (SELECT *, length(array_to_string(ls[s:e], chr(10))) > {_BIG} AS big FROM one)),
c AS (SELECT *, length(array_to_string(ls[4:10], chr(10))) > {_BIG} AS big FROM f WHERE form = 1),
class AS (SELECT id, 'class', 'C' || id, 'export class C' || id, '/** C doc */', NULL::VARCHAR, true, 4, CASE WHEN big THEN 4 ELSE 10 END, 1, CASE WHEN big THEN 2 ELSE 1 END, array_to_string(CASE WHEN big THEN ls[4:4] ELSE ls[4:10] END, chr(10)) FROM c
 UNION ALL SELECT id, 'method', 'm' || id, 'm' || id || '(a: number): number', '/** m doc */', 'C' || id, true, 6, 9, 2, 2, ltrim(array_to_string(ls[6:9], chr(10))) FROM c WHERE big),
w AS (SELECT id, form, ls, 1::BIGINT AS k, 1::BIGINT AS s, length(ls[1])::BIGINT AS held FROM f WHERE form > 4
 UNION ALL SELECT id, form, ls, k + 1, CASE WHEN held + 1 + length(ls[k + 1]) > {_BIG} THEN k + 1 ELSE s END, CASE WHEN held + 1 + length(ls[k + 1]) > {_BIG} THEN length(ls[k + 1]) ELSE held + 1 + length(ls[k + 1]) END FROM w WHERE k < len(ls)),
g AS (SELECT id, form, any_value(ls) AS ls, s, max(k) AS e FROM w GROUP BY id, form, s),
whole AS (SELECT id, CASE WHEN form = 5 THEN 'file' ELSE 'window' END, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false, s, CASE WHEN form = 5 AND n = 1 THEN 2 ELSE e END, row_number() OVER (PARTITION BY id ORDER BY s), n, array_to_string(ls[s:e], chr(10)) FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM g)),
every AS (SELECT * FROM single UNION ALL SELECT * FROM class UNION ALL SELECT * FROM whole)
SELECT id || '.ts' AS file_path, kind, symbol_name, signature, js_doc, parent_symbol, is_exported, start_line::INT AS start_line, end_line::INT AS end_line, part_index::INT AS part_index, part_total::INT AS part_total, md5(content) AS content_md5 FROM every""")
def tsjs_declarations(spark, sf_dir):
    """Every kind of declaration, files without one and files with an error, of all documents; what is over the budget is split."""
    d = table(spark, sf_dir, "documents").withColumn("form", F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("doc_id") % 7 + 1).cast("int")))
    source = F.replace(F.replace("form", F.lit("ID"), F.col("doc_id").cast("string")), F.lit("BODY"), F.regexp_replace("text", "[^A-Za-z]", " "))
    files = d.select(F.concat("doc_id", F.lit(".ts")).alias("file_path"), source.alias("source"))
    found = chunking.explode_chunks(chunking.chunk_files(files))
    return found.select("file_path", "kind", "symbol_name", "signature", "js_doc", "parent_symbol", "is_exported", "start_line", "end_line", "part_index", "part_total", F.md5("content").alias("content_md5"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'failed' WHEN n_chars % 5 = 1 THEN 'degraded' WHEN n_chars % 5 = 2 THEN 'no-declarations' ELSE 'chunked' END AS outcome, doc_id % 13 = 0 AS skipped FROM documents)
SELECT count(*) FILTER (NOT skipped)::BIGINT AS files_seen, count(*) FILTER (NOT skipped AND outcome = 'chunked')::BIGINT AS files_chunked, count(*) FILTER (NOT skipped AND outcome = 'degraded')::BIGINT AS files_degraded,
count(*) FILTER (NOT skipped AND outcome = 'no-declarations')::BIGINT AS no_declarations, count(*) FILTER (NOT skipped AND outcome = 'failed')::BIGINT AS files_failed, count(*) FILTER (skipped)::BIGINT AS files_skipped FROM f""")
def ingest_report(spark, sf_dir):
    kind = F.col("n_chars") % 5
    outcome = F.when(kind == 0, "failed").when(kind == 1, "degraded").when(kind == 2, "no-declarations").otherwise("chunked")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), outcome.alias("outcome"), F.lit("e").alias("error"), F.array().alias("chunks"))
    report = chunking.ingest_report(rows.filter("doc_id % 13 <> 0"), rows.filter("doc_id % 13 = 0"))
    return report.drop("failures", "commit_sha", "chunks")


@query("""WITH b AS (SELECT doc_id % 40 AS f, 1 + (doc_id * 7) % 90 AS s, 1 + (doc_id * 7) % 90 + n_chars % 5 AS e FROM documents), c AS (SELECT DISTINCT f, l FROM b, unnest(range(s, e + 1)) t(l))
SELECT 'f' || f AS file_path, 100::INT AS n_lines, (100 - count(*))::BIGINT AS uncovered FROM c GROUP BY f""")
def coverage_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    start = 1 + (F.col("doc_id") * 7) % 90
    blocks = d.select(F.concat(F.lit("f"), F.col("doc_id") % 40).alias("file_path"), start.alias("start_line"), (start + F.col("n_chars") % 5).alias("end_line"))
    return chunking.coverage(blocks, blocks.select("file_path", F.lit(100).alias("n_lines")).distinct())


# --- index ----------------------------------------------------------------------------------------


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("t"), "doc_id").alias("embed_text"))


@query("SELECT sha256(text) AS content_hash, 't' || min(doc_id) AS embed_text, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def hash_dedupe(spark, sf_dir):
    return index.distinct_contents(_hashed(spark, sf_dir))


_CACHED = "h AS (SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text)"


def _cache(hashed: DataFrame) -> DataFrame:
    """Every third distinct content is cached, some of them for another model."""
    firsts = hashed.groupBy("content_hash").agg(F.min("seq").alias("first")).filter("first % 3 = 0")
    return firsts.select("content_hash", F.when(F.col("first") % 2 == 0, "m").otherwise("old").alias("model"), F.array(F.lit(1.0).cast("float")).alias("vector"))


@query(f"WITH {_CACHED} SELECT content_hash, first % 3 = 0 AND first % 2 = 0 AS hit FROM h")
def cache_hit_miss(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    return index.with_cache(index.distinct_contents(hashed), _cache(hashed), "m").select("content_hash", F.col("vector").isNotNull().alias("hit"))


@query(f"WITH {_CACHED} SELECT content_hash, CASE WHEN first % 3 = 0 THEN 'new' ELSE 'old' END AS model, CASE WHEN first % 3 = 0 THEN first * 2.0 ELSE first END::DOUBLE AS value FROM h")
def cache_upsert(spark, sf_dir):
    """The bucketed cache after two runs: one row a hash, the later model's."""
    work = Workspace(spark, "cache")
    firsts = work.table(_hashed(spark, sf_dir).groupBy("content_hash").agg(F.min("seq").alias("first")), "firsts")
    made = lambda rows, name, scale: rows.select("content_hash", F.lit(name).alias("model"), F.array((F.col("first") * scale).cast("float")).alias("vector"))
    vector_cache.append(made(firsts, "old", 1), work.path("vectors"))
    vector_cache.append(made(firsts.filter("first % 3 = 0"), "new", 2), work.path("vectors"))
    return vector_cache.read(spark, work.path("vectors")).select("content_hash", "model", F.col("vector")[0].cast("double").alias("value"))


@query("SELECT sha256(text) AS content_hash, 8 AS size FROM documents GROUP BY text")
def embed_under_quota(spark, sf_dir):
    """Every distinct content embedded by two barrier tasks that share a quota."""
    made = index.embed_contents(index.distinct_contents(_hashed(spark, sf_dir)), index.HashingEmbedder(8), 8, tasks=2, per_minute=5_000_000, minute=0.01)
    return made.select("content_hash", F.size("vector").alias("size"))


@query(f"WITH {_CACHED} SELECT sum(copies)::BIGINT AS total_chunks, count(*)::BIGINT AS unique_hashes, count(*) FILTER (first % 6 = 0)::BIGINT AS cache_hits, count(*) FILTER (first % 6 <> 0)::BIGINT AS embedded FROM h")
def index_report(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    known = index.with_cache(index.distinct_contents(hashed), _cache(hashed), "m")
    return known.agg(F.sum("copies").alias("total_chunks"), F.count("*").alias("unique_hashes"), F.count("vector").alias("cache_hits"), F.count(F.when(F.col("vector").isNull(), 1)).alias("embedded"))


@query(f"WITH {_CACHED} SELECT doc_id AS seq, sha256(text) AS content_hash FROM documents WHERE sha256(text) IN (SELECT content_hash FROM h WHERE first % 6 = 0)")
def vector_fanout(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    return index.attach(hashed, _cache(hashed).filter("model = 'm'")).select("seq", "content_hash")


@query("SELECT source, count(*)::BIGINT AS rows_before, count(DISTINCT text)::BIGINT AS inserted FROM documents GROUP BY source")
def replace_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kept = store.first_wins(d.select("source", "doc_id", F.sha2("text", 256).alias("content_hash")), ["source", "content_hash"], ["doc_id"])
    return d.groupBy("source").agg(F.count("*").alias("rows_before")).join(kept.groupBy("source").agg(F.count("*").alias("inserted")), "source")


@query("WITH e AS (SELECT 'm' || p_size AS name FROM part), a AS (SELECT 'm' || o_custkey % 60 AS name FROM orders WHERE o_custkey % 60 % 7 <> 3) SELECT DISTINCT name FROM e WHERE name NOT IN (SELECT name FROM a)")
def pending_migrations(spark, sf_dir):
    expected = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_size").alias("name")).distinct()
    bucket = F.col("o_custkey") % 60
    applied = table(spark, sf_dir, "orders").filter(bucket % 7 != 3).select(F.concat(F.lit("m"), bucket).alias("name"))
    return config.pending_migrations(expected, applied)


# --- context --------------------------------------------------------------------------------------


def _retrieved(spark, sf_dir):
    """All documents as retrieved rows of many requests (25 neighbouring ids each); a file is a source."""
    d = table(spark, sf_dir, "documents").withColumn("request_id", F.floor(F.col("doc_id") / 25))
    pos = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("n_chars"), "doc_id"))
    return d.select("request_id", pos.alias("pos"), "doc_id", F.concat("source", F.lit(".md")).alias("file_path"), (F.lit(1.0) / (F.lit(60.0) + pos % 7)).alias("fused_score"), F.lit(None).cast("string").alias("symbol_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("markdown").alias("language"), F.col("text").alias("content"))


_PACKED = """WITH r AS (SELECT doc_id // 25 AS request_id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY n_chars DESC, doc_id) AS pos, doc_id, source || '.md' AS file_path, text AS content FROM documents),
s AS (SELECT *, 1.0::DOUBLE / (60 + pos % 7) AS score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY request_id, file_path ORDER BY score DESC, pos) = 1 AS kept, min(pos) OVER (PARTITION BY request_id, file_path) AS fp FROM s),
b AS (SELECT request_id, pos, score, fp, '--- ' || file_path || ':1-9 [markdown] ---' || chr(10) || content AS block FROM k WHERE kept),
p AS (SELECT request_id, pos, block, row_number() OVER w AS place, sum(ceil(length(block) / 4.0)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM b WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, fp)),
t AS (SELECT k.request_id, k.pos, k.doc_id, k.kept, p.place, p.block, coalesce(p.place = 1 OR p.used <= 8000, false) AS included FROM k LEFT JOIN p USING (request_id, pos))"""


@query(f"{_PACKED} SELECT request_id::BIGINT AS request_id, pos::INT AS pos, doc_id, place::INT AS place, kept, included, CASE WHEN NOT kept THEN 'duplicate-file' WHEN NOT included THEN 'budget' END AS dropped_as FROM t")
def trace_included(spark, sf_dir):
    return context.assemble(_retrieved(spark, sf_dir), by=("request_id",)).select("request_id", "pos", "doc_id", "place", "kept", "included", "dropped_as")


@query(f"{_PACKED} SELECT request_id::BIGINT AS request_id, md5(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY place) FILTER (included), '')) AS context_md5, ceil(length(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY place) FILTER (included), '')) / 4.0)::INT AS context_tokens FROM t GROUP BY request_id")
def budget_pack(spark, sf_dir):
    by = ("request_id",)
    return context.context_text(context.assemble(_retrieved(spark, sf_dir), by=by), by=by).select("request_id", F.md5("context_text").alias("context_md5"), "context_tokens")


@query(f"WITH x AS ({_fused(TERMS, TERMS)}) SELECT x.file_path || ':1-' || len(string_split(d.text, chr(10))) AS span, coalesce(dense_rank::VARCHAR, '—') AS dense_rank, coalesce(lexical_rank::VARCHAR, '—') AS lexical_rank, format('{{:.3f}}', fused_score) AS score FROM x JOIN documents d ON d.doc_id = x.id")
def trace_table(spark, sf_dir):
    found = search.hybrid_search(vector_chunks(spark, sf_dir), query_vector(spark, sf_dir), TERMS, SearchOptions())
    return context.trace_table(found)


@query("WITH s AS (SELECT *, 1.0::DOUBLE / (60 + doc_id % 7) AS score FROM documents), k AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS n FROM s) SELECT doc_id FROM k WHERE n = 1")
def best_per_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), "lang").alias("file_path"), (F.lit(1.0) / (60 + F.col("doc_id") % 7)).alias("fused_score"))
    return context.best_per_file(d).filter("kept").select(F.col("pos").alias("doc_id"))


# --- source windows -------------------------------------------------------------------------------


def _spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    start = 1 + (F.col("doc_id") * 13) % 300
    return d.select("doc_id", F.col("lang").alias("repo_source"), F.concat(F.lit("f"), F.col("doc_id") % 25).alias("file_path"), start.alias("start_line"), (start + F.col("n_chars") % 9).alias("end_line"))


def _requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    start = 1 + F.col("c_custkey") % 250
    return c.select(F.col("c_custkey").alias("request_id"), F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("repo_source"), F.concat(F.lit("f"), F.col("c_custkey") % 25).alias("file_path"), start.alias("start_line"), (start + F.when(F.col("c_custkey") % 10 == 0, 1000).otherwise(40)).alias("end_line"))


_SPAN_SQL = """WITH b AS (SELECT doc_id, lang AS repo_source, 'f' || doc_id % 25 AS file_path, 1 + (doc_id * 13) % 300 AS s, 1 + (doc_id * 13) % 300 + n_chars % 9 AS e FROM documents),
q AS (SELECT c_custkey AS request_id, ['en','fr','de','es'][c_custkey % 4 + 1] AS repo_source, 'f' || c_custkey % 25 AS file_path, 1 + c_custkey % 250 AS f, least(1 + c_custkey % 250 + CASE WHEN c_custkey % 10 = 0 THEN 1000 ELSE 40 END, 1 + c_custkey % 250 + 399) AS t FROM customer),
m AS (SELECT q.*, b.doc_id, b.s, b.e FROM q JOIN b USING (repo_source, file_path) WHERE b.e >= q.f AND b.s <= q.t),
l AS (SELECT DISTINCT request_id, f, t FROM m), free AS (SELECT request_id, x FROM l, unnest(range(f, t + 1)) u(x) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.request_id = l.request_id AND x BETWEEN m.s AND m.e)),
g AS (SELECT request_id, min(x) AS start_line, max(x) AS end_line FROM (SELECT request_id, x, x - row_number() OVER (PARTITION BY request_id ORDER BY x) AS k FROM free) GROUP BY request_id, k)"""


@query(f"{_SPAN_SQL} SELECT request_id, doc_id, s AS start_line, e AS end_line FROM m")
def source_range(spark, sf_dir):
    return source_window.blocks_of_all(_spans(spark, sf_dir), _requests(spark, sf_dir)).select("request_id", "doc_id", "start_line", "end_line")


@query(f"{_SPAN_SQL} SELECT request_id, start_line, end_line FROM g")
def source_gaps(spark, sf_dir):
    return source_window.uncovered(_spans(spark, sf_dir), _requests(spark, sf_dir))


@query(f"{_SPAN_SQL} SELECT request_id, s AS start_line, e AS end_line, 'block' AS kind FROM m UNION ALL SELECT request_id, start_line, end_line, 'gap' FROM g")
def blocks_and_gaps(spark, sf_dir):
    return source_window.listing(_spans(spark, sf_dir), _requests(spark, sf_dir))


# --- citations ------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    said = F.concat(F.lit("see src/f"), k % 20, F.lit(".ts:"), 1 + k % 90, F.lit("-"), 5 + k % 90, F.lit(" at 10:30, docs/g"), k % 20, F.lit(".md:"), 1 + k % 50, F.lit(" and src/f"), k % 20, F.lit(".ts:"), 1 + k % 90, F.lit("-"), 5 + k % 90, F.lit("."))
    return d.select("doc_id", said.alias("answer"))


def _included(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), (k + F.when(k % 3 == 0, 1).otherwise(0)) % 20, F.lit(".ts")).alias("file_path"), (k % 60).cast("int").alias("start_line"), (k % 60 + 40).cast("int").alias("end_line"))


_CITED = """WITH a AS (SELECT doc_id, 'src/f' || doc_id % 20 || '.ts' AS f1, (1 + doc_id % 90) AS s1, (5 + doc_id % 90) AS e1, 'docs/g' || doc_id % 20 || '.md' AS f2, (1 + doc_id % 50) AS s2 FROM documents),
c AS (SELECT doc_id, 0 AS place, f1 || ':' || s1 || '-' || e1 AS raw, f1 AS file_path, s1 AS start_line, e1 AS end_line FROM a UNION ALL SELECT doc_id, 1, f2 || ':' || s2, f2, s2, s2 FROM a UNION ALL SELECT doc_id, 2, f1 || ':' || s1 || '-' || e1, f1, s1, e1 FROM a),
k AS (SELECT doc_id, 'src/f' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 20 || '.ts' AS kf, doc_id % 60 AS ks, doc_id % 60 + 40 AS ke FROM documents),
z AS (SELECT c.*, coalesce(kf = file_path AND start_line >= ks AND end_line <= ke, false) AS valid, kf = file_path AS known FROM c JOIN k USING (doc_id))"""


@query(f"{_CITED} SELECT doc_id, place::INT AS place, raw, file_path, start_line::INT AS start_line, end_line::INT AS end_line FROM c")
def citation_parse(spark, sf_dir):
    return citations.parse(_answers(spark, sf_dir), "doc_id", "answer")


@query(f"{_CITED} SELECT doc_id, place::INT AS place, raw, valid, CASE WHEN NOT valid THEN CASE WHEN known THEN 'range-not-retrieved' ELSE 'unknown-file' END END AS reason FROM z")
def citation_validate(spark, sf_dir):
    return citations.validate(citation_parse(spark, sf_dir), _included(spark, sf_dir), "doc_id").select("doc_id", "place", "raw", "valid", "reason")


@query(f"{_CITED} SELECT doc_id, raw, any_value(valid) AS valid FROM z GROUP BY doc_id, raw")
def citation_lookup(spark, sf_dir):
    checked = citations.validate(citation_parse(spark, sf_dir), _included(spark, sf_dir), "doc_id")
    return citations.lookup(checked, "doc_id").select("doc_id", "raw", "valid")


@query(f"{_CITED} SELECT doc_id, place::INT AS place, raw, file_path, start_line::INT AS start_line, end_line::INT AS end_line FROM c")
def lateral_citations(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT a.doc_id, c.* FROM {answers} a, LATERAL citations(a.answer) c", answers=_answers(spark, sf_dir))


@query(f"{_CITED}, p AS (SELECT doc_id, place * 2 + 1 AS place, 'citation' AS type, raw AS text FROM c UNION ALL SELECT doc_id, 0, 'text', 'see ' FROM a UNION ALL SELECT doc_id, 2, 'text', ' at 10:30, ' FROM a UNION ALL SELECT doc_id, 4, 'text', ' and ' FROM a UNION ALL SELECT doc_id, 6, 'text', '.' FROM a) SELECT doc_id, place::INT AS place, type, text FROM p")
def citation_segments(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    checked = citations.validate(citations.parse(answers, "doc_id", "answer"), _included(spark, sf_dir), "doc_id")
    return citations.segments(answers, checked, "doc_id", "answer").select("doc_id", "place", "type", "text")


# --- history --------------------------------------------------------------------------------------


@query("SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return history.last_user_message(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def history_cap(spark, sf_dir):
    return history.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query(f"""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8), u AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS q FROM k)
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role, CASE WHEN turn = q THEN '{model.CONTEXT_MARKER}' || chr(10) || 'ctx ' || conv_id || chr(10) || chr(10) || text ELSE text END AS text FROM u""")
def prompt_contents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    contexts = turns.select("conv_id").distinct().withColumn("context_text", F.concat(F.lit("ctx "), "conv_id"))
    return history.prompt_contents(turns, contexts)


@query("SELECT conv_id, count(*)::INT AS messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_history(spark, sf_dir):
    folded = history.chat_history(table(spark, sf_dir, "conversations"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return folded.select("conv_id", F.size("messages").alias("messages"), F.md5(joined).alias("digest"))
