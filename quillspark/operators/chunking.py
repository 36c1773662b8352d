"""Files to chunks, as tables: one pass over the files, no shuffle; texts are parsed in Arrow batches.

``chunk_files`` keeps one row a file, so the outcome of a file without chunks is not lost; a file
that cannot be read or chunked becomes an error row and the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from . import chunk_generic, chunk_tsjs

_CHUNK_TYPE = pa.list_(pa.struct([
    ("file_path", pa.string()), ("symbol_name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("js_doc", pa.string()),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent_symbol", pa.string()), ("is_exported", pa.bool_()), ("language", pa.string()),
    ("chunker_kind", pa.string()), ("part_index", pa.int32()), ("part_total", pa.int32()), ("content", pa.string()),
]))
#: Text whose spans a worker holds at once, whatever a batch holds; a longer text is taken alone.
SLICE_BYTES = 1 << 20
_CHUNKERS: dict[str, Callable] = {"ts-morph": chunk_tsjs.chunk, "generic": chunk_generic.chunk}


def _chunk(batches: Iterator[pa.RecordBatch], chunkers: dict[str, Callable]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            columns = {name: batch.column(k).slice(at, 64).to_pylist() for k, name in enumerate(batch.schema.names)}
            out = []
            for path, language, chunker, source, error in zip(*(columns[c] for c in ("file_path", "language", "chunker", "source", "error"))):
                if error is None and source is None:
                    error = "no text"
                outcome, chunks = "failed", []
                if error is None:
                    try:
                        outcome, chunks = chunkers[chunker](path, language, source)
                        chunks = list(chunks)
                    except Exception as problem:  # one file's failure is a row, not the end of the run
                        outcome, error = "failed", str(problem)
                out.append((path, outcome, error, chunks))
            kinds = [pa.string(), pa.string(), pa.string(), _CHUNK_TYPE]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["file_path", "outcome", "error", "chunks"])


def chunk_files(files: DataFrame, chunkers: dict[str, Callable] | None = None) -> DataFrame:
    """``files``: file_path, source[, error] -> file_path, outcome, error, chunks (array of records)."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    routed = files.select("file_path", text.language_of("file_path").alias("language"), text.route("file_path").alias("chunker"), "source", error.alias("error"))
    return routed.mapInArrow(partial(_chunk, chunkers=chunkers or _CHUNKERS), f"file_path string, outcome string, error string, chunks array<struct<{_ddl()}>>")


def _ddl() -> str:
    return ", ".join(": ".join(f.split(" ")) for f in model.CHUNK_FIELDS.split(", "))


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """One row a chunk, with its place in the file, its embedding text and its content hash."""
    rows = chunked.select(F.posexplode("chunks").alias("place", "chunk")).select("place", "chunk.*")
    return rows.withColumn("embed_text", text.embed_text()).withColumn("content_hash", text.content_hash())


def ingest_report(chunked: DataFrame, skipped: DataFrame, commit_sha: str | None = None) -> DataFrame:
    """One row: counters by outcome and the failures; skipped entries are counted apart."""

    def outcome(*names: str):
        return F.count(F.when(F.col("outcome").isin(*names), 1))

    seen = chunked.agg(
        F.count("*").alias("files_seen"), outcome("chunked").alias("files_chunked"), outcome("degraded").alias("files_degraded"), outcome("no-declarations").alias("no_declarations"), outcome("failed").alias("files_failed"),
        F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"), F.sort_array(F.collect_list(F.when(F.col("outcome") == "failed", F.struct("file_path", F.col("error").alias("reason"))))).alias("failures"),
    )
    return seen.join(skipped.agg(F.count("*").alias("files_skipped"))).withColumn("commit_sha", F.lit(commit_sha).cast("string"))


# --- the same splits as relational plans, for text that is already in a table ---------------------


def explode_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line: line_no from 1, the part index among part_total lines."""
    lines = docs.select(id_col, F.split(F.col(text_col), "\n").alias("lines"))
    return lines.select(id_col, F.size("lines").alias("part_total"), F.posexplode("lines").alias("at", "line")).select(id_col, (F.col("at") + 1).alias("part_index"), "part_total", "line")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spans(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[chunk_generic.Span]]) -> DataFrame:
    """One row a span that ``cut`` finds in a text: part_index, part_total, start_line, end_line, content."""
    array = "array<struct<start_line: int, end_line: int, content: string>>"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())]))
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            rows = [[{"start_line": a, "end_line": b, "content": t} for a, b, t in cut(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    source = docs.select(id_col, text_col)
    split = source.mapInArrow(found, f"{id_col} {source.schema[id_col].dataType.simpleString()}, spans {array}")
    return split.select(id_col, F.size("spans").alias("part_total"), F.posexplode("spans").alias("at", "s")).select(id_col, (F.col("at") + 1).alias("part_index"), "part_total", "s.*")


def line_windows(docs: DataFrame, id_col: str, text_col: str, budget: int, first_line: int = 1) -> DataFrame:
    """Greedy line windows of each text: part_index, part_total, start_line, end_line, content."""
    return spans(docs, id_col, text_col, lambda x: chunk_generic.split_by_lines(x, first_line, budget))


def coverage(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: lines in no chunk.  ``blocks``: file_path, start_line, end_line; ``files``: file_path, n_lines."""
    before = Window.partitionBy("file_path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    reach = blocks.withColumn("from", F.greatest(F.col("start_line"), F.coalesce(F.max(F.col("end_line") + 1).over(before), F.lit(1))))
    covered = reach.groupBy("file_path").agg(F.sum(F.greatest(F.lit(0), F.col("end_line") - F.col("from") + 1)).alias("covered"))
    return files.join(covered, "file_path", "left").select("file_path", "n_lines", (F.col("n_lines") - F.coalesce("covered", F.lit(0))).alias("uncovered"))
