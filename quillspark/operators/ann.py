"""Nearest neighbours by cosine through an index of cells: k-means cells, product-quantised residuals, exact re-ranking.

``build`` fits the cells and the codes of residuals on a bounded sample (``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes at most)
and then stores *every* row in the folder of its cell: id, vector, code.  A search reads the folders of the
nearest cells only (partition pruning), ranks their rows by the codes, a few bytes each, and fetches the vectors of the best ``refine * limit`` for
the exact distance.  How many cells are read is set at build time: the least number that finds ``RECALL`` of the
neighbours inside the sample.  On data without clusters that is a large share of the cells.

``exact=True`` gives exactly what a full scan gives: each cell knows how far its farthest row is from its centre, so by the
triangle inequality a cell whose nearest possible row is farther than the last neighbour found is left out, and every other cell is read.

``search_all`` takes a table of queries.  Rows and queries of a cell are cut into tiles of bounded size by a hash; each
pair of tiles is one group, so neither a crowded cell nor a popular one is ever one task's group; each pair of tiles keeps its best
rows for each query and a ranked aggregate joins them.

Rows whose vector is null, of another length or without direction (zero) are not in the index, and such queries
find nothing; ties go to the smaller id; repeated rows are rows of their own; of no rows the index is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import search

SAMPLE, SAMPLE_BYTES, MAX_CELLS = 65_536, 64 << 20, 2048
RECALL, TUNED_ON, TUNED_FOR = 0.97, 200, 30
SUB, CODES, ROUNDS = 4, 256, 8
REFINE = 10
TILE_BYTES = 8 << 20
#: Rows that a worker holds against all centres, and queries that it holds against a tile, at once.
SLICE_ROWS, SLICE_QUERIES = 1024, 64
_CELLS = "cell int, size long, radius double, centre array<float>"
_BOOKS = "place int, width int, codes array<float>"


@dataclass(frozen=True)
class Index:
    folder: str
    centres: np.ndarray  # (cells, dimensions)
    radius: np.ndarray
    size: np.ndarray
    books: tuple[np.ndarray, ...]  # each (codes, dimensions of its part)
    probes: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def rebuilt(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Vectors as the codes tell them."""
        return self.centres[cell] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)

    def gaps(self, unit: np.ndarray) -> np.ndarray:
        """Distance of each unit vector from each centre."""
        square = (unit**2).sum(axis=1)[:, None] - 2 * unit @ self.centres.T.astype(np.float64) + (self.centres.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0))

    def least(self, gaps: np.ndarray) -> np.ndarray:
        """Cosine distance below which no row of a cell lies (unit vectors: half the squared distance)."""
        return np.where(self.size > 0, np.maximum(gaps - self.radius, 0) ** 2 / 2 - 1e-6, np.inf)


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (double) and which rows have one; the others are zero."""
    rows = column.to_pylist() if column.null_count or (np.diff(column.offsets.to_numpy()) != dim).any() else None
    if rows is None:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    else:
        flat = np.array([r if r is not None and len(r) == dim and None not in r else [0.0] * dim for r in rows], np.float64).reshape(-1, dim)
    norm = np.sqrt((flat**2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return np.where(good[:, None], flat, 0) / np.where(good, norm, 1)[:, None], good


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def kmeans(rows: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from k rows drawn without return; an empty cell keeps its centre."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        n = np.bincount(near, minlength=len(centres))
        for d in range(rows.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(near, rows[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
    return centres


def _tune(rows: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest cells that hold RECALL of the neighbours of some rows among all rows."""
    asked = rows[:: max(1, len(rows) // TUNED_ON)][:TUNED_ON]
    cell = _nearest(rows, centres)
    near = np.argsort(-(asked @ rows.T), axis=1)[:, :TUNED_FOR]
    order = np.argsort(-(asked @ centres.T - 0.5 * (centres**2).sum(axis=1)), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))


def _store(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        unit, good = _units(batch.column(1), index.dim)
        kept = pa.array(np.flatnonzero(good))
        unit = unit[good].astype(np.float32)
        cell = _nearest(unit, index.centres)
        rest, at = unit - index.centres[cell], 0
        codes = np.empty((len(unit), len(index.books)), np.uint8)
        for k, book in enumerate(index.books):
            codes[:, k] = _nearest(rest[:, at : at + book.shape[1]], book)
            at += book.shape[1]
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
        apart = np.sqrt(((unit.astype(np.float64) - index.centres[cell]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), packed, pa.array(apart), pa.array(cell.astype(np.int32))], names=["id", "embedding", "code", "apart", "cell"])


def build(vectors: DataFrame, folder: str, cells: int | None = None, probes: int | None = None) -> Index:
    """``vectors``: id, embedding.  Writes the index under ``folder`` and opens it."""
    spark = vectors.sparkSession
    vectors = vectors.select("id", "embedding").filter(F.col("embedding").isNotNull())
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = dim or 1
    share = min(1.0, SAMPLE / max(n, 1), SAMPLE_BYTES / (8 * dim * max(n, 1)))
    drawn = vectors.filter(F.pmod(F.xxhash64("id", "embedding", F.lit("cells")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding")
    sample, good = _units(drawn.toArrow().column(0).combine_chunks() if n else pa.array([], pa.list_(pa.float32())), dim)  # bounded: see above
    sample = sample[good].astype(np.float32)
    if not len(sample):
        sample = np.zeros((1, dim), np.float32)
    centres = kmeans(sample, cells or int(min(MAX_CELLS, max(1, n**0.5 / 2))))
    rest = sample - centres[_nearest(sample, centres)]
    books = tuple(kmeans(rest[:, a : a + SUB], CODES, seed=a) for a in range(0, dim, SUB))
    index = Index(folder, centres, np.zeros(len(centres)), np.zeros(len(centres), np.int64), books, probes or _tune(sample, centres))
    kinds = f"id {vectors.schema['id'].dataType.simpleString()}, embedding array<float>, code binary, apart double, cell int"
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).mapInArrow(partial(_store, index=index), kinds)
    rows.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/lists")
    found = _lists(spark, index, kinds).groupBy("cell").agg(F.count("*").alias("size"), F.max("apart").alias("radius"))
    known = {r["cell"]: r for r in found.collect()}  # a row a cell
    told = [(k, known[k]["size"] if k in known else 0, known[k]["radius"] if k in known else 0.0, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(told, _CELLS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    spark.createDataFrame([(k, b.shape[1], b.ravel().tolist()) for k, b in enumerate(books)], _BOOKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/books")
    spark.createDataFrame([(index.probes, kinds)], "probes int, kinds string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """Reads the small tables: a row a cell (at most MAX_CELLS) and the codes."""
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    books = spark.read.parquet(f"{folder}/books").orderBy("place").collect()
    return Index(
        folder, np.array([r["centre"] for r in cells], np.float32), np.array([r["radius"] for r in cells]), np.array([r["size"] for r in cells], np.int64),
        tuple(np.array(b["codes"], np.float32).reshape(-1, b["width"]) for b in books), spark.read.parquet(f"{folder}/meta").first()["probes"],
    )


def _lists(spark: SparkSession, index: Index, kinds: str | None = None) -> DataFrame:
    return spark.read.schema(kinds or spark.read.parquet(f"{index.folder}/meta").first()["kinds"]).parquet(f"{index.folder}/lists")


# --- one query ------------------------------------------------------------------------------------


def _ranked(batches: Iterator[pa.RecordBatch], index: Index, unit: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        near = 1 - index.rebuilt(batch.column(2).to_numpy(), codes) @ unit
        best = np.argpartition(near, limit)[:limit] if len(near) > limit else np.arange(len(near))
        best = np.flatnonzero(near <= near[best].max(initial=-np.inf)) if len(near) else best  # all that tie with the last
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), batch.column(2).take(pa.array(best)), pa.array(near[best])], names=["id", "cell", "near"])


def nearest(spark: SparkSession, index: Index, query: Sequence[float], limit: int, exact: bool = False, refine: int = REFINE) -> DataFrame:
    """id, dense_distance, dense_rank of the nearest rows, as :func:`search.dense_leg` gives them for all rows."""
    unit, good = _units(pa.array([[float(x) for x in query]], pa.list_(pa.float64())), index.dim)
    rows = _lists(spark, index)
    if not good[0]:
        return search.dense_leg(rows.filter(F.lit(False)), query, limit)
    gaps = index.gaps(unit)[0]
    order = [int(c) for c in np.argsort(gaps, kind="stable") if index.size[c]]
    first = order[: index.probes]
    if exact:
        last = search.dense_leg(rows.filter(F.col("cell").isin(first)), query, limit).agg(F.count("*"), F.max("dense_distance")).first()
        least = index.least(gaps)
        more = [c for c in order if c in first or last[0] < limit or least[c] <= last[1]]
        return search.dense_leg(rows.filter(F.col("cell").isin(more)), query, limit)
    near = rows.filter(F.col("cell").isin(first)).select("id", "code", "cell").mapInArrow(partial(_ranked, index=index, unit=unit[0], limit=refine * limit), f"id {rows.schema['id'].dataType.simpleString()}, cell int, near double")
    best = near.orderBy("near", "id").limit(refine * limit).collect()  # refine * limit rows
    fetched = rows.filter(F.col("cell").isin(sorted({r["cell"] for r in best})) & F.col("id").isin([r["id"] for r in best]))
    return search.dense_leg(fetched, query, limit)


# --- many queries ---------------------------------------------------------------------------------


def _probe(batches: Iterator[pa.RecordBatch], index: Index, exact: bool) -> Iterator[pa.RecordBatch]:
    """A row for each query and cell that it reads.  exact: columns 2 and 3 hold how many it found and how far its last one is."""
    filled = index.size > 0
    for batch in _slices(batches):
        unit, good = _units(batch.column(1), index.dim)
        gaps = np.where(filled, index.gaps(unit), np.inf)
        order = np.argsort(gaps, axis=1, kind="stable")
        near = np.zeros(gaps.shape, bool)
        np.put_along_axis(near, order[:, : index.probes], True, axis=1)
        if exact:
            last = np.where(batch.column(2).to_numpy(zero_copy_only=False), np.inf, batch.column(3).to_numpy(zero_copy_only=False))
            near = ~near & (index.least(gaps) <= last[:, None])
        row, cell = np.nonzero(near & filled & good[:, None])
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32))], names=["query_id", "query", "cell"])


def _tile(key: tuple, asked: pa.Table, rows: pa.Table, index: Index | None, dim: int, limit: int) -> pa.Table:
    """The ``limit`` nearest rows of one tile for each query of another."""
    queries = _units(asked.column("query").combine_chunks(), dim)[0]
    payload = rows.column("payload").combine_chunks()
    if index is None:
        units, good = _units(payload, dim)
    else:
        codes = np.frombuffer(b"".join(payload.to_pylist()), np.uint8).reshape(len(payload), -1)
        units, good = index.rebuilt(np.full(len(payload), key[0].as_py()), codes), np.ones(len(payload), bool)
    ids = rows.column("id").combine_chunks()
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()  # ties go to the smaller id
    order = order[good[order]]
    units, who, where, far = units[order], [], [], []
    for a in range(0, len(queries), SLICE_QUERIES):
        apart = np.round(1 - queries[a : a + SLICE_QUERIES] @ units.T, 12)  # equal rows are equally far, whatever the order of summation
        best = np.argsort(apart, axis=1, kind="stable")[:, :limit]
        who.append(np.repeat(np.arange(a, a + len(apart)), best.shape[1]))
        where.append(best.ravel())
        far.append(np.take_along_axis(apart, best, axis=1).ravel())
    who, where, far = (np.concatenate(x) for x in (who, where, far))
    return pa.table({"query_id": asked.column("query_id").combine_chunks().take(pa.array(who)), "id": ids.take(pa.array(order[where])), "distance": far})


def _tiled(asked: DataFrame, rows: DataFrame, sizes: dict[int, int], index: Index | None, dim: int, limit: int) -> DataFrame:
    """``asked``: query_id, query, cell; ``rows``: id, payload, cell -> the best rows of each query."""
    spark = rows.sparkSession
    many = max(1, TILE_BYTES // (8 * dim))
    some = max(1, min(many, TILE_BYTES // (24 * limit)))  # a query takes its vector, and three numbers for each row found
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    tiles = [(c, -(-sizes[c] // many), -(-n // some)) for c, n in counts.items() if sizes.get(c)]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    if not tiles:
        return spark.createDataFrame([], kinds)
    cut = F.broadcast(spark.createDataFrame(tiles, "cell int, of_rows int, of_queries int"))
    own = lambda c, n: F.pmod(F.xxhash64(c, F.lit("tile")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cut, "cell").select("query_id", "query", "cell", own("query_id", "of_queries").alias("j"), every("of_rows").alias("i"))
    right = rows.join(cut, "cell").select("id", "payload", "cell", own("id", "of_rows").alias("i"), every("of_queries").alias("j"))

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a.column("query_id").slice(0, 0), "id": b.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        return _tile(key, a, b, index, dim, limit)

    return _best(left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(meet, kinds), limit)


def _best(found: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= limit)  # each task keeps the best rows of a query before the shuffle


def search_all(index: Index, queries: DataFrame, limit: int, exact: bool = False, refine: int = REFINE) -> DataFrame:
    """``queries``: query_id, query -> query_id, id, distance, rank of its nearest rows."""
    spark, work = queries.sparkSession, Workspace(queries.sparkSession, "neighbours")
    queries = queries.select("query_id", F.col("query").cast("array<float>").alias("query"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, query array<float>, cell int"
    lists, sizes = _lists(spark, index), dict(enumerate(index.size.tolist()))
    asked = work.table(queries.mapInArrow(partial(_probe, index=index, exact=False), kinds), "asked")
    if not exact:
        coded = _tiled(asked, lists.select("id", F.col("code").alias("payload"), "cell"), sizes, index, index.dim, refine * limit).select("query_id", "id")
        pairs = work.table(coded, "coded").join(lists.select("id", "embedding"), "id").join(queries, "query_id")
        return _best(pairs.select("query_id", "id", _cosine("query", "embedding").alias("distance")).filter(F.col("distance").isNotNull()), limit)
    vectors = lists.select("id", F.col("embedding").alias("payload"), "cell")
    first = work.table(_tiled(asked, vectors, sizes, None, index.dim, limit).drop("rank"), "first")
    last = first.groupBy("query_id").agg((F.count("*") < limit).alias("short"), F.max("distance").alias("last"))
    told = queries.join(last, "query_id", "left").select("query_id", "query", F.coalesce("short", F.lit(True)).alias("short"), F.coalesce("last", F.lit(9.0)).alias("last"))
    more = work.table(told.mapInArrow(partial(_probe, index=index, exact=True), kinds), "more")
    return _best(first.unionByName(_tiled(more, vectors, sizes, None, index.dim, limit).drop("rank")), limit)


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) - dot / F.nullif(search.norm(F.col(a)) * search.norm(F.col(b)), F.lit(0.0))


def brute_force(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The same by all distances, in tiles; for measuring recall."""
    vectors = vectors.filter(F.col("embedding").isNotNull())
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    none = F.lit(0).alias("cell")
    return _tiled(queries.select("query_id", F.col("query").cast("array<float>").alias("query"), none), vectors.select("id", F.col("embedding").cast("array<float>").alias("payload"), none), {0: n}, None, dim or 1, limit)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, share of the true neighbours that were found."""
    met = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
