"""Lines of a file as stored blocks and the gaps between them; for one request or a table of them.

Blocks and requests meet in bins of lines, so one huge file is many keys.  A block is listed at one level, that of the narrowest bins
of which it touches at most two (a block beyond the widest level in as many as it needs); a request, which is narrow, is listed at every level.
A pair is kept in the first bin that both touch, so nothing comes twice and nothing has to be made distinct.

Pairs are as many as blocks times requests where many of both lie in one file, so work on single pairs is left to the last step: blocks with
the same lines meet requests for the same range as one row, and both are told apart behind the join; the requests of a file that many ask for
are dealt out to tiles, so the pairs of one file are many tasks; gaps come from the lines that are covered, without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text


def requested(requests: DataFrame) -> DataFrame:
    """``requests``: request_id, repo_source, file_path, start_line, end_line; the range is clamped."""
    return requests.select("request_id", "repo_source", "file_path", F.col("start_line").alias("from_line"), text.clamp_end("start_line", "end_line").alias("to_line"))


#: Lines of a bin at the lowest level; each level's bins are ``STEP`` times as wide.
BIN, STEP, LEVELS = model.MAX_SOURCE_LINES, 8, 6


def _width(level: Column) -> Column:
    return (F.lit(BIN) * F.element_at(F.array(*[F.lit(STEP**k) for k in range(LEVELS)]), level + 1)).cast("long")


def _bin(line: Column, level: Column) -> Column:
    return F.floor(line / _width(level))


#: Blocks with the same lines, and requests for the same range, that one row carries through the join: the rows that come of a pair are held until
#: the last is made, so few enough to stay in a core's cache.
PACK, ASKED = 16, 16
#: Rows of a listing that a pack of its entries stands for, about.
LISTED = 4096
#: Requests of a file, or for a range, in one tile; tasks of a join of tiles to each core, as its result is larger than what it reads.
TILE, TASKS = 4096, 32
_SPAN = ("repo_source", "file_path", "start_line", "end_line")
_RANGE = ("repo_source", "file_path", "from_line", "to_line")


def _level(long: Column) -> Column:
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(long < BIN * STEP**k, k).otherwise(level)
    return level


def _met(spans: DataFrame, asked: DataFrame, *tile: str) -> DataFrame:
    """Rows of ``spans`` (its lines and other columns) with the requests of the same file and tile that they overlap."""
    first, last = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    listed = spans.withColumn("__level", _level(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0))))
    listed = listed.withColumn("__bin", F.explode(F.sequence(_bin(first, F.col("__level")), _bin(last, F.col("__level")))))
    asked = asked.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)])))
    low, high = F.least("from_line", "to_line"), F.greatest("from_line", "to_line")
    asked = asked.withColumn("__bin", F.explode(F.sequence(_bin(low, F.col("__level")), _bin(high, F.col("__level")))))
    keys = ["repo_source", "file_path", "__level", "__bin", *tile]
    meet = _tiles_met(listed, asked, keys) if tile else listed.join(asked, keys)
    once = F.col("__bin") == F.greatest(_bin(first, F.col("__level")), _bin(low, F.col("__level")))
    return meet.filter(once & (F.col("end_line") >= F.col("from_line")) & (F.col("start_line") <= F.col("to_line"))).drop("__level", "__bin", *tile)


def _tiles_met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two sides dealt out to tiles; its tasks are not made fewer where what they read is small."""
    tasks = TASKS * left.sparkSession.sparkContext.defaultParallelism
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys)


def _dealt(spans: DataFrame, asked: DataFrame, by: tuple[str, ...], one: Column, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__tile``: requests with the same columns ``by`` are dealt out by ``one``, and the spans listed in every tile."""
    tiles = asked.groupBy(*by).agg(F.ceil(F.sum(weight) / TILE).cast("int").alias("__tiles")).filter("__tiles > 1")
    many = F.coalesce("__tiles", F.lit(1))
    listed = spans.join(tiles, [*by], "left").withColumn("__tile", F.explode(F.sequence(F.lit(0), many - 1))).drop("__tiles")
    return listed, asked.join(tiles, [*by], "left").withColumn("__tile", F.pmod(F.xxhash64(one), many).cast("int")).drop("__tiles")


def _all_met(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of requests: those of one file are dealt out to tiles, and no side is held whole, however small its files look."""
    return _met(*_dealt(spans, requested(requests), ("repo_source", "file_path"), F.col("request_id"), F.lit(1)), "__tile")


def _packed(rows: DataFrame, by: tuple[str, ...], order: str, others: list[Column], size: int, name: str) -> DataFrame:
    """Rows with the same columns ``by`` as one, ``size`` at most: their other columns are the array ``name`` of structs."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    packed = rows.select(*by, F.struct(*others).alias("__row"), F.floor(place / size).alias("__pack"))
    return packed.groupBy(*by, "__pack").agg(F.collect_list("__row").alias(name))


def blocks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocks that overlap the range, whole; for a few requests (:func:`blocks_of_all`: for a table of them).

    A block or range that ends before it starts meets nothing but what holds both its lines.
    """
    return _met(chunks, requested(requests))


def blocks_of_all(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The same rows for a table of requests."""
    others = [F.col(f"`{c}`") for c in chunks.columns if c not in _SPAN] or [F.lit(0).alias("__none")]
    packed = _packed(chunks, _SPAN, "start_line", others, PACK, "__rows").drop("__pack")
    asked = _packed(requested(requests), _RANGE, "request_id", [F.col("request_id")], ASKED, "__asked")
    found = _met(*_dealt(packed, asked, _RANGE[:2], F.struct("from_line", "to_line", "__pack"), F.size("__asked")), "__tile")
    found = found.select(*_SPAN, "from_line", "to_line", "__rows", F.inline("__asked")).select(*_SPAN, "request_id", "from_line", "to_line", F.inline("__rows"))
    return found.select(*[f"`{c}`" for c in chunks.columns], "request_id", "from_line", "to_line")


def covered(chunks: DataFrame) -> DataFrame:
    """repo_source, file_path, start_line, end_line: runs of lines that blocks cover.

    Blocks that start in one bin of their level and overlap or touch are one run, so a bin has no more runs than its width allows, however
    many its blocks are, and none is longer than two bins.  A block that ends before it starts covers nothing and stays as it is.
    """
    start, bins = F.col("start_line"), ["repo_source", "file_path", "__level", "__bin"]
    spans = chunks.select(*_SPAN)
    sound = spans.filter("end_line >= start_line").withColumn("__level", _level(F.col("end_line") - start)).withColumn("__bin", _bin(start, F.col("__level")))
    longest = sound.groupBy(*bins, "start_line").agg(F.max("end_line").alias("end_line"))
    order = Window.partitionBy(*bins).orderBy("start_line")
    apart = longest.withColumn("__new", (start.cast("long") - 1 > F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    runs = apart.withColumn("__run", F.coalesce(F.sum("__new").over(order), F.lit(0)))
    runs = runs.groupBy(*bins, "__run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return runs.select(*_SPAN).union(spans.filter("end_line < start_line").distinct())


def gaps(found: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, start_line, end_line of the lines that no block covers (a request without blocks has none, nor has one that ends before it starts)."""
    inside = found.filter("from_line <= to_line").select("request_id", "from_line", "to_line", F.greatest("start_line", "from_line").alias("a"), F.least("end_line", "to_line").alias("b"))
    order = Window.partitionBy("request_id").orderBy("a", "b")
    cursor = F.coalesce(F.max(F.col("b") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("from_line"))
    at = inside.withColumns({"cursor": cursor, "last": F.lead("a").over(order).isNull()})
    gap = lambda a, b: F.struct(a.alias("start_line"), b.alias("end_line"))
    between = F.when(F.col("a") > F.col("cursor"), gap(F.col("cursor"), F.col("a") - 1))
    end = F.greatest("cursor", F.col("b") + 1)
    tail = F.when(F.col("last") & (end <= F.col("to_line")), gap(end, F.col("to_line")))
    return at.select("request_id", F.explode(F.array(between, tail)).alias("gap")).filter("gap is not null").select("request_id", "gap.*")


def uncovered(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The :func:`gaps` of a table of requests, from runs of covered lines: as many rows as requests, not as pairs."""
    return gaps(_all_met(covered(chunks), requests), requests)


def listing(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocks and gaps in one listing: a request's rows lie together, in order of start line.

    The listing is made once for each range that is asked for, blocks with the same lines as one entry, and its entries are cut into packs
    of about ``LISTED`` rows.  Requests meet the packs of their range, and these are sorted and told apart last.
    """
    asked = requested(requests).groupBy(*_RANGE, "request_id").agg(F.count("*").alias("__asks"))
    ranges = asked.select(*_RANGE).distinct().select(F.struct(*_RANGE).alias("request_id"), *_RANGE[:2], F.col("from_line").alias("start_line"), F.col("to_line").alias("end_line"))
    same = chunks.groupBy(*_SPAN).agg(F.count("*").alias("copies"))
    both = _all_met(same, ranges).select("request_id", "start_line", "end_line", "copies")
    both = both.union(uncovered(chunks, ranges).select("request_id", "start_line", "end_line", F.lit(0).cast("long")))  # a gap has no copies
    cut = both.withColumn("cut", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("copies") - 1, F.lit(0)) / LISTED))))
    entries = cut.select("request_id", F.struct("start_line", "end_line", F.least(F.col("copies") - F.col("cut") * LISTED, F.lit(LISTED)).cast("int").alias("times")).alias("entry"))
    before = F.sum(F.greatest("entry.times", F.lit(1))).over(Window.partitionBy("request_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1))
    packs = entries.withColumn("__pack", F.floor(F.coalesce(before, F.lit(0)) / LISTED)).groupBy("request_id", "__pack").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    packs, asked = _dealt(packs.select("request_id.*", "__pack", "entries"), asked.withColumn("__ask", F.explode(F.sequence(F.lit(1), "__asks"))), _RANGE, F.col("request_id"), F.lit(1))
    met = _tiles_met(asked, packs, [*_RANGE, "__tile"]).select(*_RANGE, "request_id", "__ask", "__pack", "entries").sortWithinPartitions("request_id", *_RANGE, "__ask", "__pack")
    told = met.select("request_id", "__ask", F.inline("entries")).filter("times > 0 or __ask = 1")  # who asks twice is told the gaps once
    kind = F.when(F.col("times") > 0, "block").otherwise("gap")
    return told.select("request_id", "start_line", "end_line", kind.alias("kind"), F.explode(F.array_repeat(F.lit(0), F.greatest("times", F.lit(1))))).select("request_id", "start_line", "end_line", "kind")
