"""Minimax contiguous sharding of documents (DataFrame and SQL operations only).

Documents with equal texts are one atomic group.  Groups stand in a given order; the shards are
contiguous runs of groups.  The smallest capacity for which a greedy fill needs no more than the
wanted number of shards is found by binary search, and the greedy cuts for it are the shards.

The search needs prefix sums of group sizes, but not all of them at once.  The prefix sums are a
distributed table; a round fetches the first and last of them in each of ``POINTS`` ranges.  With
these, greedy fills give a lower and an upper bound for each cut, hence for the capacity, and the
next round looks only between the bounds of the cuts, ``POINTS`` times finer, until the prefix sums
there are all known and the search is exact.  Each round narrows the part that is looked at more
than a hundredfold, so a few scans of the slim table do at any size, and the driver holds at most
``EXACT`` + 4 * ``POINTS`` numbers.

Scale: texts are read once, for their size, checksum and digest; what moves is a digest and a few
numbers a document.  Order comes from range partitions, whose row numbers are made global by the
counts of the partitions before; a group of copies that holds a third of all rows spreads over
partitions, because rows are ranged by (group, order).

Defined results: a null text has size 1, checksum 0 and forms one group with other nulls; an empty
text has size 1 and checksum 0 and is another group; null order values come first; repeated rows
each get a slot; texts are read once, however long; fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .lookup import inside, rows_of

POINTS, EXACT = 8192, 40_000


class Prefix:
    """What is known of the sorted prefix sums: ranges (first, last, all known in between)."""

    def __init__(self, ranges: list[tuple[int, int, bool]]):
        self.ranges = sorted(ranges)
        self.firsts = [r[0] for r in self.ranges]

    def reach(self, limit: int, at_least: bool) -> int:
        """A bound of the largest prefix sum not above ``limit``: one surely reached (``at_least``), or
        one that is surely not passed."""
        k = bisect_right(self.firsts, limit) - 1
        if k < 0:
            return 0
        first, last, whole = self.ranges[k]
        if limit >= last:
            return last
        return first if whole or at_least else limit

    def fill(self, capacity: int, shards: int, at_least: bool) -> list[int]:
        """Greedy cuts."""
        at, cuts = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity, at_least)
            cuts.append(at)
        return cuts


def smallest(prefix: Prefix, total: int, shards: int, low: int, high: int, at_least: bool) -> int:
    """Smallest capacity in (low, high] whose fill covers everything; high is known to do."""
    while high - low > 1:
        mid = (low + high) // 2
        if prefix.fill(mid, shards, at_least)[-1] >= total:
            high = mid
        else:
            low = mid
    return high


def _number(df: DataFrame, order: list[str], work: Workspace, label: str) -> DataFrame:
    """Write ``df`` in range partitions of ``order``, with ``part`` and ``mark`` that number its rows."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    return work.table(sorted_rows.withColumn("mark", mark).withColumn("part", F.shiftright("mark", 33).cast("int")), label)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None, work: Workspace | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; ``order``: of the rows, default the id.

    A group stands where its first row stands.  Law ``bytes``: sizes of shards as equal as whole
    groups in this order allow.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "sharding")
    text, order = F.col(text_col), order or [F.col(id_col)]
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
        (F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]) if len(order) > 1 else order[0]).alias("o"),
    )
    base = work.table(base, "rows")
    groups = base.groupBy("key").agg(F.min("o").alias("o"), F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = _number(groups, ["o", "key"], work, "groups")
    per_part = groups.groupBy("part").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.min("mark").alias("low"))
    n_groups = per_part.agg(F.sum("groups")).first()[0] or 0
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = per_part.select("part", "low", *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(f"{c}_before") for c in ("size", "n", "groups")])
    in_part = Window.partitionBy("part").orderBy("mark")
    summed = groups.withColumn("size", F.sum("size").over(in_part)).withColumn("n", F.sum("n").over(in_part)).join(offsets, "part")
    prefix = work.table(summed.select("key", (F.col("size") + F.col("size_before")).alias("to_size"), (F.col("n") + F.col("n_before")).alias("to_n"), (F.col("mark") - F.col("low") + F.col("groups_before")).alias("group_no")), "prefix")

    cuts = sorted(prefix.filter(F.col("to_size").isin(_search(prefix, shards))).collect(), key=lambda r: r["to_size"])  # under ``shards`` rows
    numbered = _number(base.join(prefix.select("key", "group_no"), "key").select("doc_id", "size", "text_crc32", "group_no", "o"), ["group_no", "o"], work, "ordered")
    for done in ("rows", "groups", "prefix"):
        work.drop(done)
    parts = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("mark").alias("low"))
    before = F.broadcast(parts.select("part", "low", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")))  # a row a partition
    firsts = [(0, 0), *((c["group_no"] + 1, c["to_n"]) for c in cuts)]  # group and row that each shard begins with
    ends = [f for f, _ in firsts[1:]] + [max(n_groups, firsts[-1][0] + 1)]
    spans = rows_of(spark, [{"begin": f, "end": e, "shard": k, "first_row": n} for k, ((f, n), e) in enumerate(zip(firsts, ends)) if f < e], "begin: bigint, end: bigint, shard: int, first_row: bigint")
    slot = F.col("before") + F.col("mark") - F.col("low") - F.col("first_row")
    return inside(numbered.join(before, "part"), F.col("group_no"), [], spans).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _search(prefix: DataFrame, shards: int) -> list[int]:
    """Prefix sums at which to cut (all but the last shard's end)."""
    total = prefix.agg(F.max("to_size")).first()[0]
    if total is None:
        return []
    points = max(POINTS, 16 * shards * shards)  # the cuts' bounds span about 2 * shards**2 ranges
    low, high, spans, known, width = 0, total, [(0, total)], [], total
    while True:
        condition = F.lit(False)
        for a, b in spans:
            condition = condition | F.col("to_size").between(a, b)
        wanted = prefix.filter(condition).select("to_size")
        if wanted.count() <= EXACT:
            exact = [(r[0], r[0], True) for r in wanted.collect()]
        else:
            exact = []
            width = max(1, min(width // 2, sum(b - a + 1 for a, b in spans) // points))
            found = wanted.groupBy(F.floor(F.col("to_size") / width)).agg(F.min("to_size"), F.max("to_size"), F.count("*")).collect()
            exact = [(r[1], r[2], r[3] <= 2) for r in found]
        seen = Prefix(_clipped(known, spans) + exact if known else exact)
        done = all(r[2] or r[0] == r[1] for r in exact)
        high = smallest(seen, total, shards, low, high, True)
        if done:
            return [c for c in seen.fill(high, shards, True)[:-1] if c < total]
        low = max(low, smallest(seen, total, shards, low, high, False) - 1)
        known = seen.ranges
        spans = _spans(list(zip(seen.fill(max(low, 0), shards, True), seen.fill(high, shards, False))))


def _clipped(known: list[tuple[int, int, bool]], spans: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """What was known outside the spans; ranges that reach into one are cut to their end outside."""
    out = []
    for first, last, whole in known:
        touching = [(a, b) for a, b in spans if a <= last and first <= b]
        if not touching:
            out.append((first, last, whole))
            continue
        if not any(a <= first <= b for a, b in touching):
            out.append((first, first, True))
        if last != first and not any(a <= last <= b for a, b in touching):
            out.append((last, last, True))
    return out


def _spans(bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(bounds):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
