"""Mix sources to target weights with a Pfair schedule (DataFrame and SQL operations only).

Every source's documents are put in a fixed shuffled order (by a digest of the id) and cut into
blocks.  A schedule gives each block a slot.  With weight share w, block j of a source may not begin
before slot floor((j - 1) / w) and must be done by slot ceil(j / w); in every slot the released block
with the earliest deadline runs.  Weights sum to one slot a slot, so each deadline is met and, at
any slot, a source is less than one block away from its share.

No block is dropped or repeated: when a source is used up the others go on with their weights scaled
to one.  The time between such events is cut at whole rounds (a round: each source gives as many
blocks as its integer weight says, all are level again), so the schedule is a list of segments, each
a pattern no longer than a round, and how often it repeats.  Sources of equal weight are one class:
the class is scheduled with their common weight and serves them in turn.  A member's block j then lies
inside its own window too (its j-th job of the class is released no earlier and due no later), and
a pattern is made by choosing among classes, however many sources there are.  The earliest-deadline-
first run over a pattern is one SQL expression a segment; a block finds its segment and its slot by
lookups in small tables.

Scale: nothing is ordered globally.  A document's rank in its source comes from a digest bucket (about
``BUCKET_ROWS`` documents, so the bucket of a source with a third of all rows is as small as any) and
the counts of the buckets before it; a bucket that many rows of one id crowd is dealt out by the
digest and the row's place in the input (so ``docs`` must read the same twice, as files do).  One row
a size and weight that sources have reaches the driver; tables of sources, segments and patterns stay in
Spark and are broadcast up to ``lookup.BROADCAST_ROWS`` rows, joined by shuffles beyond.

Defined results: rows with a null source are a source of their own, named ``(null)``; null and
repeated doc_ids are ordered like any other (full ties in any order); sources without a weight get
``default_weight``; weights of absent sources are ignored; an empty table gives an empty result.  Rows
are carried as one struct, so no name of the input can clash; texts are not looked at, however long.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .lookup import column, inside, rows_of, small, whole_row

BLOCK_ROWS, BUCKET_ROWS = 16, 2048
#: Buckets of so many times ``BUCKET_ROWS`` are dealt out.
CROWDED = 8
#: Bytes of rows that one file of the mixed result holds, about.
FILE_BYTES = 128 << 20


def segments(shapes: list[tuple[int, int, int]]) -> list[tuple[int, dict[int, tuple[int, int]]]]:
    """From (weight, blocks, sources that have both): (repeats, {weight: (sources, blocks of each)}), start to end.

    Rounds are the unit of time: source s has given floor(weight * t) blocks at time t and is used up
    at blocks / weight.  Time is cut at these ends and at the whole rounds next to them.
    """
    ends = {Fraction(n, w) for w, n, _ in shapes if n}
    if not ends:
        return []
    last = max(ends)
    cuts = sorted({Fraction(0), *ends, *(Fraction(int(e)) for e in ends), *(Fraction(-int(-e // 1)) for e in ends if -int(-e // 1) <= last)})
    longest: dict[int, list[tuple[int, int]]] = {}
    for w, n, k in sorted(shapes):
        longest.setdefault(w, []).append((n, k))
    sizes = {w: [n for n, _ in found] for w, found in longest.items()}
    left = {w: [*accumulate((k for _, k in reversed(found)), initial=0)][::-1] for w, found in longest.items()}
    out = []
    for a, b in zip(cuts, cuts[1:]):
        whole = a.denominator == b.denominator == 1
        each = {}
        for w in sizes:
            members = left[w][bisect_left(sizes[w], -(-w * b // 1))]  # those with at least w * b blocks
            given = w if whole else int(w * b) - int(w * a)
            if members and given:
                each[w] = (members, given)
        if each:
            out.append((int(b - a) if whole else 1, each))
    return out


def _pattern() -> Column:
    """Earliest deadline first over one repeat of a segment: column ``given`` -> class of each slot."""
    length = "aggregate(given, 0L, (a, g) -> a + g)"
    job = f"""named_struct('deadline', ((acc.done[i] + 1) * {length} + g - 1) div greatest(g, 1), 'class', i,
              'release', (acc.done[i] * {length}) div greatest(g, 1), 'left', g - acc.done[i])"""
    pick = f"array_min(filter(transform(given, (g, i) -> {job}), x -> x.left > 0 and x.release <= t)).class"
    return F.expr(f"""aggregate(sequence(0L, {length} - 1),
        named_struct('done', transform(given, g -> 0L), 'out', cast(array() as array<int>)),
        (acc, t) -> transform(array({pick}), p -> named_struct(
            'done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)), 'out', concat(acc.out, array(p))))[0]).out""")


def schedule(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", work: Workspace | None = None) -> DataFrame:
    """row (struct of the input row), source, block, slot, position (0 ..: the order to read in)."""
    if any(w < 1 for w in [default_weight, *weights.values()]):
        raise ValueError("weights are integers of at least 1")
    spark = docs.sparkSession
    work = work or Workspace(spark, "mixing")
    packed = docs.select(whole_row(docs).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("(null)")).alias("source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"))

    wanted = rows_of(spark, [{"source": s, "w": w} for s, w in weights.items()] or [{"source": None, "w": None}], "source: string, w: bigint")
    counts = packed.groupBy("source").agg(F.count("*").alias("n")).join(small(wanted), "source", "left")
    sources = counts.select("source", "n", F.coalesce("w", F.lit(default_weight)).cast("long").alias("weight"), F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("blocks"))
    sources = sources.withColumn("member", F.row_number().over(Window.partitionBy("weight").orderBy(F.desc("blocks"), "source")).cast("long") - 1)  # a row a source
    sources = work.table(sources.withColumn("n_buckets", F.expr(f"(n + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}")), "sources")
    shapes = [tuple(r) for r in sources.groupBy("weight", "blocks").agg(F.count("*").alias("k")).collect()]  # a row a size at most
    classes, plan = sorted({w for w, _, _ in shapes}, reverse=True), segments(shapes)

    lines, patterns, slot, done = [], [], 0, dict.fromkeys(classes, 0)
    for no, (repeats, each) in enumerate(plan):
        length = sum(k * g for k, g in each.values())
        patterns.append({"segment": no, "given": [k * g for k, g in (each.get(w, (0, 0)) for w in classes)]})
        for w, (k, g) in each.items():
            lines.append({"segment": no, "weight": w, "members": k, "given": g, "begin": done[w], "end": done[w] + g * repeats, "first": slot, "length": length})
            done[w] += g * repeats
        slot += length * repeats
    spans = rows_of(spark, lines, "segment: int, weight: bigint, members: bigint, given: bigint, begin: bigint, end: bigint, first: bigint, length: bigint")
    runs = rows_of(spark, patterns, "segment: int, given: array<bigint>")
    runs = runs.repartition(min(len(plan), 1000) or 1, "segment").select("segment", F.posexplode(_pattern()).alias("at", "class"))
    turn = F.row_number().over(Window.partitionBy("segment", "class").orderBy("at")).cast("long") - 1
    weight_of = F.element_at(F.lit(classes or [0]), F.col("class") + 1).cast("long")
    pattern = small(work.table(runs.select("segment", weight_of.alias("weight"), turn.alias("turn"), "at"), "patterns"))

    def slots(df: DataFrame) -> DataFrame:
        """Add ``slot`` to rows with weight, member and block."""
        df = inside(df.withColumn("__block", F.col("block")), F.col("block"), ["weight"], spans.withColumn("start", F.col("begin")))
        past = F.col("__block") - F.col("start")
        df = df.withColumn("turn", past % F.col("given") * F.col("members") + F.col("member")).withColumn("repeat", F.floor(past / F.col("given")))
        df = df.join(pattern, ["segment", "weight", "turn"]).withColumn("slot", F.col("first") + F.col("repeat") * F.col("length") + F.col("at"))
        return df.drop("__block", "start", "segment", "turn", "repeat", "at", "given", "members", "first", "length")

    missing = F.col("blocks") * block_rows - F.col("n")
    short = slots(sources.withColumn("block", F.col("blocks") - 1).select("weight", "member", "block", missing.alias("missing"))).filter("missing > 0").select("slot", "missing")
    upwards = Window.orderBy("slot")  # a row a source at most
    none = rows_of(spark, [{"slot": -1, "missing": 0}], "slot: bigint, missing: bigint")
    steps = work.table(short.union(none).select((F.col("slot") + 1).alias("begin"), F.coalesce(F.lead("slot").over(upwards) + 1, F.lit(slot + 1)).cast("long").alias("end"), F.sum("missing").over(upwards).alias("gaps")).filter("begin < end"), "gaps")

    placed = packed.join(small(sources.select("source", "weight", "member", "n_buckets")), "source")
    placed = placed.withColumn("bucket", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("n_buckets"), 32))
    crowded = placed.groupBy("source", "bucket").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > CROWDED * BUCKET_ROWS)
    crowded = work.table(crowded, "crowded")  # rows where very many rows have one id: none as a rule
    part = ["source", "bucket"]
    if not crowded.isEmpty():
        placed = placed.join(small(crowded), ["source", "bucket"], "left").withColumn("deal", F.when(F.col("crowd").isNull(), "").otherwise(F.col("digest")))
        placed = placed.withColumn("sub", F.when(F.col("crowd").isNull(), 0).otherwise(F.pmod(F.xxhash64("place"), F.expr(f"crowd div {BUCKET_ROWS} + 1")))).drop("crowd")
        part += ["deal", "sub"]
    sizes = placed.groupBy(*part).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy(*part[1:])) - F.col("size")).drop("size")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("digest", "id"))
    ranked = placed.withColumn("rank", rank).join(before, part).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    ranked = slots(ranked.withColumn("block", F.expr(f"rank div {block_rows}")))
    ranked = inside(ranked, F.col("slot"), [], steps)
    return ranked.select("row", "source", "block", "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows - F.col("gaps")).alias("position"))


def mix(docs: DataFrame, weights: dict[str, int], file_bytes: int = FILE_BYTES, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: files and rows within them follow the positions."""
    placed, widths = schedule(docs, weights, **options), [F.coalesce(F.octet_length(column(c)), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")]
    n, size = docs.agg(F.count("*"), F.sum(sum(widths, F.lit(0).cast("long")))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // file_bytes + 1)
    part = F.floor(F.col("position") * parts / max(n, 1)).cast("int")
    return placed.select("row", "position").repartitionById(parts, part).sortWithinPartitions("position").select("row.*")
