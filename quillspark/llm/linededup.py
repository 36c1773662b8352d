"""Line dedup by a segment-partition edit join (DataFrame and SQL operations only).

Distinct lines are linked that are at most ``TAU`` = 2 edits apart, and no more than one edit for every
``PER_EDIT`` = 10 characters of the longer one: two from 20 characters on, one from 10 on, none below.

From 18 characters on a line is cut into 3 (TAU + 1) segments; two edits touch at most two of them, so of
two linked lines the longer one holds some segment of the shorter one unchanged, at a place that is
shifted by a few characters at most.  Each distinct line puts its own 3 segments into an index (keyed by
length, segment number and content) and probes with those substrings of itself that can be a segment of
a line of its length, one less or two less: by the multi-match-aware bounds 12 substrings in all, 3 of
them its own segments.  Lines of 9 to 19 characters meet in what is left of them after at most one
deletion.  Lines that meet in a key are compared inside the join by their counts of 24 characters: two
edits move those by 4 in all at most, so this drops no link, and only pairs that pass leave the join.  A
banded bit-parallel edit distance (Hyyrö 2003) over whole lines decides.

Exact copies collapse first (partial aggregation by the line itself), so a line that a third of the
documents share is one row a task.  A key that very many distinct lines share (``CROWD``, seen in a sample
of lines) is mostly one boilerplate line with numbers in it.  Its lines are dealt out by their digits:
two edits change the digits by two at most, so lines meet in what is left of the digits after at most
two deletions (up to 12 digits; lines with more meet among themselves).  That is under a hundred rows a
line instead of pairs; which keys the sample finds decides about the plan only.  Lines that differ in
letters alone and crowd a key are still compared with one another (two numbers a pair), in a join that
Spark splits where a key is hot.

Links are closed to classes; of each class the first line in (doc_id, line_no) order stays.

Defined results: lines without a character other than white space take no part; a null text has no lines; null doc_ids sort after all others;
rows that repeat a doc_id repeat its lines (full ties for the first place all stay); an empty table
gives an empty result; other columns are not looked at.  Lines are never cut; the join carries hashes of
segments, and only the verification holds two whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .components import connected_components

TAU, PER_EDIT = 2, 10
#: Lines in one key from which they are dealt out by their digits; lines of a sample that are looked at.
CROWD, SAMPLE = 4096, 32
DIGITS = 12
#: Lines that share a key (8 bytes each) up to which their ids are broadcast to fetch the texts.
BROADCAST_IDS = 1_000_000
LETTERS = "eaoitnsrhldcum0123456789"
_LAST = 2**63 - 1


def probes() -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a segment of a shorter line can lie in a longer one."""
    out = []
    for d in range(TAU + 1):
        for i in range(TAU + 1):
            out += [(d, i, s) for s in range(-TAU, TAU + 1) if abs(s) <= i and abs(s - d) <= TAU - i]
    return out


def _keyed(lines: DataFrame) -> DataFrame:
    """id, key, own for every place where a segment can lie (short generated code: one row a place)."""
    places = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d, i, s in probes()])
    least = TAU * PER_EDIT - TAU  # of two linked lines the shorter one has so many characters
    rows = lines.filter(F.col("len") >= least).select("id", "line", "len", F.inline(places).alias("d", "i", "shift"))
    length, n = F.col("len") - F.col("d"), TAU + 1
    base, long_from = F.floor(length / n).cast("int"), F.lit(n) - (length % n).cast("int")
    at = F.col("i") * base + F.greatest(F.lit(0), F.col("i") - long_from) + F.col("shift")
    size = base + (F.col("i") >= long_from).cast("int")
    usable = (at >= 0) & (at + size <= F.col("len")) & (length >= least)
    own = (F.col("d") == 0) & (F.col("shift") == 0)
    return rows.filter(usable).select("id", F.xxhash64(length, F.col("i"), F.col("line").substr(at + 1, size)).alias("key"), own.alias("own"))


def _short_keyed(lines: DataFrame) -> DataFrame:
    """id, key, own of lines that can be one edit away from one of 10 to 19 characters."""
    rows = lines.filter(F.col("len").between(PER_EDIT - 1, TAU * PER_EDIT - 1))
    cuts = F.expr("array_distinct(transform(sequence(1, len + 1), i -> concat(substr(line, 1, i - 1), substr(line, i + 1))))")
    return rows.select("id", F.explode(cuts).alias("rest")).select("id", F.xxhash64(F.lit("short"), "rest").alias("key"), F.lit(True).alias("own"))


def _dealt_by_digits(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of crowded keys under keys that also hold what is left of the line's digits."""
    digits = lines.select("id", F.regexp_replace("line", "[^0-9]", "").alias("digits"))
    rest = """array_distinct(flatten(transform(sequence(1, length(digits) + 1), i -> transform(sequence(i + 1, length(digits) + 2), j ->
        concat(substr(digits, 1, i - 1), substr(digits, i + 1, j - i - 1), substr(digits, j + 1))))))"""
    few = F.when(F.length("digits") <= DIGITS, F.expr(rest)).otherwise(F.array().cast("array<string>"))
    many = F.when(F.length("digits") > DIGITS - TAU, F.array(F.lit("many"))).otherwise(F.array().cast("array<string>"))
    places = digits.select("id", F.concat(few, many).alias("rests"))
    return keyed.join(places, "id").select("id", F.explode("rests").alias("rest"), "key", "own").select("id", F.xxhash64("key", "rest").alias("key"), "own")


def _all_keyed(lines: DataFrame, work: Workspace) -> DataFrame:
    """id, key, own of all lines; no key is crowded by lines that differ in digits."""
    keyed, every = _keyed(lines).union(_short_keyed(lines)), max(1, min(SAMPLE, CROWD // 64))
    seen = lines.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    crowded = _keyed(seen).union(_short_keyed(seen)).groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter((F.col("n") * every > CROWD) & F.col("own"))
    crowded = work.table(crowded.select("key"), "crowded")
    n = crowded.count()
    if not n:
        return keyed
    few = F.broadcast(crowded) if n <= BROADCAST_IDS else crowded
    return keyed.join(few, "key", "left_anti").select("id", "key", "own").union(_dealt_by_digits(keyed.join(few, "key", "left_semi"), lines))


def letter_counts(line: Column) -> Column:
    """Counts of 24 characters, modulo 128, in the bytes of three longs."""
    words = []
    for k in range(0, len(LETTERS), 8):
        word = F.lit(0).cast("long")
        for j, letter in enumerate(LETTERS[k : k + 8]):
            n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
            word = word.bitwiseOR(F.shiftleft((n % 128).cast("long"), 8 * j))
        words.append(word.alias(f"w{k // 8}"))
    return F.struct(*words)


def letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of how far two count vectors are apart (sum over letters, counts modulo 128)."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftright(a[f"w{k // 8}"], 8 * (k % 8)).bitwiseAND(F.lit(127)) - F.shiftright(b[f"w{k // 8}"], 8 * (k % 8)).bitwiseAND(F.lit(127)))
        total = total + F.least(d, F.lit(128) - d)
    return total


def banded_distance(a: str, b: str, k: int = TAU) -> Column:
    """SQL: edit distance of string columns ``a`` (not the shorter one, at most k longer) and ``b`` (not
    empty): exact up to k, else some number above k.

    Bit-parallel over the 2k + 1 diagonals around the main one.  Bit t of a word stands for row
    j - k + t of column j; the first loop follows the lowest diagonal, where the distance can
    only rise, and the last steps walk from it up to the end cell.
    """
    w = 2 * k + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    first_rows = full & ~((1 << (w - k - 1)) - 1)
    match = " + ".join(f"if(j + {d} >= 0 and get(p, cast(j + {d} as int)) = get(s, cast(j as int)), {1 << (w - 1 - k + d)}L, 0L)" for d in range(-k, k + 1))
    edge = f"{w - 2} - cast(j - (size(p) - {k}) as int)"
    step = f"""transform(array({match}), x ->
        transform(array((((x & acc.vp) + acc.vp) & {full}L) ^ acc.vp | x | acc.vn), d0 ->
        transform(array(named_struct('d0', d0, 'hp', acc.vn | (~(d0 | acc.vp) & {full}L), 'hn', d0 & acc.vp)), h -> named_struct(
            'vp', h.hn | (~(shiftright(h.d0, 1) | h.hp) & {full}L),
            'vn', shiftright(h.d0, 1) & h.hp,
            'dist', acc.dist + if(j < size(p) - {k}, if((h.d0 & {top}L) = 0, 1, 0),
                cast(shiftright(h.hp, {edge}) & 1L as int) - cast(shiftright(h.hn, {edge}) & 1L as int))))[0])[0])[0]"""
    return F.expr(f"""transform(array(named_struct('p', split({a}, ''), 's', split({b}, ''))), z ->
        transform(array(z.p), p -> transform(array(z.s), s -> aggregate(sequence(0L, size(s) - 1L),
            named_struct('vp', {first_rows}L, 'vn', 0L, 'dist', {k}), (acc, j) -> if(acc.dist > {2 * k} + size(s) - size(p), acc, {step}), acc -> acc.dist))[0])[0])[0]""")


def _shared_keys(lines: DataFrame, work: Workspace) -> DataFrame:
    """key, id, own of the keys that more than one line has and at least one as a segment of its own."""
    same = Window.partitionBy("key")
    return _all_keyed(lines, work).withColumn("met", F.count("*").over(same)).withColumn("any_own", F.max("own").over(same)).filter("met > 1 and any_own").select("key", "id", "own")


def line_links(lines: DataFrame, work: Workspace) -> DataFrame:
    """Verified pairs (u, v) of ids of ``lines`` (id, line, len)."""
    shared = work.table(_shared_keys(lines, work), "shared")
    ids = work.table(shared.select("id").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = work.table(lines.join(ids, "id", "left_semi").select("id", "line", "len", letter_counts(F.col("line")).alias("letters")), "texts")
    counted = shared.join(texts.select("id", "letters"), "id")
    left = counted.filter("own").select("key", F.col("id").alias("u"), F.col("letters").alias("a"))
    right = counted.select("key", F.col("id").alias("v"), F.col("own").alias("v_own"), F.col("letters").alias("b"))
    once = (F.col("u") != F.col("v")) & (~F.col("v_own") | (F.col("u") < F.col("v")))
    met = left.join(right, "key").filter(once & (letters_apart(F.col("a"), F.col("b")) <= 2 * TAU))
    candidates = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = candidates.join(texts.select(F.col("id").alias("u"), F.struct("line", "len").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.struct("line", "len").alias("b")), "v")
    first_longer = F.col("a.len") >= F.col("b.len")
    ordered = both.select("u", "v", F.when(first_longer, F.col("a.line")).otherwise(F.col("b.line")).alias("longer"), F.when(first_longer, F.col("b.line")).otherwise(F.col("a.line")).alias("shorter"), F.floor(F.greatest("a.len", "b.len") / PER_EDIT).alias("allowed"))
    links = work.table(ordered.filter(banded_distance("longer", "shorter") <= F.least("allowed", F.lit(TAU))).select("u", "v"), "links")
    for done in ("shared", "ids", "texts", "crowded"):
        work.drop(done)
    return links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row per line with a word: doc_id, line_no (from 0), copies, n_links, class_doc_id,
    class_line_no (first line of the class), kept."""
    work = work or Workspace(docs.sparkSession, "lines")
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")
    split = split.withColumn("place", place.cast("decimal(38,0)"))
    distinct = split.groupBy("line").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    lines = distinct.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("len"), F.xxhash64("line").alias("hash"), "first", "copies")
    path = work.path("lines")
    lines.write.option("compression", "zstd").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)

    links = line_links(lines, work)
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    roots = connected_components(links, work)
    slim = lines.select("id", "hash", "len", "first", "copies")
    linked = slim.join(degree, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    classes = linked.join(heads, "root").select("id", "hash", "len", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "head")
    occurrences = split.select("doc_id", "line_no", "place", F.xxhash64("line").alias("hash"), F.length("line").alias("len"), F.crc32("line").alias("crc"))
    crcs = lines.select("id", F.crc32("line").alias("crc"))
    found = occurrences.join(classes.join(crcs, "id"), ["hash", "len", "crc"])
    unit = F.lit(1 << 31).cast("decimal(10,0)")
    head_doc = F.floor(F.col("head") / unit).cast("long")
    return found.select("doc_id", F.col("line_no").cast("long"), "copies", "n_links", F.nullif(head_doc, F.lit(_LAST)).alias("class_doc_id"), (F.col("head") - head_doc.cast("decimal(20,0)") * unit).cast("long").alias("class_line_no"), (F.col("place") == F.col("head")).alias("kept"))
