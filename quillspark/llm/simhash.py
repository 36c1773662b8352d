"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, Hamming check, components.

Fingerprints are made where the documents are (Arrow, whole texts) and written once; from then on
only (document, fingerprint) pairs of 16 bytes move.  Copies collapse first: all later work is on
distinct fingerprints.

Pigeonhole: the 64 bits are cut into ``BLOCKS`` = 4 blocks of 16.  Two fingerprints that differ in at
most 2 bits agree in at least 2 blocks, so they share one of the 6 two-block keys of 32 bits.  The
join is on that key and verifies ``bit_count(a ^ b) <= 2``.

A key that more than ``CROWD`` distinct fingerprints share would give a number of pairs that grows
with its square.  Such keys take another exact way: inside one key only the 32 free bits differ, and
two members are within 2 bits exactly if the balls of radius 1 around them (the member and its 32
one-bit changes) meet; so each member is hung to every point of its ball and the members that meet
in a point are linked to the smallest of them.  That is 33 rows for a member instead of pairs, and
a point can be reached from 33 members at most, so no group is unbounded and no link is lost.

``similar_components`` is the form for a similarity threshold: texts whose sets of word shingles have a
Jaccard similarity of at least ``SIMILARITY`` are linked, no others.  At 0.8 about one bit in seven of
a fingerprint differs, so no blocks of bits are sure to be shared; candidates come from the shingles:

* All sets are put in one order, rare shingles first (``_common``: classes of frequency from a sample
  of documents; any order is exact, a good one keeps common passages out of the way).  Two sets that
  are similar enough have their first common shingle within the first n - ceil(0.8 n) + 1 of each, and
  at places that leave room for the overlap they need (prefix and positional filter).
* First come the SimHash links: the fingerprint of a set (64 bits of the hashes of its shingles), the same pigeonhole blocks, 2 bits;
  of those the pairs that are similar enough are the components that the rounds start from.  The rounds add what
  fingerprints cannot reach.
* In ``PIVOTS`` rounds the members of a key are compared with one member of each class of sizes that
  could be similar (three classes for each member): the one with the fewest rarer shingles, which is, of
  a group of copies, the one they are made from.  What is linked becomes one component.  After the rounds
  all pairs that are left and not in one component are compared, at the first key that both have
  (``EARLIER``), so a pair leaves the join once.  A large group of copies costs a few comparisons a
  member, and no pair that could matter is left out; sets that share keys with a large group and belong
  to none (similarity a little under the threshold) still cost a comparison of two bit strings with each
  member.
* The fingerprint of a set is ``PARITIES`` bits or more, in proportion to its size (bit i: whether an odd
  number of shingles falls on i).  Those of two sets, folded to one length, differ in no more bits than
  the sets differ in shingles: the Hamming check drops most false candidates and no link; whole sets decide.

Equal sets collapse first.  Shingles are compared by 64-bit hashes.

Defined results: a text without words (null, empty, white space) has fingerprint zero, which links
like any other, and an empty set, which is similar to empty sets only; fewer words than the shingle
length make one shingle of all of them; repeated doc_ids give a row each; a null doc_id never becomes a
component id unless all ids of its component are null; an empty table gives an empty result; other
columns of the input are not looked at.  Texts are read whole: fingerprints take a worker a few bytes
for each byte of its longest text, shingle sets about 60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .bytetext import ASCII_LOWER, LOWER, SPACE, Texts, mix, slices, span_hashes, window_hashes
from .components import connected_components
from .lookup import whole_row

BLOCKS, BITS = 4, 16
#: From so many distinct fingerprints in one block key the ball way is cheaper than pairs.
CROWD = 24
#: Jaccard similarity of shingle sets from which texts are near copies, as a fraction.
SIMILARITY = (4, 5)
#: Rounds in which the members of a key are compared with one of them, before all pairs that are left.
PIVOTS = 2
#: Documents (about) whose shingles are counted to find common ones, and how many of these are kept.
SAMPLE, COMMON = 10_000, 200_000
PARITIES = 512
#: Keys before the one that two sets meet in which the last join looks for an earlier meeting.
EARLIER = 64
#: Keys of rows (24 bytes each) up to which they are broadcast; beyond it, a shuffled join.
BROADCAST_IDS = 500_000
_GROUP = 1 << 16


def _sums(text: bytes, shingle: int, seed: int, words64: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit (64 bits for each of ``words64``), and how many there are."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(64 * words64, np.int64), 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64 * words64, np.int64)
    for at in range(0, n, _GROUP):  # bounded memory for very long texts
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + _GROUP], ends[at : at + _GROUP])), np.uint64)
        if words64 > 1:
            with np.errstate(over="ignore"):
                hashes = mix(hashes[:, None] + np.arange(words64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8 * words64), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones, n


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """SimHash of lower-cased words; a shingle counts as often as it occurs; a bit needs over half."""
    ones, n = _sums(text, shingle, seed, 1)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The same with 512 bits, from eight mixes of each hash; as eight signed longs."""
    ones, n = _sums(text, shingle, seed, 8)
    return np.packbits(2 * ones > n, bitorder="little").view("<i8")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        raw, at = data.tobytes(), offsets.tolist()
        prints = np.fromiter((fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_fingerprints, shingle=shingle), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within ``distance`` bits of each other."""
    if distance != 2:
        raise ValueError("the block scheme is laid out for a distance of 2 bits")
    masks = [sum(((1 << BITS) - 1) << (BITS * b) for b in pair) for pair in combinations(range(BLOCKS), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    keyed = distinct.select("fp", F.inline(keys).alias("block", "key"))
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = keyed.join(sizes, ["block", "key"])
    few = shared.filter(F.col("members") <= CROWD)
    left, right = few.select("block", "key", F.col("fp").alias("u")), few.select("block", "key", F.col("fp").alias("v"))
    pairs = left.join(right, ["block", "key"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")

    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    flips = [F.array(*[F.lit(v) for v in [0, *((1 << b) - (1 << 64 if b == 63 else 0) for b in bits)]]) for bits in free]
    chosen = F.element_at(F.array(*flips), F.col("block") + 1)
    balls = shared.filter(F.col("members") > CROWD).select("block", "fp", F.explode(chosen).alias("flip"))
    points = balls.select("block", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp").groupBy("block", "point").agg(F.sort_array(F.collect_list("fp")).alias("met"))
    hung = points.filter(F.size("met") > 1).select(F.col("met")[0].alias("u"), F.explode(F.slice("met", 2, 64)).alias("v"))
    return pairs.union(hung)


def simhash_components(docs: DataFrame, shingle: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    work = work or Workspace(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = work.table(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(_links(distinct.select("fp"), distance), work)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, bytes, list[int], list[np.ndarray]]]:
    """Rows, their bytes and offsets, and of each the sorted distinct hashes of its shingles."""
    for rows, data, offsets in slices(batches):
        texts = Texts(LOWER[data], offsets, SPACE)
        words, first = texts.hashes(), texts.first
        windows, short = window_hashes(words, shingle), (texts.n_words > 0) & (texts.n_words < shingle)
        whole, sets = iter(span_hashes(words, first[:-1][short], first[1:][short])), []
        for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            sets.append(np.array([next(whole)], np.uint64) if short[k] else np.unique(windows[a : max(a, b - shingle + 1)]))
        yield rows, data.tobytes(), offsets.tolist(), sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The first column and the whole set."""
    for rows, _, _, sets in _shingle_sets(batches, shingle):
        yield pa.RecordBatch.from_arrays([rows.column(0), _lists(sets)], names=[rows.schema.names[0], "shingles"])


def _set_print(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed long; of the empty set zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _GROUP):
        ones += np.unpackbits(found[at : at + _GROUP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _rows(batches: Iterator[pa.RecordBatch], shingle: int, common: np.ndarray, classes: np.ndarray, similarity: tuple[int, int], wide: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, t0, t1, digest of the set, its size, SimHash of the set, first shingles in the common order, parities, fingerprint."""
    for rows, raw, at, sets in _shingle_sets(batches, shingle):
        digests, bits64, firsts, parities, prints = [], [], [], [], []
        for k, found in enumerate(sets):
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            bits64.append(_set_print(found))
            often = np.zeros(len(found), np.uint8)
            if len(common) and len(found):
                place = np.minimum(np.searchsorted(common, found), len(common) - 1)
                often = np.where(common[place] == found, classes[place], 0)
            n = len(found) - -(-similarity[0] * len(found) // similarity[1]) + 1 if len(found) else 0
            firsts.append(found[np.argsort(often, kind="stable")[:n]])
            bits = max(PARITIES, 1 << (2 * len(found) - 1).bit_length()) if len(found) else PARITIES
            odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            parities.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64))
            prints.append(wide_fingerprint(raw[at[k] : at[k + 1]], shingle).view(np.uint64) if wide else np.zeros(0, np.uint64))
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        sizes = pa.array(np.fromiter(map(len, sets), np.int64, len(sets)))
        columns = [rows.column(0), rows.column(1), rows.column(2), pa.array(d[:, 0]), pa.array(d[:, 1]), sizes, pa.array(bits64, pa.int64()), _lists(firsts), _lists(parities), _lists(prints)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t0", "t1", "d0", "d1", "n", "bits", "firsts", "odd", "fp"])


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, sorted, and the logarithm of how many.

    They decide an order only: what a sample misses costs time and no link.
    """
    every = max(1, texts.count() // SAMPLE)
    sets = texts.filter(F.pmod("t0", F.lit(every)) == 0).select("t0", "text").mapInArrow(partial(_set_rows, shingle=shingle), "t0 long, shingles array<long>")
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, n = counts["shingle"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], np.log2(n[order]).astype(np.uint8) if len(n) else np.zeros(0, np.uint8)


def _enough(overlap, a, b, similarity: tuple[int, int]):
    """Whether sets of sizes a and b with so many common members are similar enough."""
    return overlap * sum(similarity) >= similarity[0] * (a + b)


def _room(similarity: tuple[int, int]):
    """Whether u and v can be similar enough if their first common shingle is at places pu and pv."""
    return _enough(F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")), F.col("nu"), F.col("nv"), similarity)


def _shared_firsts(nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """key, id, n, p, own of the keys where two sets or more meet, one at a place for the shorter set."""
    keyed = nodes.select("id", "n", F.posexplode("firsts").alias("p", "key"))
    own = _enough(F.col("n") - F.col("p"), F.col("n"), F.col("n"), similarity)
    same = Window.partitionBy("key")
    met = keyed.withColumn("own", own).withColumn("members", F.count("*").over(same)).withColumn("any_own", F.max("own").over(same))
    return met.filter("members > 1 and any_own").select("key", "id", "n", "p", "own")


def _sides(left: DataFrame, right: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("n", "p", *more)], F.col("id").alias(x)) for df, x in ((left, "u"), (right, "v")))


def _class(n: Column, similarity: tuple[int, int]) -> Column:
    """Class of a size; sizes of sets that are similar enough are in the same or neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.01 * similarity[1] / similarity[0]))).cast("int")


def _with_pivots(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Rows of the keys whose members are in several components, each with the pivots of its neighbouring classes."""
    rows = rows.withColumn("class", _class(F.col("n"), similarity))
    chosen = rows.groupBy("key", "class").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max_by(F.struct("id", "n", "p", "root"), F.struct(-F.col("p"), "id")).alias("pivot"))
    by_key = chosen.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.map_from_entries(F.collect_list(F.struct("class", "pivot"))).alias("chosen"))  # as many entries as classes
    met = rows.join(by_key.filter("least <> most").select("key", "chosen"), "key")
    own = F.col("chosen")[F.col("class")]["id"] == F.col("id")
    near = F.filter(F.array(*[F.col("chosen")[F.col("class") + d] for d in (-1, 0, 1)]), lambda x: x.isNotNull() & (x["root"] != F.col("root")))
    return met.select("key", "id", "n", "p", "own", "root", own.alias("is_pivot"), near.alias("pivots"))


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int], work: Workspace, label: str) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets are similar enough."""
    slim = nodes.select("id", "n", "odd")
    both = pairs.join(slim.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("odd").alias("a")), "u").join(slim.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("odd").alias("b")), "v")
    pairs = work.table(both.filter(_few_odd(F.col("a"), F.col("b"), similarity)).select("u", "v", "nu", "nv"), f"{label}-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = work.table(nodes.select("id", "text").join(ids, "id", "left_semi").select("id", "text.t0", "text.t1"), f"{label}-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = texts.join(few, ["t0", "t1"]).select("id", "text").dropDuplicates(["id"])
    sets = work.table(found.mapInArrow(partial(_set_rows, shingle=shingle), "id long, shingles array<long>"), f"{label}-sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    links = work.table(both.filter(_enough(F.size(F.array_intersect("a", "b")), F.col("nu"), F.col("nv"), similarity)).select("u", "v"), f"{label}-links")
    for done in ("pairs", "wanted", "sets"):
        work.drop(f"{label}-{done}")
    return links


def _folded(odd: Column, longs: Column) -> Column:
    """Parities of fewer bits: the words that fall on one place, combined by exclusive or."""
    return F.when(F.size(odd) <= longs, odd).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), lambda k: F.aggregate(F.sequence(k, F.size(odd) - 1, longs), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(odd, j)))))


def _few_odd(a: Column, b: Column, similarity: tuple[int, int], longs: int | None = None) -> Column:
    """A bound that every link keeps: parities differ in no more bits than sets of nu and nv differ in members."""
    if longs:
        apart = F.lit(0)
        for k in range(longs):
            apart = apart + F.bit_count(a[k].bitwiseXOR(b[k]))
    else:
        least = F.least(F.size(a), F.size(b))
        apart = F.aggregate(F.zip_with(_folded(a, least), _folded(b, least), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    both = F.col("nu") + F.col("nv")
    return _enough(both - apart, both, both, similarity)  # apart = both - 2 * overlap at most


def _contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the components known so far, and what makes up these."""
    named = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    both = links.join(named[0], "u", "left").join(named[1], "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    return both.filter("u <> v").distinct().union(roots.select("node", "root"))


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are equal or within 2 bits; sets with one fingerprint meet the first of them, which stands for them."""
    first = nodes.groupBy("bits").agg(F.min("id").alias("first_id"))
    same = nodes.join(first, "bits").filter("id <> first_id").select(F.col("id").alias("u"), F.col("first_id").alias("v"))
    links, of = _links(first.select(F.col("bits").alias("fp")), 2), lambda x: first.select(F.col("bits").alias(x), F.col("first_id").alias(f"low_{x}"))
    return same.union(links.join(of("u"), "u").join(of("v"), "v").select("low_u", "low_v"))


def _similar_roots(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int], work: Workspace) -> DataFrame:
    """(node, root) of the sets in ``nodes`` that are linked to a smaller one."""
    verify = partial(_verified, nodes=nodes, texts=texts, shingle=shingle, similarity=similarity, work=work)
    near = verify(_ordered(work.table(_near_prints(nodes), "near-prints")), label="prints")
    roots = connected_components(near, work, "roots-prints")
    shared = work.table(_shared_firsts(nodes, similarity), "firsts")
    for k in range(PIVOTS + 1):
        rooted = shared.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rooted = work.table(_with_pivots(rooted, similarity), f"open-{k}")
        work.drop(f"open-{k - 1}" if k else "firsts")
        if rooted.isEmpty():
            break
        if k < PIVOTS:
            each = rooted.select("n", "p", "id", F.explode("pivots").alias("x"))
            met = each.select(F.col("n").alias("nv"), F.col("p").alias("pv"), F.col("id").alias("v"), F.col("x.n").alias("nu"), F.col("x.p").alias("pu"), F.col("x.id").alias("u"))
            pairs = met.filter(_room(similarity))
            shared = rooted.filter("not is_pivot").select("key", "id", "n", "p", "own")  # the pivot has been compared with all that are near
        else:
            before, odd = F.slice("firsts", 1, F.least(F.col("p"), F.lit(EARLIER))), _folded(F.col("odd"), F.lit(PARITIES // 64))
            rows = rooted.join(nodes.select("id", "odd", "firsts"), "id").select("key", "id", "n", "p", "own", "root", odd.alias("odd"), before.alias("before"))
            left, right = _sides(rows.filter("own"), rows, "own", "root", "odd", "before")
            apart = (F.col("rootu") != F.col("rootv")) & (~F.col("ownv") | (F.col("u") < F.col("v")))
            first = ~F.arrays_overlap("beforeu", "beforev")  # at a later key the pair has been met already
            pairs = left.join(right, "key").filter(apart & _room(similarity) & _few_odd(F.col("oddu"), F.col("oddv"), similarity, PARITIES // 64) & first)
        roots = connected_components(_contracted(verify(_ordered(pairs), label=f"round-{k}"), roots), work, f"roots-{k}")
    return roots


def _named(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What a row is known by: doc_id, and two hashes of the text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1")]


def _similar(docs: DataFrame, shingle: int, similarity: tuple[int, int], id_col: str, text_col: str, work: Workspace, wide: bool) -> DataFrame:
    """doc_id, t0, t1, fp of every row, and ``head``: the smallest (id is null, doc_id, t0, t1) of its component."""
    texts = docs.select(*_named(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    common, classes = _common(texts, shingle)
    kind = texts.schema["doc_id"].dataType.simpleString()
    each = partial(_rows, shingle=shingle, common=common, classes=classes, similarity=similarity, wide=wide)
    rows = work.table(texts.mapInArrow(each, f"doc_id {kind}, t0 long, t1 long, d0 long, d1 long, n long, bits long, firsts array<long>, odd array<long>, fp array<long>"), "rows")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t0", "t1")
    distinct = rows.groupBy("d0", "d1").agg(F.min(row).alias("low"), F.min(F.struct("t0", "t1")).alias("text"), *[F.first(c).alias(c) for c in ("n", "bits", "firsts", "odd")])
    nodes = work.table(distinct.withColumn("id", F.monotonically_increasing_id()), "sets")
    roots = _similar_roots(nodes, texts, shingle, similarity, work)
    rooted = nodes.select("id", "d0", "d1", "low").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("head"))
    return rows.select("doc_id", "t0", "t1", "fp", "d0", "d1").join(rooted.join(lows, "root").select("d0", "d1", "head"), ["d0", "d1"]).select("doc_id", "t0", "t1", "fp", "head")


def similar_components(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (128 hex digits), component_id over links of texts with so similar shingle sets."""
    work = work or Workspace(docs.sparkSession, "similar")
    digits = F.array_join(F.transform("fp", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return _similar(docs, shingle, similarity, id_col, text_col, work, True).select("doc_id", digits.alias("fingerprint"), F.col("head.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` (all columns, as they are): of each component of similar texts one row stays.

    That is the row with the smallest doc_id (nulls last; of one id the smallest hash of the text).
    Rows that repeat both id and text are copies, of which the first by the other columns stays; rows
    that share an id only are told apart by their texts.
    """
    spark = docs.sparkSession
    work, passing = Workspace(spark, "near-duplicates"), Workspace(spark, "similar")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t0") == F.col("head.t0")) & (F.col("t1") == F.col("head.t1"))
    found = work.table(_similar(docs, shingle, similarity, "doc_id", "text", passing, False).select("doc_id", "t0", "t1", stays.alias("stays")), "decisions")
    passing.drop()

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return rows.join(few, rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows["t0"] == few["t0"]) & (rows["t1"] == few["t1"]), how)

    go = work.table(found.filter("not stays").select("doc_id", "t0", "t1").distinct(), "go")
    repeated = work.table(found.filter("stays").groupBy("doc_id", "t0", "t1").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "t0", "t1"), "repeated")
    packed = docs.select(*_named(docs, "doc_id", "text"), whole_row(docs).alias("row"))
    known = matching(packed, go, "left_anti")
    if repeated.isEmpty():
        return known.select("row.*")
    once = matching(known, repeated, "left_semi").groupBy("doc_id", "t0", "t1").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return matching(known, repeated, "left_anti").select("row.*").union(once.select("row.*"))
