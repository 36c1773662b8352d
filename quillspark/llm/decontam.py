"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, the patterns the windows of ``window`` consecutive benchmark words (an item
of fewer words is one shorter pattern; each pattern length has its own machine).  A machine moves a
cursor over a document: the block of two words under it indexes the shift table, which says how far
the cursor can go because no pattern has that block any nearer to its end (12 words for a block that
no pattern has).  Shift 0 opens the suffix-hash bucket of the block, and its few test strings are
compared directly, byte by byte, with the words in the document.

Test strings are kept once, however many items share them, as sorted arrays: a worker needs about six
bytes for each benchmark byte.  The machines are a broadcast of bounded size: benchmark texts of up to
``PASS_BYTES`` make one pass.  A larger benchmark is dealt to several passes by a hash of the item; each
pass reads the documents and writes what it finds, by a hash of the text, and the finds are put together
at the end.  Documents are never written or shuffled (but for the join with more finds than
``BROADCAST_FINDS``, which Spark splits where a text is hot).

Defined results: a null text has no words, as has an empty one; such documents have n_words 0 and
no hit; null or wordless items have no windows; items that repeat a text are all reported; an item
with a null id is reported as ``null`` (like one whose id is that text), and items that share an id
count once; an empty benchmark or document table gives no hits or no rows; repeated document rows give
repeated results; other columns are not looked at.  Texts are read whole: a worker needs about 50 bytes
for each byte of its longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import Workspace
from .bytetext import LOWER, Texts, byte_class, distinct_spans, slices
from .lookup import whole_row

NOT_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WINDOW = 13
#: Benchmark bytes of one pass.
PASS_BYTES = 24 << 20
BROADCAST_FINDS = 100_000
_BLOCK_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _blocks(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit key of the block of ``width`` (1 or 2) words that ends at each word."""
    with np.errstate(over="ignore"):
        if width == 1:
            return hashes
        keys = np.zeros(len(hashes), np.uint64)
        keys[1:] = hashes[:-1] * _BLOCK_FACTOR + (hashes[1:] ^ (hashes[:-1] >> np.uint64(29)))
        return keys


class Patterns:
    """The benchmark's words in one row, joined by single blanks, and the items they belong to."""

    def __init__(self, items: list[tuple[str, str | None]]):
        raw = [(text or "").encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        texts = Texts(data, offsets, NOT_WORD)
        self.names, self.first, self.hashes = [name for name, _ in items], texts.first, texts.hashes()
        size = texts.ends - texts.starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.data = np.full(int(self.ends[-1]) + 1 if len(size) else 0, 0x20, np.uint8)
        self.data[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[np.arange(int(size.sum())) + np.repeat(texts.starts - (np.cumsum(size) - size), size)]

    def windows(self, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length in words: first words and items of all windows."""
        n_words = np.diff(self.first)
        for length in np.unique(np.minimum(n_words, window)).tolist():
            items = np.flatnonzero(np.minimum(n_words, window) == length)
            if length:
                n = n_words[items] - length + 1
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield length, np.repeat(self.first[items], n) + inside, np.repeat(items, n)


class Machine:
    """Shift table, suffix buckets and test strings of the patterns of one length (in words)."""

    def __init__(self, length: int, patterns: Patterns, at: np.ndarray, items: np.ndarray):
        self.length, self.width = length, min(2, length)
        one, kind = distinct_spans(patterns.data, patterns.starts[at], patterns.ends[at + length - 1])
        keys = _blocks(patterns.hashes, self.width)
        self.bits = max(16, min(24, (64 * length * max(1, len(one))).bit_length()))
        self.shifts = np.full(1 << self.bits, min(255, length - self.width + 1), np.uint8)
        for k in range(self.width - 1, length):  # smaller shifts come later
            self.shifts[(keys[at[one] + k] >> np.uint64(64 - self.bits)).astype(np.int64)] = length - 1 - k
        suffix = keys[at[one] + length - 1]
        order = np.argsort(suffix, kind="stable")  # strings of one bucket lie side by side
        self.suffixes, place = suffix[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.data = patterns.data.tobytes()
        self.begin, self.end = patterns.starts[at[one]][order], patterns.ends[at[one] + length - 1][order]
        of = np.unique(np.stack([place[kind], items]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        self.items, self.bounds = of[1], np.searchsorted(of[0], np.arange(len(order) + 1))

    def items_of(self, string: int) -> np.ndarray:
        return self.items[self.bounds[string] : self.bounds[string + 1]]

    def search(self, texts: Texts, lowered: bytes, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word, test string) of every occurrence."""
        keys = _blocks(hashes, self.width)
        shifts = self.shifts[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        ends = np.flatnonzero(shifts == 0)
        low = np.searchsorted(self.suffixes, keys[ends])
        real = low < len(self.suffixes)
        real[real] = self.suffixes[low[real]] == keys[ends[real]]
        buckets = dict(zip(ends[real].tolist(), zip(low[real].tolist(), np.searchsorted(self.suffixes, keys[ends[real]], side="right").tolist())))
        first, shifts = texts.first.tolist(), shifts.tobytes()
        for doc, (low, high) in enumerate(zip(first, first[1:])):
            at = low + self.length - 1
            while at < high:
                shift = shifts[at]
                if shift:
                    at += shift
                    continue
                if bucket := buckets.get(at):
                    begin = at - self.length + 1
                    found = b" ".join(lowered[a:b] for a, b in zip(texts.starts[begin : at + 1].tolist(), texts.ends[begin : at + 1].tolist()))
                    for string in range(*bucket):
                        if self.data[self.begin[string] : self.end[string]] == found:
                            yield doc, begin - low, string
                            break  # strings differ
                at += 1


def build(items: list[tuple[str, str | None]], window: int) -> tuple[list[Machine], list[str]]:
    """Machines for (item id, text) pairs; strings refer to items by their place in the list."""
    patterns = Patterns(items)
    return [Machine(n, patterns, at, of) for n, at, of in patterns.windows(window)], patterns.names


def _merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], machines, finds_only: bool, inside: str | None = None) -> Iterator[pa.RecordBatch]:
    """The columns but the text, spans, items and n_words; of all rows, or of those with a find."""
    found_by, names = machines.value
    for rows, data, offsets in slices(batches, inside=inside):
        data = LOWER[data]
        texts, lowered = Texts(data, offsets, NOT_WORD), data.tobytes()
        hashes = texts.hashes()
        spans: list[list] = [[] for _ in range(rows.num_rows)]
        items: list[set] = [set() for _ in range(rows.num_rows)]
        for machine in found_by:
            strings: dict[int, set[int]] = {}
            for doc, begin, string in machine.search(texts, lowered, hashes):
                spans[doc].append((begin, begin + machine.length))
                strings.setdefault(doc, set()).add(string)
            for doc, met in strings.items():
                for string in met:
                    items[doc].update(names[k] for k in machine.items_of(string).tolist())
        others = [c for c in rows.schema.names if c != "text"]
        out = pa.RecordBatch.from_arrays(
            [*(rows.column(rows.schema.get_field_index(c)) for c in others), pa.array([_merge(x) for x in spans], _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(texts.n_words.astype(np.int64))],
            names=[*others, "spans", "items", "n_words"],
        )
        yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if finds_only else out


def _joined_spans(lists: Column) -> Column:
    """Word ranges of several lists as one list of ranges that do not touch."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(s["a"] <= last["b"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(F.flatten(lists)), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), add)


_FOUND = "spans array<struct<a:bigint,b:bigint>>, items array<string>, n_words bigint"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, spans (merged word ranges a..b of the text that occur in items), items."""
    spark = docs.sparkSession
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 if size <= pass_bytes else -(-5 * size // (4 * pass_bytes))

    def machines(k: int):
        part = texts if passes == 1 else texts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        return spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], window))  # about pass_bytes

    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    if passes == 1:
        inside = "row" if text_col == f"{id_col}.text" else None  # the text comes with the row: it is not sent twice
        rows = rows.select("row") if inside else rows
        schema = StructType([rows.schema["row"], *StructType.fromDDL(_FOUND)])
        return rows.mapInArrow(partial(_scan, machines=machines(0), finds_only=False, inside=inside), schema).select(F.col("row").alias(id_col), "n_words", "spans", "items")

    work = work or Workspace(spark, "decontam")
    name = [F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1")]
    finds = None
    for k in range(passes):
        held = machines(k)
        found = rows.select(*name, "text").mapInArrow(partial(_scan, machines=held, finds_only=True), f"t0 long, t1 long, {_FOUND}")
        found = work.table(found.groupBy("t0", "t1").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), f"pass-{k}")
        finds = found if finds is None else finds.union(found)
        held.destroy()
    finds = work.table(finds.groupBy("t0", "t1").agg(_joined_spans(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "finds")  # a list a pass
    none = spark.sparkContext.broadcast(([], []))
    counted = rows.select(F.struct("row", *name).alias("row"), "text")
    counted = counted.mapInArrow(partial(_scan, machines=none, finds_only=False), StructType([counted.schema["row"], *StructType.fromDDL(_FOUND)])).select("row.*", "n_words")
    few = F.broadcast(finds) if finds.count() <= BROADCAST_FINDS else finds
    empty = {"spans": F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), "items": F.expr("cast(array() as array<string>)")}
    return counted.join(few, ["t0", "t1"], "left").select(F.col("row").alias(id_col), "n_words", *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def verdicts(found: DataFrame, percent: int = 5) -> DataFrame:
    """Hit words, items, their digest, and whether at least ``percent`` of 100 words are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    names = F.array_sort("items")
    others = [c for c in found.columns if c not in ("spans", "items")]
    out = found.select(*others, n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns, as they are) that are not contaminated; no join."""
    rows = docs.select(whole_row(docs).alias("__row"))
    found = verdicts(find_contamination(rows, benchmark, id_col="__row", text_col="__row.text", **options))
    return found.filter(~F.col("contaminated")).select("__row.*")
