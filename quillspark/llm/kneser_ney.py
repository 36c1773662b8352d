"""Interpolated modified Kneser-Ney model of words, counted in Spark, scored from memory-mapped arrays.

Counting (every training document, whole texts, no count dropped):

1. Tasks count the words of their documents by 128-bit hashes (half of it is the key, half a check)
   and send, for each of the hash ranges, one packed block of sorted hashes with counts.  One task a
   range merges the blocks and writes a sorted array of the range: the vocabulary.  A word's number is
   its place over all ranges.  Words of a slice are told apart by their bytes; if two words of the
   corpus share a key but not the check, counting begins again with another seed, so none are merged.
2. Tasks turn documents into pairs of word numbers (beginning mark first, end mark last), count
   them under the bijective 64-bit mix of the pair, and again send packed blocks to ranges of the
   mix.  Mixing spreads the pairs of one frequent word over all ranges, so no range is hot, and
   blocks are summed before they are sent.  A task merges a range, writes its sorted hash array
   with counts, and sends on how many pairs of each first word occur once, twice, more often, and
   how many different words precede each second word.
3. Those are merged by ranges of word numbers into dense arrays.

All arrays are files in the shared folder; a file gets the name of the attempt that wrote it, and
only names in Spark's committed output are used.  Scoring workers map them into memory (a store
without local paths is read into memory instead) and look up a slice's distinct pairs at a time.

Model: p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * p1(w), with three discounts from the counts
of counts, and p1 the same over numbers of different preceding words, interpolated with 1 / (V + 1),
which leaves mass for unknown words.  An unknown or never continued context gives p1.

Defined results: a null text is an empty one (only the end mark); a null doc_id is in the training
part; without any training document the model is 1 / (V + 1) = 1; repeated rows count and are scored
as often as they occur; other columns are not looked at.  Texts are read whole; a worker needs about 80
bytes for each byte of its longest one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .bytetext import LOWER, SPACE, Texts, mix, slices

SLICE = 6 << 20
#: Entries that a counting task holds before it sends them.
HELD = 2_000_000
#: Bytes of text to a range of hashes, about: what one merging task holds follows from it.
RANGE_BYTES = 64 << 20
#: The end mark is counted as a word that no text holds.
_END = b" "
SEEDS = 8
_SHUFFLED = "bucket long, kind long, blob binary"


# --- packed blocks -------------------------------------------------------------------------------


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences, counts (n or n x k) as byte planes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    counts = np.ascontiguousarray(counts.astype("<u4").reshape(len(keys), -1))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.view(np.uint8).T.tobytes()
    return np.array([len(keys), counts.shape[1]], "<u8").tobytes() + zstandard.compress(planes, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    planes = np.frombuffer(zstandard.decompress(blob[16:]), np.uint8)
    with np.errstate(over="ignore"):
        keys = np.cumsum(np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(planes[8 * n :].reshape(4 * k, n).T).view("<u4").reshape(n, k).astype(np.int64)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts (n x k) of equal keys."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, 1), np.int64)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit space."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of ``mix``."""

    def unshift(v: np.ndarray, s: int) -> np.ndarray:
        out = v
        for _ in range(64 // s):
            out = v ^ (out >> np.uint64(s))
        return out

    with np.errstate(over="ignore"):
        x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return unshift(x, 30)


def _blocks(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of ``_SHUFFLED`` from keys sorted within ascending buckets."""
    names, first = np.unique(buckets, return_index=True)
    ends = np.append(first[1:], len(keys))
    blobs = [pack(keys[a:b], counts[a:b]) for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.full(len(names), kind, np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _counted(stream: Iterator[np.ndarray], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Count the keys of a stream of arrays; emit blocks whenever enough is held."""
    parts, held = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = merge(parts)
        return _blocks(keys, counts, bucket_of(keys, n_buckets))

    for keys in stream:
        parts.append(tuple(a if i == 0 else a.astype(np.int64)[:, None] for i, a in enumerate(np.unique(keys, return_counts=True))))
        held += len(parts[-1][0])
        if held >= HELD:
            yield flush()
            parts, held = [], 0
    if held:
        yield flush()


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays one after another; the returned name says where each one lies."""
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.bin"
    spots, at = [], 0
    with system.open_output_stream(f"{base}/{name}") as out:
        for key, a in arrays.items():
            data = np.ascontiguousarray(a).tobytes()
            pad = -len(data) % 8
            out.write(data + bytes(pad))
            spots.append(f"{key}:{a.dtype.str.lstrip('|')}:{at}:{len(a)}")
            at += len(data) + pad
    return f"{folder}/{name}|{'|'.join(spots)}"


def _load(saved: str) -> dict[str, np.ndarray]:
    uri, *spots = saved.split("|")
    system, path = pafs.FileSystem.from_uri(uri)
    if isinstance(system, pafs.LocalFileSystem):
        whole = np.memmap(path, np.uint8, "r") if system.get_file_info(path).size else np.zeros(0, np.uint8)
    else:
        with system.open_input_file(path) as f:
            whole = np.frombuffer(f.read(), np.uint8)
    out = {}
    for spot in spots:
        key, kind, at, n = spot.split(":")
        width = np.dtype(kind).itemsize
        out[key] = whole[int(at) : int(at) + int(n) * width].view(kind)
    return out


# --- documents to hashes and numbers -------------------------------------------------------------


class SharedHash(ValueError):
    """Two words of the corpus have one key."""


def key_of(word: bytes, seed: int) -> tuple[int, int]:
    """Key and check of a word."""
    h = xxhash.xxh3_128_intdigest(word, seed)
    return h >> 64, h & 0xFFFFFFFF


def _words(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Texts; the keys and checks of their distinct words and of the end mark (last), and which of them each word is."""
    lowered = LOWER[data]
    texts = Texts(lowered, offsets, SPACE)
    first, kind = texts.kinds()
    raw = lowered.tobytes()
    found = [key_of(raw[a:b], seed) for a, b in zip(texts.starts[first].tolist(), texts.ends[first].tolist())] + [key_of(_END, seed)]
    return texts, np.array([k for k, _ in found], np.uint64), np.array([c for _, c in found], np.int64), kind


def _with_ends(texts: Texts, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values of all words with ``end`` after each document, and where each document begins."""
    n_docs = len(texts.offsets) - 1
    begins = texts.first + np.arange(n_docs + 1)
    out = np.empty(len(values) + n_docs, values.dtype)
    out[np.arange(len(values)) + texts.doc_of_word()] = values
    out[begins[1:] - 1] = end
    return out, begins


def _count_words(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0

    def flush() -> pa.RecordBatch:
        keys, columns = _merge_checked(parts)
        return _blocks(keys, columns, bucket_of(keys, n))

    for _, data, offsets in slices(batches, limit=SLICE):
        _, keys, checks, kind = _words(data, offsets, seed)
        counts = np.append(np.bincount(kind, minlength=len(keys) - 1), len(offsets) - 1)
        parts.append((keys, np.stack([counts, checks], axis=1)))
        held += len(keys)
        if held >= HELD:
            yield flush()
            parts, held = [], 0
    if held:
        yield flush()


def _merge_checked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts (first column) of equal keys, whose checks (second column) have to be equal."""
    keys = np.concatenate([k for k, _ in parts])
    columns = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], columns[order]
    same = keys[1:] == keys[:-1]
    if (columns[1:][same, 1] != columns[:-1][same, 1]).any():
        raise SharedHash("two words have one key: count again with another seed")
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return keys[first], np.stack([np.add.reduceat(columns[:, 0], first), columns[first, 1]], axis=1)


class Vocabulary:
    """The sorted hash arrays; find() gives word numbers, the vocabulary size for unknown words + 1."""

    def __init__(self, saved: list[str | None], offsets: list[int]):
        self.n, self.offsets = len(saved), offsets
        self.shards = [_load(s) if s else None for s in saved]
        self.size = offsets[-1]

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Numbers of words by sorted keys and their checks; -1: unknown."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(bucket_of(hashes, self.n), np.arange(self.n + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and (shard := self.shards[k]) is not None:
                have = shard["keys"]
                at = np.minimum(np.searchsorted(have, hashes[a:b]), len(have) - 1)
                out[a:b] = np.where((have[at] == hashes[a:b]) & (shard["checks"][at] == checks[a:b]), at + self.offsets[k], -1)
        return out

    def numbers(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        order, out = np.argsort(keys, kind="stable"), np.empty(len(keys), np.int64)
        out[order] = self.find(keys[order], checks[order])
        return out


def _pairs(batches: Iterator[pa.RecordBatch], n: int, model: Model) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(model.words, model.offsets)
    begin = vocabulary.size

    def stream() -> Iterator[np.ndarray]:
        for _, data, offsets in slices(batches, limit=SLICE):
            texts, keys, checks, kind = _words(data, offsets, model.seed)
            numbers = vocabulary.numbers(keys, checks)
            last, begins = _with_ends(texts, numbers[kind], numbers[-1])
            yield mix(_pair_keys(last, begins, begin))

    yield from _counted(stream(), n)


def _pair_keys(last: np.ndarray, begins: np.ndarray, begin: int) -> np.ndarray:
    context = np.empty_like(last)
    context[1:] = last[:-1]
    context[begins[:-1]] = begin
    return (context.astype(np.uint64) << np.uint64(32)) | last.astype(np.uint64)


# --- merging tasks -------------------------------------------------------------------------------


def _merge_words(rows: pa.Table, folder: str) -> pa.Table:
    keys, columns = _merge_checked([unpack(b) for b in rows.column("blob").to_pylist()])
    counts = columns[:, 0]
    saved = _save(folder, "words", {"keys": keys, "counts": counts.astype(np.uint64), "checks": columns[:, 1].astype(np.uint32)})
    return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int64()), "saved": [saved], "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _merge_pairs(rows: pa.Table, folder: str, n: int, size: int) -> pa.Table:
    keys, counts = merge([unpack(b) for b in rows.column("blob").to_pylist()])
    counts = counts[:, 0]
    large = np.flatnonzero(counts >= 255)
    saved = _save(folder, "pairs", {"keys": keys, "counts": np.minimum(counts, 255).astype(np.uint8), "large": large, "large_counts": counts[large]})
    pairs = unmix(keys)
    context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    classes = np.stack([counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)
    out = []
    for kind, (numbers, values) in enumerate(((context, classes), (word, np.ones((len(keys), 1), np.int64)))):
        numbers, values = merge([(numbers, values)])
        out.append(_blocks(numbers, values, numbers.astype(np.int64) * n // (size + 1), kind))
    blocks = pa.Table.from_batches(out)
    rest = len(blocks)
    return pa.table({
        "bucket": pa.concat_arrays([pa.array([rows.column("bucket")[0].as_py()], pa.int64()), blocks.column("bucket").combine_chunks()]),
        "kind": pa.concat_arrays([pa.array([-1], pa.int64()), blocks.column("kind").combine_chunks()]),
        "blob": pa.concat_arrays([pa.array([None], pa.binary()), blocks.column("blob").combine_chunks()]),
        "saved": pa.array([saved] + [None] * rest, pa.string()),
        "tally": pa.array([_tally(counts)] + [None] * rest, pa.list_(pa.int64())),
    })


def _merge_stats(rows: pa.Table, folder: str, n: int, size: int) -> pa.Table:
    r = rows.column("bucket")[0].as_py()
    low, high = -(-r * (size + 1) // n), min(size + 1, -(-(r + 1) * (size + 1) // n))
    classes, before = np.zeros((high - low, 3), np.uint32), np.zeros(high - low, np.uint32)
    kinds, blobs = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
    for kind, target in ((0, classes), (1, before)):
        numbers, values = merge([unpack(b) for k, b in zip(kinds, blobs) if k == kind])
        if len(numbers):
            target[numbers.astype(np.int64) - low] = values if kind == 0 else values[:, 0]
    saved = _save(folder, "stats", {"once": classes[:, 0], "twice": classes[:, 1], "more": classes[:, 2], "before": before})
    three = int((before >= 3).sum())
    return pa.table({"bucket": pa.array([r], pa.int64()), "saved": [saved], "low": pa.array([low], pa.int64()), "total": pa.array([int(before.sum())], pa.int64()), "tally": pa.array([_tally(before) + [three]], pa.list_(pa.int64()))})


# --- the model -----------------------------------------------------------------------------------


@dataclass
class Model:
    """File names and totals; small (a few names a range), so it travels with the tasks."""

    words: list[str | None]
    offsets: list[int]
    n_tokens: int
    seed: int = 0
    pairs: list[str | None] | None = None
    stats: list[tuple[int, str]] | None = None
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    n_types: int = 0
    types_by_before: tuple[int, int, int] = (0, 0, 0)


def discounts(tally: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts 1..4; where a count is missing, the count below stands in."""
    one, two, three, four = (float(x) for x in tally)
    if not one or not two:
        return (0.5, 0.5, 0.5) if one or two else (0.0, 0.0, 0.0)
    y = one / (one + 2 * two)
    d1, d2 = 1 - 2 * y * two / one, 2 - 3 * y * three / two
    d3 = 3 - 4 * y * four / three if three else d2
    return tuple(min(max(d, 0.0), k) for d, k in ((d1, 1.0), (d2, 2.0), (d3, 3.0)))


def train(docs: DataFrame, work: Workspace, text_col: str = "text", ranges: int | None = None) -> Model:
    """Count the texts of ``docs``; ``ranges``: tasks that merge, by default one for ``RANGE_BYTES`` of text."""
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ranges or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    for seed in range(SEEDS):
        try:
            return _train(texts, work, n, seed)
        except Exception as problem:  # what a worker raises arrives in several classes
            if SharedHash.__name__ not in str(problem):
                raise
    raise SharedHash(f"words shared a key under each of {SEEDS} seeds")


def _train(texts: DataFrame, work: Workspace, n: int, seed: int) -> Model:
    folder = work.path("arrays")
    blocks = texts.mapInArrow(partial(_count_words, n=n, seed=seed), _SHUFFLED)
    words = work.table(blocks.groupBy("bucket").applyInArrow(lambda rows: _merge_words(rows, folder), "bucket long, saved string, n long, total long"), "words")
    saved: list[str | None] = [None] * n
    sizes, total = [0] * n, 0
    for row in words.collect():  # one row a range
        saved[row.bucket], sizes[row.bucket], total = row.saved, row.n, total + row.total
    offsets = [0, *np.cumsum(sizes).tolist()]
    model = Model(saved, offsets, total, seed)
    if not total:
        return model
    size = offsets[-1]
    if size >= (1 << 32) - 2:
        raise ValueError("more than 2**32 different words")

    blocks = texts.mapInArrow(partial(_pairs, n=n, model=model), _SHUFFLED)
    merged = work.table(blocks.groupBy("bucket").applyInArrow(lambda rows: _merge_pairs(rows, folder, n, size), f"{_SHUFFLED}, saved string, tally array<long>"), "pairs")
    model.pairs, tally = [None] * n, np.zeros(4, np.int64)
    for row in merged.filter("kind = -1").select("bucket", "saved", "tally").collect():  # one row a range
        model.pairs[row.bucket] = row.saved
        tally += row.tally
    model.discounts = discounts(tally.tolist())

    stats = merged.filter("kind >= 0").select("bucket", "kind", "blob").groupBy("bucket").applyInArrow(lambda rows: _merge_stats(rows, folder, n, size), "bucket long, saved string, low long, total long, tally array<long>")
    found = work.table(stats, "stats").collect()  # one row a range
    work.drop("pairs")
    tally = np.sum([r.tally for r in found], axis=0)
    model.stats = sorted((r.low, r.saved) for r in found)
    model.n_types = sum(r.total for r in found)
    model.base_discounts = discounts(tally[:4].tolist())
    model.types_by_before = (int(tally[0]), int(tally[1]), int(tally[4]))
    return model


class Scorer:
    """Looks the arrays up; memory-mapped, so workers of one machine share the pages."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.words, model.offsets)
        self.size = self.vocabulary.size
        self.pairs = [_load(s) if s else None for s in model.pairs or []]
        self.stats = [(low, _load(s)) for low, s in model.stats or []]
        self.end = int(self.vocabulary.numbers(*(np.array([x], kind) for x, kind in zip(key_of(_END, model.seed), (np.uint64, np.int64))))[0])

    def word_stats(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of sorted, known numbers (the beginning mark has the number ``size``)."""
        out = {k: np.zeros(len(numbers), np.float64) for k in ("once", "twice", "more", "before", "count")}
        lows = np.array([low for low, _ in self.stats] + [self.size + 1])
        cuts = np.searchsorted(numbers, lows)
        for (low, shard), a, b in zip(self.stats, cuts, cuts[1:]):
            for key in ("once", "twice", "more", "before"):
                out[key][a:b] = shard[key][numbers[a:b] - low]
        cuts = np.searchsorted(numbers, np.array(self.model.offsets))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                out["count"][a:b] = self.vocabulary.shards[k]["counts"][numbers[a:b] - self.model.offsets[k]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted mixed pair keys."""
        out, n = np.zeros(len(keys), np.float64), len(self.pairs)
        cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and (shard := self.pairs[k]) is not None:
                have = shard["keys"]
                at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                counts = shard["counts"][at].astype(np.float64)
                if (over := np.flatnonzero(counts == 255)).size:
                    counts[over] = shard["large_counts"][np.searchsorted(shard["large"], at[over])]
                out[a:b] = np.where(have[at] == keys[a:b], counts, 0)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        m, n_docs = self.model, len(offsets) - 1
        texts, keys, checks, kind = _words(data, offsets, m.seed)
        numbers = self.vocabulary.numbers(keys, checks)
        last, begins = _with_ends(texts, numbers[kind], self.end)
        known = last >= 0
        distinct, where = np.unique(last[known], return_inverse=True)
        stats = self.word_stats(distinct)
        spread = {k: np.zeros(len(last)) for k in ("before", "count")}
        for k, v in spread.items():
            v[known] = stats[k][where]

        base = np.log10((spread["count"] + 1) / (m.n_tokens + self.size + 1))
        one, two, three = m.base_discounts
        low = 1.0 / (self.size + 1)
        if m.n_types:
            rest = (one * m.types_by_before[0] + two * m.types_by_before[1] + three * m.types_by_before[2]) / m.n_types
            before = spread["before"]
            p = np.maximum(before - _discount(before, m.base_discounts), 0) / m.n_types + rest * low
        else:
            p = np.full(len(last), low)

        context = np.empty_like(last)
        context[1:] = last[:-1]
        context[begins[:-1]] = self.size
        has = np.flatnonzero(context >= 0)
        if m.pairs and len(has):
            distinct, where = np.unique(context[has], return_inverse=True)
            stats = self.word_stats(distinct)
            follow = stats["once"] + 2 * stats["twice"]  # only to see which contexts were continued
            total = np.where(distinct == self.size, self._documents(), stats["count"])
            mass = one_two_three(stats, m.discounts)
            usable = ((follow + stats["more"]) > 0)[where]
            has, where = has[usable], where[usable]
            counts = np.zeros(len(has))
            both = np.flatnonzero(last[has] >= 0)
            keys = mix((context[has[both]].astype(np.uint64) << np.uint64(32)) | last[has[both]].astype(np.uint64))
            unique, back = np.unique(keys, return_inverse=True)
            counts[both] = self.pair_counts(unique)[back]
            p[has] = (np.maximum(counts - _discount(counts, m.discounts), 0) + mass[where] * p[has]) / total[where]
        logs = np.log10(p)
        return {
            "n_tokens": np.diff(begins).astype(np.int64),
            "n_known": np.add.reduceat(known.astype(np.int64), begins[:-1]) if n_docs else np.zeros(0, np.int64),
            "base_score": np.add.reduceat(base, begins[:-1]) if n_docs else np.zeros(0),
            "score": np.add.reduceat(logs, begins[:-1]) if n_docs else np.zeros(0),
        }

    def _documents(self) -> float:
        return float(self.word_stats(np.array([self.end]))["count"][0]) if self.end >= 0 else 0.0


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def one_two_three(stats: dict[str, np.ndarray], d: tuple[float, float, float]) -> np.ndarray:
    return d[0] * stats["once"] + d[1] * stats["twice"] + d[2] * stats["more"]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for rows, data, offsets in slices(batches, limit=SLICE):
        found = scorer.score(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(v) for v in found.values())], names=["doc_id", "held_out", *found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` has doc_id, held_out, text; returns counts, base and model scores, and perplexity."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = docs.select("doc_id", "held_out", "text").mapInArrow(partial(_score, model=model), schema)
    return out.withColumn("train_tokens", F.lit(model.n_tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train_and_score(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """Train on the documents whose crc32(id as text) mod ``folds`` is not ``held``; score all."""
    work = work or Workspace(docs.sparkSession, "kneser-ney")
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return score(slim, train(slim.filter(~F.col("held_out")), work))

