"""Periodic runs of words: stretches of a text that repeat one sequence of words, found and collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least
``max(min_length, exponent * q)`` words, which no neighbouring word extends with that period.

Repeated k-gram masking: a run overlaps itself, shifted by its period, in at least k words, k being the
least ``max(min_length, exponent * q) - q`` over all q.  So every word of a run lies in a k-gram that
the document holds twice, and words outside such k-grams are masked by one sort of rolling hashes; two
k-grams that share a hash only leave more words.  What survives are segments; no run crosses their
ends.  The Main-Lorentz division finds the runs of the segments alone: it halves them, and for each
centre and each period up to 1/exponent of the half's parent it extends the equality of words that far
apart to both sides.  All centres of a level are extended at once.  Lengths of extension come from names of
blocks of 1, 2, 4, ... words, equal exactly if the words are (made by sorting pairs of names), so no hash decides.

One pass over the documents, no shuffle: every document is judged alone, so no key can be hot.

Defined results: a null, empty or blank text has no words and no runs and collapses to an empty text;
repeated rows give repeated results; an empty table gives an empty result; further columns do not
matter (the id column is carried as it is, nulls included).  Texts are never cut: a worker needs about
20 bytes for each byte of its longest text and 4 * log2(words) + 100 bytes for each word that survives the mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACE, Texts, distinct_spans, mix, slices, window_hashes

MIN_LENGTH, EXPONENT = 6, 4
_COPY_WORDS = 1 << 16
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def overlap(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """k: in how many words a run overlaps itself at least, shifted by its period."""
    if exponent < 2 or min_length < 2:
        raise ValueError("a run repeats its words: exponent and min_length must be 2 or more")
    return max(1, min(max(min_length, exponent * q) - q for q in range(1, min_length + 1)))


def survivors(words: Texts, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document holds at least twice (a few others may, too)."""
    total = len(doc)
    if total < k:
        return np.zeros(total, bool)
    inside = np.flatnonzero(doc[: total - k + 1] == doc[k - 1 :])
    keys = window_hashes(words.hashes(), k)[inside] ^ mix(~doc.astype(np.uint64))[inside]
    order = np.argsort(keys)
    met = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][met]] = True
    again[order[:-1][met]] = True
    change = np.zeros(total + 1, np.int32)
    at = inside[again]
    change[at] += 1
    change[at + k] -= 1
    return np.cumsum(change[:-1]) > 0


def block_names(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """For widths 1, 2, 4, ... up to ``longest``: a name for the block at every place, equal for equal blocks.

    The last value must occur nowhere else: blocks that run over the end are equal to none.
    """
    table, width = [np.unique(values, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * width <= longest:
        last = table[-1].astype(np.int64)
        pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
        named = np.unique(pairs, return_inverse=True)[1]
        table.append(np.concatenate([named, len(pairs) + np.arange(width)]).astype(np.int32))
        width *= 2
    return table


def _ahead(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values are equal from places a and b on."""
    n = np.zeros(len(a), np.int64)
    for j in reversed(range(len(table))):
        n += (table[j][a + n] == table[j][b + n]).astype(np.int64) << j
    return n


def _behind(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values are equal before places a and b (a < b)."""
    n = np.zeros(len(a), np.int64)
    for j in reversed(range(len(table))):
        x, y = a - n - (1 << j), b - n - (1 << j)
        n += ((x >= 0) & (table[j][np.maximum(x, 0)] == table[j][y])).astype(np.int64) << j
    return n


def main_lorentz(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs inside the segments; values between segments must occur once only.

    A run lies whole in the part at whose centre it is cut first, so its period is at most 1/exponent of
    that part, and of the pairs (centre, centre + period) and (centre - period, centre) it holds one at least.
    """
    low, high = begins, ends
    table = block_names(values, int((ends - begins).max(initial=1)))
    found = [np.zeros((0, 3), np.int64)]
    while True:
        wide = high - low >= min_length
        low, high = low[wide], high[wide]
        if not len(low):
            break
        centre, most = (low + high) // 2, (high - low) // exponent
        c = np.repeat(centre, most)
        p = np.arange(len(c)) - np.repeat(np.cumsum(most) - most, most) + 1
        for at in (c, c - p):
            held = table[0][at] == table[0][at + p]
            i, q = at[held], p[held]
            start, end = i - _behind(table, i, i + q), i + _ahead(table, i, i + q) + q
            good = end - start >= np.maximum(min_length, exponent * q)
            found.append(np.column_stack([start, end, q])[good])
        low, high = np.concatenate([low, centre]), np.concatenate([centre, high])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # equal spans: the other periods are multiples of the smallest
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def find(words: Texts, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (word places in the slice) and period of all runs, by start and period."""
    doc = words.doc_of_word()
    mask = survivors(words, doc, overlap(min_length, exponent))
    edge = np.ones(len(doc) + 1, bool)
    edge[1:-1] = (mask[1:] != mask[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.flatnonzero(edge)
    begins, ends = cuts[:-1], cuts[1:]
    kept = mask[begins] & (ends - begins >= min_length) if len(doc) else np.zeros(0, bool)
    begins, sizes = begins[kept], (ends - begins)[kept]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3
    # One place before each segment and one after the last hold values that occur nowhere else.
    spots = np.cumsum(sizes + 1) - sizes
    values = -1 - np.arange(int(sizes.sum()) + len(sizes) + 1)
    at = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    place = np.arange(len(at)) + np.repeat(spots - (np.cumsum(sizes) - sizes), sizes)
    values[place] = distinct_spans(words.data, words.starts[at], words.ends[at])[1]
    start, end, period = main_lorentz(values, spots, spots + sizes, min_length, exponent)
    shift = (begins - spots)[np.searchsorted(spots, start, side="right") - 1]
    return start + shift, end + shift, period


def _joined(words: Texts, kept: np.ndarray) -> pa.Array:
    """The kept words of each document with one space between them."""
    chosen = np.flatnonzero(kept)
    bounds = np.searchsorted(chosen, words.first)
    sizes = words.ends[chosen] - words.starts[chosen] + 1  # with the space after it
    places = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    out = np.full(int(places[-1]), 0x20, np.uint8)
    for k in range(0, len(chosen), _COPY_WORDS):
        some, n = chosen[k : k + _COPY_WORDS], sizes[k : k + _COPY_WORDS] - 1
        ahead = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(places[k : k + len(n)], n) + ahead] = words.data[np.repeat(words.starts[some], n) + ahead]
    last = places[bounds[1:]][bounds[1:] > bounds[:-1]] - 1  # no space after a document's last word
    keep = np.ones(len(out), bool)
    keep[last] = False
    offsets = places[bounds] - np.concatenate([[0], np.cumsum(bounds[1:] > bounds[:-1])])
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def _detect(batches: Iterator[pa.RecordBatch], min_length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        words = Texts(data, offsets, SPACE)
        start, end, period = find(words, min_length, exponent)
        doc = np.searchsorted(words.first, start, side="right") - 1
        runs = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
        change = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)), runs)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.n_words.astype(np.int64)), lists, _joined(words, np.cumsum(change[:-1]) == 0)], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed.

    ``collapsed``: the words, one space between them, without those that a run holds after its first period.
    """
    overlap(min_length, exponent)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return slim.mapInArrow(partial(_detect, min_length=min_length, exponent=exponent), schema)


def digests(found: DataFrame) -> DataFrame:
    """One flat row a document: how many runs, the longest (ties: smallest start, then period), and sha256 of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    flat = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return flat.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with planted runs: where crc32(doc_id) % 10 = 0, the text's tail repeats a few of its words.

    Of n words those from a = g % n on become word a + (i - a) % p of the text, g = crc32 div 10 and
    p = 1 + (n - a) div (3 + g % 8).  Other rows, and those without id or words, keep their text.
    """
    words = F.when(F.expr("crc32(cast(doc_id AS string)) % 10 = 0"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", words.alias("__w"), F.expr("crc32(cast(doc_id AS string)) div 10").alias("__g"))
    cut = cut.withColumn("__n", F.size("__w")).withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    cut = cut.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(__w, cast(__a + 1 AS int), cast(__p AS int)), cast((__n - __a) div __p + 1 AS int))), 1, cast(__n - __a AS int))")
    joined = F.array_join(F.concat(F.expr("slice(__w, 1, cast(__a AS int))"), tail), " ")
    return cut.select("doc_id", F.when(F.col("__n") > 0, joined).otherwise(F.col("text")).alias("text"))
