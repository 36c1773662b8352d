"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds one bit a language, so the slots of
an n-gram, combined with AND, answer at once which languages contain it.  A document's n-grams give
a count of hits for each language (a popcount of that bit over the n-grams); the hits expected from
false positives of that language's slice are taken off, and the largest rest decides.

A language contains an n-gram if at least ``MIN_RATE`` of its training documents have it and that
share is at least ``SIBLING`` of the n-gram's share in any other language (labels are noisy: a few
foreign documents must not lend their n-grams).  Training takes at most about ``SAMPLE`` labelled
documents of each language, chosen by a hash of id and text (so that rows without an id, or with one id,
are chosen one by one): this is the documented bound of the fitting sample; document shares do not depend on it otherwise.  The number of n-grams kept, and so the size
of the filter that goes to the workers, is bounded by distinct n-grams a document / MIN_RATE,
whatever the input's size; the size is checked before it is sent.

Prediction reads every whole text once, without a shuffle, and sees nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if
no training document has a language; if a text has letters but no n-gram of any language, the
language with the most training documents is given with score 0; ties go to the first language in
order of name; a null doc_id is never held out; repeated rows and other columns do not matter.  Texts
are read whole: a worker needs about 100 bytes for each byte of its longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import byte_class, mix, slices, sums

ORDERS = (3, 4)
SAMPLE, MIN_RATE, SIBLING = 3000, 0.01, 0.25
PROBES, SLOTS_PER_GRAM = 3, 12
MAX_FILTER_BYTES = 64 << 20
UNDETERMINED = "und"
_SLICE = 1 << 20
_KEEP = byte_class((0x61, 0x7A), (0x80, 0xFF))
_LETTER = regex.compile(r"\p{L}")


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of lower-cased texts (runs of other characters are one space, as are both
    ends), and the bounds of each document's keys."""
    from .bytetext import text_bytes

    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    n_docs = len(offsets) - 1
    spaced = np.full(len(data) + n_docs + 1, 0x20, np.uint8)  # a space before each document and at the end
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    spaced[np.arange(len(data)) + doc + 1] = np.where(_KEEP[data], data, 0x20)
    edges = offsets + np.arange(n_docs + 1)
    space = spaced == 0x20
    keep = np.ones(len(spaced), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[edges] = True
    edge = np.zeros(len(spaced) + 1, bool)
    edge[edges] = True
    kept = np.flatnonzero(keep)
    closing = space[kept[:-1]] & edge[kept[1:]] & ~edge[kept[:-1]]  # the next document's space stands for it
    keep[kept[:-1][closing]] = False
    ranks = np.cumsum(keep) - 1
    flat, edges = spaced[keep].astype(np.uint64), ranks[edges]
    wide = np.zeros(len(flat), np.int64)
    wide[edges[:-1]] = 1
    owner = np.cumsum(wide) - 1
    keys, owners = [], []
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint64) << np.uint64(32)
        for k in range(n):
            key |= flat[k : k + m] << np.uint64(8 * k)
        last = np.minimum(edges[1:][owner[:m]], len(flat) - 1)
        inside = np.arange(m) + n - 1 <= last  # the space that begins the next document may close a gram
        keys.append(key[inside])
        owners.append(owner[:m][inside])
    key, own = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(own, kind="stable")
    return key[order], np.searchsorted(own[order], np.arange(n_docs + 1))


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (number of slots, bytes for one bit a language)
    false_rate: np.ndarray
    default: int

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Which languages contain each key: (keys, languages) of 0 and 1."""
        found = None
        for spot in _spots(keys, len(self.slots)):
            found = self.slots[spot] if found is None else found & self.slots[spot]
        return np.unpackbits(found, axis=1, bitorder="little")[:, : len(self.languages)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.to_pylist()
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        keys, bounds = grams(column)
        n = np.diff(bounds)[:, None]
        masks = self.masks(keys)
        hits = np.stack([sums(masks[:, k], bounds) for k in range(len(self.languages))], axis=1)
        rest = np.maximum((hits - n * self.false_rate) / (1 - self.false_rate), 0.0)
        rest[n[:, 0] == 0] = 0
        total, best = rest.sum(axis=1), rest.argmax(axis=1)
        best[total <= 0] = self.default
        share = np.where(total > 0, rest[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
        named = [self.languages[k] if t and _LETTER.search(t) else UNDETERMINED for k, t in zip(best.tolist(), texts)]
        return named, np.where(np.array(named) == UNDETERMINED, 0.0, np.clip(share, 0.0, 1.0))


def _spots(keys: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        with np.errstate(over="ignore"):
            yield ((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): in how many documents of the slice each n-gram is."""
    for rows, _, _ in slices(batches, limit=_SLICE):
        langs = rows.column(1).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        keys, bounds = grams(rows.column(0))
        doc = np.repeat(np.arange(len(code), dtype=np.uint64), np.diff(bounds))
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        tagged = keys[once] | code[doc[once].astype(np.int64)] << np.uint64(40)
        found, counts = np.unique(tagged, return_counts=True)
        lang = pa.DictionaryArray.from_arrays(pa.array((found >> np.uint64(40)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.array((found & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(counts)], names=["lang", "gram", "docs"])


def build_filter(languages: list[str], documents: dict[str, int], kept: list[tuple[str, np.ndarray]]) -> Filter:
    """Filter over each language's n-grams."""
    largest = max((len(g) for _, g in kept), default=0)
    slots = 1 << max(12, (SLOTS_PER_GRAM * largest).bit_length())
    width = max(1, -(-len(languages) // 8))
    if slots * width > MAX_FILTER_BYTES:
        raise ValueError(f"the filter would take {slots * width} bytes; raise MIN_RATE")
    table = np.zeros((slots, width), np.uint8)
    for lang, keys in kept:
        k = languages.index(lang)
        for spot in _spots(keys.astype(np.uint64), slots):
            table[spot, k // 8] |= np.uint8(1 << k % 8)
    fill = np.unpackbits(table, axis=1, bitorder="little")[:, : len(languages)].mean(axis=0) if languages else np.zeros(0)
    default = max(range(len(languages)), key=lambda k: (documents[languages[k]], -k), default=0)
    return Filter(languages, table, fill**PROBES, default)


def train(docs: DataFrame, sample: int = SAMPLE, min_rate: float = MIN_RATE, sibling: float = SIBLING) -> Filter:
    """``docs``: doc_id, text, lang."""
    labelled = docs.filter(F.col("lang").isNotNull())
    documents = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(documents)
    if not languages:
        return build_filter([], {}, [])
    cut = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, sample / documents[lang]) * (1 << 30))))])
    chosen = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample")), F.lit(1 << 30)) < cut[F.col("lang")])
    chosen = chosen.select("text", "lang")
    sizes = chosen.groupBy("lang").agg(F.count("*").alias("of"))
    counts = chosen.mapInArrow(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    rates = counts.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("docs") / F.col("of")).filter(F.col("rate") >= min_rate)
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    kept = best.select("gram", F.transform(F.filter("all", lambda x: x["rate"] >= sibling * F.col("best")), lambda x: x["lang"]).alias("langs"))
    found: dict[str, list[int]] = {lang: [] for lang in languages}
    for row in kept.toLocalIterator():  # bounded: see above
        for lang in row["langs"]:
            found[lang].append(row["gram"])
    return build_filter(languages, documents, [(lang, np.array(sorted(g), np.int64)) for lang, g in found.items()])


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in slices(batches, limit=_SLICE):
        named, scores = model.value.predict(rows.column(rows.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(named, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on documents whose crc32(id as text) mod ``folds`` is not ``held``; predict all."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(slim.filter(~F.col("held_out")), **options))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return slim.select("doc_id", "held_out", "text").mapInArrow(partial(_predict, model=model), schema)
