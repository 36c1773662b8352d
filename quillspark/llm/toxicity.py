"""Toxicity: subword-bag embeddings, averaged, into a linear softmax over two classes.

A word is the bag of its character n-grams (3 to 6 bytes of the lower-cased word between two spaces), each hashed
to one of ``BUCKETS`` vectors; its vector is their mean, and a text's vector the mean of its words'.  That goes into
a linear softmax; vectors and softmax are trained jointly in numpy.  A misspelling that no training text has still
shares most of its n-grams, and so its vectors, with the word that is meant.

Because mean and linear layer commute, scoring needs one number a bucket (its vector times the difference of
the two classes' weights), which goes to the workers; the result is the softmax of the averaged vectors.

Training: at most about ``SAMPLE`` labelled documents and ``FIT_BYTES`` bytes of a class, chosen by a hash of
id and text; this is the documented bound of the fitting sample.  Their words are counted on the
executors and only counts reach the driver.  The share of the classes among all labelled documents is
put back into the softmax's bias.  Prediction reads every whole text once, without a shuffle, and sees
nothing but the text.

Defined results: a document whose doc_id has several labels counts with the one that most of them
give (ties: toxic); labels that are null or without a doc_id teach nothing; a null or empty text has no words and
gets the score of the bias alone; without labels of both classes every text gets the share of
toxic ones (0 if there is no label); a null doc_id is never held out; repeated rows and other columns do not
matter.  Texts are read whole: a worker needs about 100 bytes for each byte of its longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .bytetext import Texts, byte_class, mix, slices, text_bytes

ORDERS = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 17, 8
SAMPLE, FIT_BYTES = 3000, 12 << 20
EPOCHS, BATCH, RATE = 4, 64, 0.5
#: Share of the n-grams left out of each training step, so that no single one decides.
DROP = 0.5
#: The mean is taken over at least this many words, so that a few odd words alone decide nothing.
LEAST_WORDS = 4
#: The mean's scale, fixed: one word in ``GAIN`` counts as much as a whole text in a plain mean.
GAIN = 32.0
THRESHOLD = 0.3
_SLICE, _PIECE = 1 << 19, 1 << 14
_OTHER = 1 - byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, word by word, and the bounds of each word's buckets."""
    sizes = ends - starts
    wide = sizes + 2
    places = np.concatenate([[0], np.cumsum(wide)])
    flat = np.full(int(places[-1]) + 8, 0x20, np.uint8)
    ahead = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(places[:-1] + 1, sizes) + ahead] = data[np.repeat(starts, sizes) + ahead]
    eights = np.ndarray((int(places[-1]),), "<u8", flat, 0, (1,))
    left = np.repeat(places[1:], wide) - np.arange(int(places[-1]))  # bytes from here to the word's end
    word = np.repeat(np.arange(len(sizes)), wide)
    parts, owners, counts = [], [], []
    for n in ORDERS:
        at = np.flatnonzero(left >= n)
        parts.append(_bucket((eights[at] & np.uint64((1 << 8 * n) - 1)) ^ np.uint64(n << 56)))
        owners.append(word[at])
        counts.append(np.maximum(wide - n + 1, 0))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(parts)[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])


@dataclass
class Model:
    """bias: of the toxic class against the other; weight: of each bucket, likewise."""

    bias: float
    weight: np.ndarray | None
    constant: float | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weight is None:
            return np.full(len(column), self.constant)
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
        words = Texts(data, offsets, _OTHER)
        first, kind = words.kinds()
        buckets, bounds = subwords(data, words.starts[first], words.ends[first])
        per_word = np.zeros(len(buckets) + 1)
        np.cumsum(self.weight[buckets], out=per_word[1:])
        per_word = (per_word[bounds[1:]] - per_word[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        total = np.concatenate([[0.0], np.cumsum(per_word[kind])])[words.first]
        logit = self.bias + GAIN * np.diff(total) / np.maximum(words.n_words, LEAST_WORDS)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(texts: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, bounds: np.ndarray, seed: int = 1) -> tuple[float, np.ndarray]:
    """Train vectors and softmax jointly, on batches with as many texts of each class; returns bias and weight
    of the toxic class against the other.

    A text is a list of word numbers with their counts; buckets[bounds[w]:bounds[w+1]] are those of word w.
    Steps are scaled by the root of the squares so far (Adagrad), plus those of a common bucket: rare n-grams move little.
    """
    draw = np.random.default_rng(seed)
    vectors, softmax, bias = draw.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), draw.normal(0, 1 / DIM, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_s, seen_b, common = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32), 0.0
    spread, half = np.diff(bounds), BATCH // 2
    classes = [np.flatnonzero(labels == k) for k in (0, 1)]
    rounds = max(len(c) for c in classes) // half + 1
    for _ in range(EPOCHS):
        mixed = [np.concatenate([draw.permutation(c) for _ in range(rounds * half // len(c) + 1)]) for c in classes]
        for r in range(rounds):
            some = np.concatenate([m[r * half : (r + 1) * half] for m in mixed])
            sizes = np.array([len(texts[d]) for d in some])
            words, kind = np.unique(np.concatenate([texts[d] for d in some]), return_inverse=True)
            if not len(words):
                continue
            owner, times = np.repeat(np.arange(len(some)), sizes), np.concatenate([counts[d] for d in some]).astype(np.float32)
            share = GAIN * times / np.maximum(np.bincount(owner, times, len(some)), LEAST_WORDS)[owner]
            n = spread[words]
            starts = np.cumsum(n) - n
            grams = buckets[np.repeat(bounds[words] - starts, n) + np.arange(int(n.sum()))]
            used = (draw.random(len(grams)) >= DROP).astype(np.float32)[:, None] / np.float32(1 - DROP)
            of_words = np.add.reduceat(vectors[grams] * used, starts, axis=0) / n[:, None]
            flat = share[:, None] * of_words[kind]
            hidden = np.column_stack([np.bincount(owner, flat[:, k], len(some)) for k in range(DIM)]).astype(np.float32)
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            back = (p @ softmax.T)[owner] * share[:, None]
            step_s, step_b = hidden.T @ p, p.sum(axis=0)
            to_words = np.column_stack([np.bincount(kind, back[:, k], len(words)) for k in range(DIM)]) / n[:, None]
            to_grams = np.repeat(to_words, n, axis=0) * used
            spots, which = np.unique(grams, return_inverse=True)
            step_v = np.column_stack([np.bincount(which, to_grams[:, k], len(spots)) for k in range(DIM)]).astype(np.float32)
            square = (step_v**2).mean(axis=1)
            common += float(square.mean())
            seen_v[spots] += square
            seen_s += step_s**2
            seen_b += step_b**2
            vectors[spots] -= RATE * step_v / np.sqrt(seen_v[spots] + common)[:, None]
            softmax -= 0.1 * RATE * step_s / np.sqrt(seen_s)
            bias -= 0.1 * RATE * step_b / np.sqrt(seen_b)
    turn = softmax[:, 1] - softmax[:, 0]
    return float(bias[1] - bias[0]), (vectors @ turn).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, toxic, size, words, counts): the different words of each text and how often it has them."""
    for rows, _, _ in slices(batches, limit=_SLICE):
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(rows.column(0), "")))
        words = Texts(data, offsets, _OTHER)
        first, kind = words.kinds()
        found, times = np.unique(words.doc_of_word() * max(1, len(first)) + kind, return_counts=True)
        doc, kind = np.divmod(found, max(1, len(first)))
        bounds = pa.array(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32))
        raw = data.tobytes()
        named = np.array([raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())], object)
        lists = pa.ListArray.from_arrays(bounds, pa.array(named[kind].tolist(), pa.binary()))
        yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(np.diff(offsets)), lists, pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))], names=["draw", "toxic", "size", "words", "counts"])


def _share(total: int, wanted: int) -> float:
    return min(1.0, wanted / total) if total else 0.0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic.

    The sample is drawn from the labels first (so that it is small enough to be sent to the documents), then once
    more from the labelled rows found, which may be many where rows share an id.
    """
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.avg("toxic").alias("__share"))
    known = votes.select("doc_id", F.when(F.col("__share") >= 0.5, 1).otherwise(0).alias("toxic"))
    here = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of documents that may teach
    totals = {r["toxic"]: r["n"] for r in here.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(0.0, None, float(1 in totals))
    cut = F.when(F.col("toxic") == 1, F.lit(_share(totals[1], sample))).otherwise(F.lit(_share(totals[0], sample)))
    some = known.filter(_unit(F.col("doc_id")) < cut)
    work = Workspace(docs.sparkSession, "toxicity")
    try:
        met = docs.join(F.broadcast(some), "doc_id").select("text", _unit(F.col("doc_id"), F.col("text")).alias("draw"), "toxic")  # about 2 * sample ids
        rows = work.table(met.mapInArrow(_count, "draw double, toxic int, size long, words array<binary>, counts array<int>"), "words")
        found = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        if len(found) < 2:
            return Model(0.0, None, totals[1] / sum(totals.values()))
        rate = [min(_share(found[k]["n"], sample), _share(found[k]["bytes"], fit_bytes)) for k in (0, 1)]
        chosen = rows.filter(F.col("draw") < F.when(F.col("toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])))
        table = chosen.orderBy("draw", "size").select("toxic", "words", "counts").toArrow()  # bounded: see above
    finally:
        work.drop()
    marks = table.column("toxic").to_numpy().astype(np.int64)
    if len(np.unique(marks)) < 2:
        return Model(0.0, None, totals[1] / sum(totals.values()))
    lists = table.column("words").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    times = table.column("counts").combine_chunks()
    times = times.combine_chunks() if isinstance(times, pa.ChunkedArray) else times
    coded = lists.flatten().dictionary_encode()
    spots = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    number, count = coded.indices.to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(coded.dictionary.cast(pa.large_binary()).view(pa.large_string()))
    pieces = [subwords(data, offsets[:-1][k : k + _PIECE], offsets[1:][k : k + _PIECE]) for k in range(0, len(offsets) - 1, _PIECE)]
    buckets = np.concatenate([b for b, _ in pieces]) if pieces else np.zeros(0, np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in pieces]))]) if pieces else np.zeros(1, np.int64)
    parts = lambda v: [v[a:b] for a, b in zip(spots[:-1].tolist(), spots[1:].tolist())]
    bias, weight = fit(parts(number), parts(count), marks, buckets, bounds)
    return Model(bias + float(np.log(totals[1] / totals[0])), weight)


def _unit(*of) -> F.Column:
    """A number from 0 to 1 drawn by hash."""
    return F.pmod(F.xxhash64(*of, F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in slices(batches, limit=_SLICE):
        score = model.value.score(rows.column(rows.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def rate(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on labelled documents whose crc32(id as text) mod ``folds`` is not ``held``; score all."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    model = train(slim.filter(~F.col("held_out")).select("doc_id", "text"), labels.select("doc_id", "toxic"), **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return slim.mapInArrow(partial(_score, model=sent, threshold=threshold), schema)
