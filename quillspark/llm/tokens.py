"""Encode documents and keep their token ids in sorted-string-table shards.

Documents are dealt to shards by ranges of their id and sorted there, so the shards follow one
another in id order and each is written in one pass by one task.  A task writes under a name of its
own (attempt and random part), and only the names that Spark's committed output lists are read, so a
retried or doubled task leaves at worst a file that nothing refers to.  The list of shards, one row
a file, gives each shard the number of ids before it.

Defined results: a null text is encoded as an empty one (only the end id); rows with one doc_id
each get an entry, ordered by a hash of the text (so an id that a third of the rows share is dealt to
many shards); null doc_ids come first; an empty table gives no shard and an empty result; other columns
are not looked at.  Texts are encoded whole; a long one in pieces that end where no token can cross.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .bytetext import distinct_spans, span_hashes, spans_differ
from .sstable import Table, Writer, key_of

#: Endings that byte-level BPE vocabularies keep with an apostrophe (fixed values, published with them).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens, and characters and ids in them, that a worker remembers (under 100 MB); beyond
#: either, it starts afresh.
REMEMBERED, REMEMBERED_UNITS = 1_000_000, 8_000_000
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_SLICE_CHARS = 512 << 10
#: Between a small letter and a blank before one, a new pre-token begins whatever stands around.
_SAFE = re.compile("[a-z](?= [a-z])")


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the library's own pre-token rule sees it (its Unicode tables may be older than Python's).

    Put between a letter and a digit, a letter stays with the one and a digit with the other; put between two
    other signs, white space stays with neither.  Asked once, on the driver.
    """
    from tokenizers import pre_tokenizers

    rule, step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), 1 << 11
    table = np.full(0x110000, _OTHER, np.uint8)

    def begins(left: str, right: str, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pre-token begins with each code point, and with the sign after it."""
        starts = np.zeros(3 * step, bool)
        starts[[at for _, (at, _) in rule.pre_tokenize_str("".join(left + chr(c) + right for c in range(low, low + step)))]] = True
        return starts[1::3], starts[2::3]

    for low in range(0, 0x110000, step):
        if not 0xD800 <= low < 0xE000:  # no text has these
            (alone, after), (apart, _) = begins("a", "1", low), begins("!", "!", low)
            table[low : low + step] = np.select([~alone, ~after, apart], [_LETTER, _DIGIT, _SPACE], _OTHER)
    table[0x20] = _SPACE  # the blank alone goes with what follows
    return table


class Traits(NamedTuple):
    """What the cut needs to know of a tokenizer file."""

    byte_level: bool
    added: tuple[str, ...]
    width: int
    classes: bytes  # compressed


def traits_of(path: str) -> Traits:
    """Read from the file, so that no worker has to hold its parsed form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
    added = spec.get("added_tokens", [])
    largest = max([t["id"] for t in added] + [k for k in (model["vocab"].values() if isinstance(model.get("vocab"), dict) else range(len(model.get("vocab", []))))], default=0)
    return Traits(bool(byte_level), tuple(t["content"] for t in added), 2 if largest < 1 << 16 else 4, zlib.compress(_classes().tobytes()) if byte_level else b"")


class _Pieces:
    """Short arrays laid end to end, found by place."""

    def __init__(self, kind):
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, kind), 0

    def insert(self, at: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Add pieces that lie in ``flat``, before the places ``at``."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), self.flat.dtype)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin = np.insert(self.begin, at, (self.used + begin).astype(np.int32))
        self.size = np.insert(self.size, at, size.astype(np.int32))
        self.used += len(flat)


class _Memory:
    """Pre-tokens known so far: sorted hashes, the characters and the ids of each."""

    def __init__(self, kind: np.dtype, width: int):
        self.kinds = kind, np.dtype(f"u{width}")
        self.forget()

    def forget(self) -> None:
        self.keys, self.points, self.ids = np.zeros(0, np.uint64), *(_Pieces(k) for k in self.kinds)


class Encoder:
    """The tokenizers library with a memory of pre-tokens.

    Byte-level BPE first cuts a text into pre-tokens: runs of letters, of digits, or of other signs,
    each with the one blank before it, endings after an apostrophe, and white space.  Merges never
    cross them, so encoding each distinct pre-token once and joining the ids is the library's own
    result.  The cut is made with numpy over half a million characters at a time; pre-tokens are found
    by a hash and compared by their characters, and the library sees only those that are new to the
    worker.  Where the tokenizer is of another
    kind, or a text holds one of its added tokens, the library encodes the whole text.
    """

    classes: np.ndarray | None = None
    kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str, traits: Traits | None = None) -> Encoder:
        """The worker's encoder, with what it remembers from earlier tasks."""
        if path not in cls.kept:
            cls.kept[path] = cls(path, traits)
        return cls.kept[path]

    def __init__(self, path: str, traits: Traits | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level, self.added, self.width, classes = traits or traits_of(path)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if self.byte_level and Encoder.classes is None:
            Encoder.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        #: By the bytes that a character takes in the slice's narrowest form.
        self.memory = {np.dtype(k): _Memory(np.dtype(k), self.width) for k in (np.uint8, np.uint16, np.uint32)}

    def _cut(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of texts laid end to end; ``bounds`` are the texts' bounds."""
        n, kind = len(points), self.classes[points]
        first = np.zeros(n + 1, bool)
        first[bounds] = True  # of a text
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        start[n] = True
        runs = np.flatnonzero(start)
        begin, end = runs[:-1], runs[1:]
        blank = kind[begin] == _SPACE
        last = end[blank][~first[end[blank]]]  # ends of white space that something follows
        start[last - 1] = True
        start[last[points[last - 1] == 32]] = False
        sign = begin[(points[begin] == 39) & (end - begin == 1)]
        sign = sign[start[sign] & ~first[sign + 1]]
        sign = sign[kind[sign + 1] == _LETTER]
        if len(sign):
            stop = runs[np.searchsorted(runs, sign + 1, side="right")]  # end of the letters that follow
            size = np.zeros(len(sign), np.int64)
            padded = np.append(points, [0, 0])
            for ending in reversed(ENDINGS):
                fits = stop - sign > len(ending)
                for k, c in enumerate(ending):
                    fits &= padded[np.minimum(sign + 1 + k, n)] == ord(c)
                size[fits] = len(ending)
            sign, stop, size = sign[size > 0], stop[size > 0], size[size > 0]
            start[sign + 1] = False
            inner = sign + 1 + size
            start[inner[inner < stop]] = True
        return np.flatnonzero(start[:n])

    def _learn(self, memory: _Memory, keys: np.ndarray, joined: str, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Encode new pre-tokens (keys in ascending order) that lie in a slice."""
        pieces = [joined[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
        plain = np.array([p.lstrip(" ").isalpha() for p in pieces], bool) & (len(self.newline) == 1)
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if len(words):  # on lines of their own: the line end is one known id and never part of a word
            found = np.array(self.tokenizer.encode("\n".join(pieces[k] for k in words.tolist()), add_special_tokens=False).ids, np.uint32)
            breaks = np.append(np.flatnonzero(found == self.newline[0]), len(found))
            flat.append(found[found != self.newline[0]])
            sizes.append(np.diff(breaks, prepend=-1) - 1)
        for k in others.tolist():
            flat.append(self._whole(pieces[k]))
            sizes.append(np.array([len(flat[-1])]))
        sizes, at = np.concatenate(sizes), np.searchsorted(memory.keys, keys)
        begins, place = np.cumsum(sizes) - sizes, np.argsort(np.concatenate([words, others]))
        memory.keys = np.insert(memory.keys, at, keys)
        memory.ids.insert(at, np.concatenate(flat), begins[place], sizes[place])
        total = np.cumsum(size)
        memory.points.insert(at, points[np.arange(total[-1]) + np.repeat(begin - (total - size), size)], total - size, size)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = self._cut(points, bounds)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        ends, top = np.append(starts[1:], len(points)), int(points.max())
        points = points.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
        memory = self.memory[points.dtype]
        hashes = span_hashes(points, starts, ends)
        first, which = distinct_spans(points, starts, ends, hashes)
        order = np.argsort(hashes[first], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        first, which = first[order], rank[which]
        keys = hashes[first]
        if (keys[1:] == keys[:-1]).any():  # two pre-tokens of this slice share a hash
            return [self._whole(t) for t in texts]
        if len(memory.keys) > REMEMBERED or max(memory.ids.used, memory.points.used) > REMEMBERED_UNITS:
            memory.forget()
        at = np.searchsorted(memory.keys, keys)
        known = at < len(memory.keys)
        known[known] = memory.keys[at[known]] == keys[known]
        begin, size, held = starts[first[known]], (ends - starts)[first[known]], at[known]
        if (size != memory.points.size[held]).any() or spans_differ(points, begin, size, memory.points.begin[held], memory.points.flat):
            memory.forget()  # one of them shares its hash with another pre-token of an earlier slice
            at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(memory, keys[new], joined, points, starts[first[new]], (ends - starts)[first[new]])
            at = np.searchsorted(memory.keys, keys)
        begin, size = memory.ids.begin[at][which].astype(np.int64), memory.ids.size[at][which].astype(np.int64)
        total = np.cumsum(size)
        flat = memory.ids.flat[np.arange(total[-1]) + np.repeat(begin - (total - size), size)].astype(np.uint32)
        return np.split(flat, np.concatenate([[0], total])[np.searchsorted(starts, bounds[1:-1])])

    def _one(self, text: str) -> Iterator[tuple[bool, str]]:
        """(last piece of the text, piece)."""
        at = 0
        while len(text) - at > _SLICE_CHARS and (cut := _SAFE.search(text, at + _SLICE_CHARS)):
            yield False, text[at : cut.end()]
            at = cut.end()
        yield True, text[at:]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order; a slice of half a million characters is held at a time."""
        pieces: list[tuple[bool, str]] = []
        held, begun = 0, []

        def flush() -> Iterator[np.ndarray]:
            for (last, _), ids in zip(pieces, self._encode_plain([p for _, p in pieces])):
                begun.append(ids)
                if last:
                    yield np.concatenate(begun)
                    begun.clear()
            pieces.clear()

        for text in texts:
            if not self.byte_level or any(x in text for x in self.added):
                yield from flush()
                held = 0
                yield self._whole(text)
                continue
            for last, piece in self._one(text):
                if held and held + len(piece) > _SLICE_CHARS:
                    yield from flush()
                    held = 0
                pieces.append((last, piece))
                held += len(piece)
        yield from flush()


_MANIFEST = "path string, part long, shard long, first_key string, last_key string, entries long, tokens long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, traits: Traits, end_id: int, max_entries: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    encoder, end = Encoder.of(tokenizer, traits), np.array([end_id], np.uint32)
    writer = out = None
    done: list[tuple] = []

    def close() -> None:
        meta = writer.close()
        out.close()
        done.append((f"{folder}/{name}", context.partitionId(), len(done), meta["first"], meta["last"], meta["entries"], meta["tokens"]))

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
            if writer is not None and writer.entries >= max_entries:
                close()
                writer = None
            if writer is None:
                name = f"tokens-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
                out = system.open_output_stream(f"{base}/{name}")
                writer = Writer(out, encoder.width if end_id < 1 << 16 else 4)
            writer.add(key_of(doc_id), np.concatenate([ids, end]))
    if writer is not None:
        close()
    columns = list(zip(*done)) or [[]] * 7
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "part", "shard", "first_key", "last_key", "entries", "tokens"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_entries: int = 1_000_000, work: Workspace | None = None) -> DataFrame:
    """Write the shards; returns the manifest: path, key range, entries, tokens, tokens_before."""
    work = work or Workspace(docs.sparkSession, "tokens")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("digest", F.xxhash64("text"))
    dealt = slim.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").select("doc_id", "text")
    listed = work.table(dealt.mapInArrow(partial(_write, folder=work.path("shards"), tokenizer=tokenizer, traits=traits_of(tokenizer), end_id=end_id, max_entries=max_entries), _MANIFEST), "manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table, rows = Table(path), []

            def packed() -> pa.RecordBatch:
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard_path"])

            for doc_id, ids in table:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                start += len(ids)
                if len(rows) == 10_000:
                    yield packed()
                    rows = []
            if rows:
                yield packed()
            table.close()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per entry, read back from the shards: doc_id, start, n_tokens, ids_crc32, shard_path."""
    files = manifest.select("path", "tokens_before")
    return files.repartition(max(1, files.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_path string")
