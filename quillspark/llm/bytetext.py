"""Vectorised byte-level text helpers shared by the Arrow operators of this subpackage.

Everything works on the UTF-8 bytes of whole documents, a few megabytes at a time, so memory is
bounded by the slice size plus the longest single document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
#: Rolling windows multiply by this modulo 2**64; the entries there are already well mixed.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes up to which spans are hashed and compared side by side; longer ones one by one.
_LONG = 256
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_tables: dict[int, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: 1 for the bytes inside any of the inclusive ranges."""
    table = np.zeros(256, np.uint8)
    for lo, hi in ranges:
        table[lo : hi + 1] = 1
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LOWER = bytes(LOWER)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (the table is kept and grown by doubling)."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
        _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _as_bytes(values: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """The eight bytes from every place of ``values`` on, as one number; ``places`` counted in bytes."""
    raw, width = np.ascontiguousarray(values).view(np.uint8), values.dtype.itemsize
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,)), *(p.astype(np.int64) * width for p in places)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every values[start:end] (bytes or code points), eight bytes at a time.

    Where equality decides a result, use ``distinct_spans``, which compares the values themselves.
    """
    eights, at, sizes = _as_bytes(values, starts, ends - starts)
    out, done = mix(sizes.astype(np.uint64) + np.uint64(_BASE)), 0
    live = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    while len(live):
        out[live] = mix(out[live] ^ (eights[at[live] + done] & _LOW[np.minimum(sizes[live] - done, 8)]))
        done += 8
        live = live[sizes[live] > done]
    raw = np.ascontiguousarray(values).view(np.uint8)
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + sizes[k]])
    return out


def spans_differ(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, of: np.ndarray | None = None) -> bool:
    """Whether any values[start:start+size] is not equal to of[other:other+size] (``of``: default values)."""
    mine, a, n = _as_bytes(values, starts, sizes)
    theirs, b = (mine, others.astype(np.int64) * values.dtype.itemsize) if of is None else _as_bytes(of, others)
    done, live = 0, np.flatnonzero((n > 0) & (n <= _LONG))
    while len(live):
        low = _LOW[np.minimum(n[live] - done, 8)]
        if ((mine[a[live] + done] ^ theirs[b[live] + done]) & low).any():
            return True
        done += 8
        live = live[n[live] > done]
    of = values if of is None else of
    return any(not np.array_equal(values[starts[k] : starts[k] + sizes[k]], of[others[k] : others[k] + sizes[k]]) for k in np.flatnonzero(n > _LONG).tolist())


def distinct_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One span of each kind, and which kind each span is; equal exactly if their values are equal."""
    sizes = ends - starts
    _, first, kind = np.unique(span_hashes(values, starts, ends) if hashes is None else hashes, return_index=True, return_inverse=True)
    copies = np.flatnonzero(first[kind] != np.arange(len(kind)))
    of = first[kind[copies]]
    if (sizes[copies] != sizes[of]).any() or spans_differ(values, starts[copies], sizes[copies], starts[of]):
        kinds: dict[bytes, int] = {}  # two kinds share a hash: tell them apart by their bytes
        named = [kinds.setdefault(values[a:b].tobytes(), len(kinds)) for a, b in zip(starts.tolist(), ends.tolist())]
        _, first, kind = np.unique(np.array(named, np.int64), return_index=True, return_inverse=True)
    return first, kind


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every run of n consecutive well-mixed entries (length len(hashes) - n + 1, or 0)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=prefix[1:])
        return mix((prefix[n:] - prefix[:m]) * powers(_INV, m) + np.uint64(n))


class Texts:
    """The documents of one slice: their bytes, offsets, and the words found in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, np.int8)  # padded at both sides
        inside[1:-1] = 1 - separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        left = inside[:-1].astype(bool)
        right = inside[1:].astype(bool)
        self.starts = np.flatnonzero(right & (~left | edge))
        self.ends = np.flatnonzero(left & (~right | edge))
        self.first = np.searchsorted(self.starts, offsets)  # words of document d: first[d]:first[d+1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and which kind each word is, by comparison of their bytes."""
        return distinct_spans(self.data, self.starts, self.ends)

    def per_doc(self, of_bytes: np.ndarray) -> np.ndarray:
        return sums(of_bytes, self.offsets)

    def per_doc_words(self, of_words: np.ndarray) -> np.ndarray:
        return sums(of_words, self.first)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=prefix[1:])
    return prefix[bounds[1:]] - prefix[bounds[:-1]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and len+1 offsets into them starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and len(buf) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, inside: str | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of whole rows of about ``limit`` bytes of text; yields rows, bytes, offsets.

    ``inside``: the struct column that holds the text, where whole rows are carried and their text is not sent twice.
    """
    for batch in batches:
        held = batch.column(batch.schema.get_field_index(inside or column))
        data, offsets = text_bytes(pc.struct_field(held, column) if inside else held)
        del held
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, data, offsets
    _give_back()


def _give_back() -> None:
    """A worker that waits for its next task keeps no freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
