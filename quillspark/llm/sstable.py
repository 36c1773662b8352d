"""Token ids in sorted-string-table shards: the file format, its writer and its reader.

File layout, all integers little-endian::

    magic "QSSTABL1"
    data block 0 .. n-1   each: zstd payload, then crc32 (u32) of the payload as stored
    index block           zstd of, per data block: last key, offset (u64), stored bytes (u32)
    filter block          Bloom filter bits over all keys
    meta block            JSON: counts, id width, filter shape, first and last key
    footer                offset and size of index, filter, meta (6 x u64), magic

A data block holds entries in key order: shared prefix length, rest of key length and value length
as varints, then the rest of the key and the value.  Every 16th entry is a restart: it shares no
prefix, and the list of restart offsets closes the block, so a lookup bisects the index, then the
restarts, and reads 16 entries at most.

Keys are 9 bytes: 0 and eight zero bytes for a null id, else 1 and the id big-endian with its sign
bit turned, so that byte order is numeric order, nulls first.  Values are token ids of 2 bytes (4
where the vocabulary needs it).
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs as pafs

MAGIC = b"QSSTABL1"
BLOCK_BYTES = 32 << 10
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & ((1 << 64) - 1), h >> 64 | 1


def _probes(first: np.ndarray, step: np.ndarray, n_bits: int) -> np.ndarray:
    """Filter bits of keys with these hashes (probes x keys)."""
    with np.errstate(over="ignore"):
        return (first + np.arange(PROBES, dtype=np.uint64)[:, None] * step) % np.uint64(n_bits)


class Writer:
    """Streams entries in key order to an output; memory is one block, the index and 16 bytes a key."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.entries, self.first, self.last = 0, b"", b""
        self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)
        self._fresh()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _fresh(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must not go down")
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first = self.first if self.entries else key
        self.last, self.in_block, self.entries = key, self.in_block + 1, self.entries + 1
        self.hashes.extend(_hash(key))
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.in_block:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            stored = self.pack.compress(raw)
            self.index.append((self.last, self.at, len(stored)))
            self._put(stored + struct.pack("<I", zlib.crc32(stored)))
        self._fresh()

    def close(self) -> dict:
        self._close_block()
        spots = []

        def section(data: bytes) -> None:
            spots.extend((self.at, len(data)))
            self._put(data)

        section(self.pack.compress(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", off, size) for k, off, size in self.index)))
        n_bits = max(64, BITS_PER_KEY * self.entries)
        bits, hashes = np.zeros(n_bits, bool), np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        bits[_probes(hashes[:, 0], hashes[:, 1], n_bits)] = True
        section(np.packbits(bits, bitorder="little").tobytes())
        meta = {"entries": self.entries, "tokens": self.n_tokens, "width": self.width, "filter_bits": n_bits, "blocks": len(self.index), "first": self.first.hex(), "last": self.last.hex()}
        section(json.dumps(meta).encode())
        self._put(struct.pack("<6Q", *spots) + MAGIC)
        return meta


class Table:
    """Reader of one file: whole scans in key order, or lookups by id."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        tail = self._read(end - 56, 56)
        if tail[48:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{uri} is no table of this format")
        spots = struct.unpack("<6Q", tail[:48])
        self.unpack = zstandard.ZstdDecompressor()
        self.meta = json.loads(self._read(*spots[4:6]))
        self._filter = spots[2:4]
        self._bits: np.ndarray | None = None
        raw, at, self.index = self.unpack.decompress(self._read(*spots[0:2])) if self.meta["blocks"] else b"", 0, []
        while at < len(raw):
            n = raw[at]
            self.index.append((raw[at + 1 : at + 1 + n], *struct.unpack_from("<QI", raw, at + 1 + n)))
            at += n + 13

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def close(self) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, size = self.index[k]
        stored = self._read(at, size + 4)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        raw = self.unpack.decompress(stored[:-4])
        (n,) = struct.unpack("<I", raw[-4:])
        return raw[: -4 - 4 * n], list(struct.unpack(f"<{n}I", raw[-4 - 4 * n : -4]))

    def _entries(self, body: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, np.frombuffer(body, f"<u{self.meta['width']}", size // self.meta["width"], at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._entries(self._block(k)[0]):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self._read(*self._filter), np.uint8), bitorder="little")
        first, step = (np.array([x], np.uint64) for x in _hash(key_of(doc_id)))
        return bool(self._bits[_probes(first, step, self.meta["filter_bits"])].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of every entry with this id (none: an empty list)."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        k = bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            body, restarts = self._block(k)
            spot = bisect_left(restarts, key, key=lambda r: next(self._entries(body, r))[0])
            for have, ids in self._entries(body, restarts[max(0, spot - 1)]):
                if have == key:
                    found.append(ids)
                elif have > key:
                    return found
            k += 1
        return found
