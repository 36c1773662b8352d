"""Range reader of ZIP archives: central directory, ZIP64 records, stored members, no extraction."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_EOCD, _LOCATOR, _EOCD64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_ALL32, _ALL16 = 0xFFFFFFFF, 0xFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int
    crc: int


class ZipRanges:
    """``file`` needs size(), seek() and read(); only the directory and what is asked for is read."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the archive is cut off")
        return data

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(_EOCD, 0, max(0, len(tail) - 22) + 4)  # a whole record must follow
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(_EOCD, 0, at + 3)  # the signature may also stand in the comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if (count == _ALL16 or size == _ALL32 or offset == _ALL32) and tail_at + at >= 20:
            locator = self._read(tail_at + at - 20, 20)
            if locator[:4] == _LOCATOR:
                record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != _EOCD64:
                    raise ValueError("no ZIP64 end of central directory")
                count, size, offset = struct.unpack_from("<QQQ", record, 32)
        raw, at, found = self._read(offset, size), 0, []
        for _ in range(count):
            if raw[at : at + 4] != _CENTRAL:
                raise ValueError("damaged central directory")
            method, _, _, crc, stored, full, n_name, n_extra, n_comment = struct.unpack_from("<HHHIIIHHH", raw, at + 10)
            (header_at,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, stored, header_at = self._wide(extra, full, stored, header_at)
            found.append(Member(name, method, full, stored, header_at, crc))
            at += 46 + n_name + n_extra + n_comment
        return found

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Replace the values that do not fit 32 bits by those of the ZIP64 field, in its order."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + n]
            at += 4 + n
        out, spot = [], 0
        for v in values:
            if v == _ALL32:
                (v,) = struct.unpack_from("<Q", wide, spot)
                spot += 8
            out.append(v)
        return out

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """Bytes of a stored member, from ``offset`` on."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored plainly")
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError("range outside the member")
        return self._read(self._start(member) + offset, size)

    def whole(self, name: str) -> bytes:
        """All of a member, also of one that is compressed (an index)."""
        member = self.members[name]
        if member.method == 0:
            return self.read(name)
        if member.method != 8:
            raise ValueError(f"{name} is packed by method {member.method}")
        return zlib.decompress(self._read(self._start(member), member.stored_size), -15)

    def _start(self, member: Member) -> int:
        """Where the bytes of a member begin."""
        name = member.name
        if name not in self._starts:
            head = self._read(member.header_at, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"no local header for {name}")
            self._starts[name] = member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self._starts[name]
