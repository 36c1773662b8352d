"""WARC records in ZIP packages: writer, and a reader that takes single records by range.

A package holds ``archive/data.warc.gz`` (one gzip member a record, stored plainly in the ZIP, so a
record can be read by its range) and ``indexes/index.cdxj`` (a line a record: sort key, time, and JSON
that names the archive member and the range).  The reader takes packages of other makers too: several
archive members, compressed or plain records, several indexes, plain or compressed.  It computes size
and digest of a response from the bytes and raises if the headers say something else.
Payloads that occur more than once are written once: the page with the smallest page_id gets the
``response``, the others a ``revisit`` that refers to it.  Payloads are found equal by SHA-1 and
length; the smallest id a payload is a partial aggregate, so a payload that a third of the pages
share costs one row a task, and the join back is one that Spark splits where a key is hot.

A task writes packages of bounded size under names of its own; only names in Spark's committed
output are read.

Defined results: a null html is an empty payload; pages with the smallest page_id of a payload are
all responses if that id is repeated; a null page_id never is the smallest unless all are null (then
all are responses); payloads under ``min_bytes`` are all responses; a null url is written as an
empty target; an empty table gives no package and an empty result; other columns are not looked at.
Pages are written and read whole, one at a time: a worker needs a few times the bytes of its longest one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .zipread import ZipRanges

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b"
_URN = "urn:quillspark:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case), payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def sort_key(url: str) -> str:
    """Host names turned round, so that those of one domain stand together, then the path; without blanks."""
    try:
        parts = urlsplit(url)
    except ValueError:  # no URL
        return "".join(url.lower().split())
    host = ",".join(reversed((parts.hostname or "").split(".")))
    path = urlunsplit(("", "", parts.path or "/", parts.query, "")).lower()
    return "".join(f"{host}){path}".split())


class Package:
    """Streams records to one package."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.data.write(packed)
        entry = {"url": url or "", "mime": "text/html", "status": "200", "offset": str(self.at), "length": str(len(packed)), "filename": DATA.rpartition("/")[2]}
        self.lines.append(f"{sort_key(url or '')} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "".join(x + "\n" for x in sorted(self.lines)))
        self.zip.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, package_bytes: int) -> Iterator[pa.RecordBatch]:
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    package, done = None, []

    def close() -> None:
        package.close()
        out.close()
        done.append((f"{folder}/{name}", len(package.lines)))

    for batch in batches:
        for page_id, url, html, first, shared in zip(*(c.to_pylist() for c in batch.columns)):
            if package is not None and package.at >= package_bytes:
                close()
                package = None
            if package is None:
                name = f"pages-{uuid.uuid4().hex}.zip"
                out = system.open_output_stream(f"{base}/{name}")
                package = Package(out)
            payload = (html or "").encode()
            revisit = bool(shared) and page_id != first
            package.add(page_id, url, record(page_id, url, payload, payload_digest(payload), first, revisit))
    if package is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])


def write_packages(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, work: Workspace | None = None) -> DataFrame:
    """Write the packages; returns their list: path, records."""
    work = work or Workspace(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", "url", html.alias("html"))
    keyed = slim.withColumn("digest", F.concat(F.sha1("html"), F.lit(":"), F.octet_length("html")))
    firsts = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first", F.lit(True).alias("shared"))
    told = keyed.join(firsts, "digest", "left").select("page_id", "url", "html", "first", "shared")
    return work.table(told.mapInArrow(partial(_write, folder=work.path("packages"), package_bytes=package_bytes), "path string, records long"), "list")


class PackageReader:
    """Records of one package by range."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.zip = ZipRanges(self.file)

    def index(self) -> list[dict]:
        """The entries of every index, in the order of the archives."""
        found = []
        for name in self.zip.members:
            if name.startswith("indexes/") and re.search(r"\.(cdxj?|json)(\.gz)?$", name):
                raw = self.zip.whole(name)
                for line in (gzip.decompress(raw) if raw[:2] == _GZIP else raw).decode().splitlines():
                    if "{" in line and not line.startswith("!"):  # the rest is a header
                        entry = json.loads(line[line.index("{") :])
                        found.append({"filename": entry.get("filename", ""), "offset": int(entry["offset"]), "length": int(entry["length"])})
        return sorted(found, key=lambda e: (e["filename"], e["offset"]))

    def record(self, entry: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        name = entry["filename"]
        member = name if name in self.zip.members else f"archive/{name}" if name else DATA
        raw = self.zip.read(member, entry["offset"], entry["length"])
        return parse(gzip.decompress(raw) if raw[:2] == _GZIP else raw)

    def close(self) -> None:
        self.file.close()


def _page(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").removeprefix(_URN)
    return int(found) if found.lstrip("-").isdigit() else None


def _payload(fields: dict[str, str], http: dict[str, str], payload: bytes, where: str) -> tuple[int, str]:
    """Size and digest: of a response those of its bytes, of a revisit (which has none) those it states."""
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2].upper()
    if fields["warc-type"] == "revisit":
        return int(http["content-length"]), stated
    size, digest = len(payload), payload_digest(payload)
    if fields.get("warc-payload-digest", "sha1:").lower().startswith("sha1:") and stated not in ("", digest):
        raise ValueError(f"the payload is not the one of the digest: {where}")
    if "content-length" in http and int(http["content-length"]) != size:
        raise ValueError(f"the payload is not as long as stated: {where}")
    return size, digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "package": pa.string()}
    for batch in batches:
        for path in batch.column(0).to_pylist():
            reader, rows = PackageReader(path), []
            entries = reader.index()
            for at, entry in enumerate(entries):
                fields, http, payload = reader.record(entry)
                kind = fields["warc-type"]
                if kind in ("response", "revisit"):  # others have no payload
                    size, digest = _payload(fields, http, payload, f"{path}, {entry}")
                    rows.append((_page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri", "").strip("<>"), path))
                if rows and (len(rows) == 5000 or at + 1 == len(entries)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
                    rows = []
            reader.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record, read back by range from the packages."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, package string"
    files = packages.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(_read, schema)
