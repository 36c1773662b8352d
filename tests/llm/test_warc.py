import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from quillspark.llm import warc, zipread

SCHEMA = "page_id long, url string, html string, digest string, first string"


def test_round_trip_and_revisits(spark):
    pages = [(9, "http://a/é", "<p>ü</p>"), (3, None, "same"), (5, "u", "same"), (4, "u\r\nX: y", "same"), (1, "u", None), (2, "u", ""), (7, "u", "big " * 30_000), (None, "u", "same")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], SCHEMA).repartition(3)
    packages = warc.write_packages(df, package_bytes=100)
    got = {r.page_id: r for r in warc.read_packages(packages).collect()}
    want = {3: None, 5: 3, 4: 3, 1: None, 2: 1, 7: None, 9: None, None: 3}
    assert set(got) == set(want)
    for page, _, html in pages:
        data = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if want[page] is None else ("revisit", want[page]))


def test_least_size_and_odd_inputs(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcdef", "", ""), (4, "u", "abcdef", "", "")], SCHEMA)
    kinds = {r.page_id: r.record_type for r in warc.read_packages(warc.write_packages(df, min_bytes=5)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_packages(warc.write_packages(df.limit(0))).collect() == []
    same = spark.createDataFrame([(1, "u", "ab", "", ""), (1, "u", "ab", "", ""), (None, None, None, None, None), (None, None, None, None, None)], SCHEMA)
    assert {r.record_type for r in warc.read_packages(warc.write_packages(same)).collect()} == {"response"}


def hand_made(path, records, index_name="indexes/own.cdx.gz"):
    """A package of another maker: two archive members, one of them of plain records, one compressed index."""
    lines = [b"!meta 0 {}"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for member, packed in (("archive/one.warc.gz", True), ("archive/two.warc", False)):
            data = b""
            for raw in records:
                raw = gzip.compress(raw) if packed else raw
                lines.append(b'com,a)/ 20240101000000 {"offset": "%d", "length": %d, "filename": "%s"}' % (len(data), len(raw), member.removeprefix("archive/").encode()))
                data += raw
            z.writestr(member, data)
        z.writestr(index_name, gzip.compress(b"\n".join(lines)), zipfile.ZIP_DEFLATED)


def test_packages_of_other_makers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\npayload"

    def record(kind, digest, block=http):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    good = "sha1:" + warc.payload_digest(b"payload")
    hand_made(tmp_path / "good.zip", [record("warcinfo", "sha1:", b"software: x"), record("response", good), record("response", "md5:abc")])
    packages = spark.createDataFrame([(f"file://{tmp_path}/good.zip", 3)], "path string, records long")
    got = warc.read_packages(packages).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.url) for r in got] == [(None, 7, good[5:], "response", "http://a/")] * 4
    hand_made(tmp_path / "bad.zip", [record("response", "sha1:" + warc.payload_digest(b"other"))])
    with pytest.raises(Exception, match="not the one of the digest"):
        warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/bad.zip", 1)], "path string, records long")).collect()


def test_sort_keys():
    assert warc.sort_key("http://www.A.com:80/x y?Q=1#f") == "com,a,www)/xy?q=1" and warc.sort_key("") == ")/" and warc.sort_key("http://[") == "http://["


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_reader_against_zipfile(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    out = Buffer()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(6):
            with z.open(f"archive/{k}", "w", force_zip64=True) as f:
                f.write(bytes([65 + k]) * (300 * k + 5))
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    r = zipread.ZipRanges(out)
    assert list(r.members) == [f"archive/{k}" for k in range(6)] + ["deflated"]
    for k in range(6):
        assert r.read(f"archive/{k}") == bytes([65 + k]) * (300 * k + 5) and r.read(f"archive/{k}", 2, 3) == bytes([65 + k]) * 3
    with pytest.raises(ValueError, match="stored"):
        r.read("deflated")
    with pytest.raises(ValueError, match="range"):
        r.read("archive/0", 0, 6)
    with pytest.raises(ValueError, match="central directory"):
        zipread.ZipRanges(Buffer(b"no archive at all, but long enough"))
