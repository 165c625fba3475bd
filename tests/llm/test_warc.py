import base64
import gzip
import hashlib

import pytest
from conftest_llm import SF, rows
from pyarrow import fs

from spanlake.llm import common, queries, warc

COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(pages, least=0):
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and first.get(html or "") not in (None, i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_whole_table(spark):
    pages = [(r.page_id, r.html) for r in common.table(spark, SF, "pages").collect()]
    assert sorted(rows(queries.op9_warc_round_trip(spark, SF), *COLS), key=str) == brute(pages)


ODD = [(1, "http://a/", "<p>x</p>"), (5, "http://b/\r\nX: y", "<p>x</p>"), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (2, "u", None), (4, "", ""), (9, "é", "é漢\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>x</p>"), (None, "n", "alone"), (8, "long", "ab" * 400_000), (7, "zip", "\x1f\x08" * 5000)]


@pytest.mark.parametrize("step", [37, 1000, 1 << 20])
@pytest.mark.parametrize("least", [0, 9])
def test_odd_rows(spark, step, least):
    pages = spark.createDataFrame([(*r, "clash", 0) for r in ODD], "page_id long, url string, html string, d string, first long").repartition(3)
    path = common.new_path(spark, "warc")
    files = warc.write_warc(pages, path, min_revisit_bytes=least)
    got = warc.read_warc(spark, path, files, range_bytes=step)
    assert sorted(rows(got, *COLS), key=str) == brute([(i, h) for i, _, h in ODD], least)
    text = {r.page_id: r.html for r in got.filter("record_type = 'response' and page_id is not null").collect()}
    assert all(text[i] == (h or "") for i, _, h in ODD if i in text)


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.new_path(spark, "warc")
    assert warc.read_warc(spark, path, warc.write_warc(pages, path)).count() == 0


def test_magic_in_data_is_no_record(tmp_path):
    """Members stored without compression hold gzip members, even of WARC-like text, in their own data."""
    import zlib

    inner = warc.MAGIC * 50 + gzip.compress(b"not a record")

    def stored(k):
        head = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(inner))
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(head + inner + b"\r\n\r\n") + z.flush()

    data = [stored(k) for k in range(20)]
    (tmp_path / "f").write_bytes(b"".join(data))
    size, found = sum(map(len, data)), []
    for a in range(0, size, 101):
        found += [at for at, _ in warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "f"), a, a + 101)]
    assert found == [sum(map(len, data[:k])) for k in range(20)]


def test_records_of_other_versions(tmp_path):
    """Records of WARC/1.0 are found from any offset; a file without records is refused, an empty one has none."""
    data = [gzip.compress(b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" % k) for k in range(20)]
    (tmp_path / "f").write_bytes(b"".join(data))
    found = []
    for a in range(0, sum(map(len, data)), 101):
        found += [at for at, _ in warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "f"), a, a + 101)]
    assert found == [sum(map(len, data[:k])) for k in range(20)]
    (tmp_path / "g").write_bytes(b"no record" * 50)
    (tmp_path / "e").write_bytes(b"")
    assert list(warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "e"), 0, 101)) == []
    with pytest.raises(ValueError):
        list(warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "g"), 0, 101))


def test_archives_of_other_writers(spark, tmp_path):
    """Standard records of several types and both versions, uuid ids, split at many places."""
    body = b"<html>caf\xe9</html>"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 999\r\nOdd line\r\n\r\n" + body

    def rec(version, kind, ident, block, *more):
        head = [b"WARC/" + version, b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, b"Content-Length: %d" % len(block), *more]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")

    u = [b"<urn:uuid:00000000-0000-4000-8000-%012d>" % k for k in range(6)]
    members = [
        rec(b"1.0", b"warcinfo", u[0], b"software: x\r\n", b"content-type: application/warc-fields"),
        rec(b"1.0", b"request", u[1], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type: application/http; msgtype=request", b"WARC-Target-URI: http://a/"),
        rec(b"1.0", b"response", u[2], http, b"Content-Type: application/http; msgtype=response", b"WARC-Target-URI: http://a/", b"WARC-Payload-Digest: sha1:" + sha.encode()),
        rec(b"1.1", b"response", u[3], http + b"!", b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + sha.encode()),
        rec(b"1.1", b"revisit", u[4], b"HTTP/1.1 200 OK\r\n\r\n", b"Content-Type: application/http; msgtype=response", b"WARC-Refers-To: " + u[2], b"WARC-Payload-Digest: sha1:" + sha.encode()),
        rec(b"1.1", b"metadata", u[5], b"a: b\r\n", b"Content-Type: application/warc-fields"),
    ]
    data = b"".join(members)
    (tmp_path / "x.warc.gz").write_bytes(data)
    whole = list(warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "x.warc.gz"), 0, len(data)))
    assert len(whole) == 6
    for cut in range(len(members[0]), len(data)):
        parts = [warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "x.warc.gz"), *r) for r in ((0, cut), (cut, len(data)))]
        assert [x for p in parts for x in p] == whole
    files = spark.createDataFrame([("x.warc.gz", len(data))], "file string, bytes long")
    got = warc.read_warc(spark, f"file://{tmp_path}", files, range_bytes=400).orderBy("offset").collect()
    assert [r.record_id for r in got] == [x.decode() for x in u] and [r.page_id for r in got] == [None] * 6
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata"]
    assert [r.intact for r in got] == [None, None, True, False, None, None]
    assert got[2].html == "<html>caf�</html>" and got[2].payload_bytes == len(body) and got[2].payload_digest == sha
    assert got[4].refers_to_id == u[2].decode() and got[4].refers_to is None and got[0].html == "software: x\r\n"
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(gzip.decompress(data)))
    with pytest.raises(ValueError, match="more than a record"):
        [warc.parse(d) for _, d in warc.scan_range(fs.LocalFileSystem(), str(tmp_path / "y.warc.gz"), 0, 10**6)]
