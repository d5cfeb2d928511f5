import gzip
import hashlib
import io
import zlib

import pytest
from trailmark.llm import warc

SCHEMA = "page_id long, url string, html string, record string, _n int"
LONG = "x" * 100


def rows():
    out = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 7), "r", 1) for i in range(60)]
    out += [(70, "http://h/copy", LONG, "r", 1), (65, None, LONG, None, 1), (80, "http://a\r\nb", LONG, "r", 1), (65, None, LONG, None, 1)]
    out += [(90, "u", "short", "r", 1), (91, "u", "short", "r", 1), (92, None, None, None, None), (93, "u", "", "r", 1), (None, "u", LONG, "r", 1)]
    out += [(None, "u", "é" * 60, "r", 1), (None, "u", "é" * 60, "r", 1), (94, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "r", 1), (95, "u", "a" * 99, "r", 1), (96, "u", "a" * 99, "r", 1)]
    return out


def plain(some):
    """What each page is, from its own bytes."""
    first = {}
    for page, _, html, *_ in some:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html, *_ in some:
        body = (html or "").encode()
        again = body in first and page != first[body]
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def test_against_plain(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = warc.payload_digest(pages)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows())


def test_many_copies_by_shuffling(spark, monkeypatch):
    """A third of all pages has one payload, and nothing is broadcast but what is hot."""
    monkeypatch.setattr(warc, "bounded", lambda df: df)
    monkeypatch.setattr(warc, "SHARE", 0.2)
    some = [(i, "u", LONG if i % 3 == 0 else f"{i % 40}" * 80, "r", 1) for i in range(300, 0, -1)]
    assert sorted(map(tuple, warc.payload_digest(spark.createDataFrame(some, SCHEMA)).collect()), key=repr) == plain(some)


def test_nothing(spark):
    assert warc.payload_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_and_index(spark, tmp_path):
    """Whole-file streams in, a member a record out; every index row is a gzip file of its own."""
    pages = spark.createDataFrame(rows(), SCHEMA).coalesce(2)
    raw, to = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write(warc.records(pages), raw)
    for file in (tmp_path / "raw").glob("*.gz"):
        stream = zlib.decompressobj(31)
        stream.decompress(file.read_bytes())
        assert stream.eof and not stream.unused_data  # one stream, of many records
    index = warc.normalise(spark, raw, to)
    listed = index.orderBy("archive", "offset").collect()
    assert len(listed) == len(rows())
    upto = {}
    for r in listed:
        data = open(r.archive.removeprefix("file:"), "rb").read()
        assert r.offset == upto.get(r.archive, 0)
        upto[r.archive] = r.offset + r.length
        one = gzip.decompress(data[r.offset : r.offset + r.length])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and r.record_id.encode() in one
        assert len(one.split(b"\r\n\r\n", 1)[1]) == r.block_bytes + 4
    assert all(len(open(a.removeprefix("file:"), "rb").read()) == n for a, n in upto.items())
    found = warc.read(index, payloads=True).collect()
    assert sorted(r.payload for r in found if r.payload is not None) == sorted((h or "").encode() for (p, _, h, *_), kind in
                  zip(rows(), [next(x[3] for x in plain(rows()) if x[0] == r[0] and x[2] == hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows()], strict=True) if kind == "response")
    assert {r.target_uri for r in found} >= {"http://a%0D%0Ab", None}
    again = warc.normalise(spark, f"{to}/archives", str(tmp_path / "again"))  # members a record already
    assert sorted(r.block_bytes for r in again.collect()) == sorted(r.block_bytes for r in listed)


def test_large_records(spark):
    """Longer than any buffer, and in one archive with small ones."""
    big = "".join(chr(97 + i * i % 26) + str(i) for i in range(900_000))
    some = [(1, "u", big, "r", 1), (2, "u", "small", "r", 1), (3, "u", big + "!", "r", 1), (4, "u", big, "r", 1)]
    assert sorted(map(tuple, warc.payload_digest(spark.createDataFrame(some, SCHEMA).coalesce(1)).collect()), key=repr) == plain(some)


def foreign(*blocks, end=b"\r\n"):
    return b"".join(b"WARC/1.0" + end + b"WARC-Type: resource" + end + b"Content-Length: %d" % len(b) + end + end + b + b"\r\n\r\n" for b in blocks)


@pytest.mark.parametrize("pack", [gzip.compress, lambda x: x, lambda x: gzip.compress(x[:50]) + gzip.compress(x[50:]), lambda x: gzip.compress(x) + b"\0" * 9])
@pytest.mark.parametrize("end", [b"\r\n", b"\n"])
def test_other_streams(pack, end):
    """One member, none, members that cut records, padding; lines that end in LF alone."""
    sink = io.BytesIO()
    found = list(warc.rewrite(io.BytesIO(pack(foreign(b"a\n\nb", b"", b"c" * 3_000_000, end=end))), sink))
    assert [r[5] for r in found] == [4, 0, 3_000_000]
    offset, length = found[0][:2]
    assert gzip.decompress(sink.getvalue()[offset : offset + length]).endswith(b"a\n\nb\r\n\r\n")
    assert list(warc.rewrite(io.BytesIO(b""), sink)) == []


@pytest.mark.parametrize("bad", [gzip.compress(foreign(b"abc"))[:-12], gzip.compress(foreign(b"abc"))[:30] + b"??", gzip.compress(foreign(b"abc")[:-6]), gzip.compress(b"not a record\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")])
def test_damage_is_an_error(bad):
    with pytest.raises(warc.WarcError):
        list(warc.rewrite(io.BytesIO(bad), io.BytesIO()))
