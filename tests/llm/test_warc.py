import gzip
import hashlib
import io
import json
import tempfile
import zlib
from pathlib import Path

import pytest

from fieldroute.llm import warc
from fieldroute.session import table


def plain(rows):
    by = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            by[html] = min(i, by.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = by.get(html) if len(raw) >= 100 else None
        again = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def held(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ODD = [(1, "http://a/", "x" * 100), (2, "http://a/é b\r\nWARC-Type: x", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (None, "u", "x" * 100), (None, "u", "only " * 30), (None, "u", "only " * 30), (7, "u", "é" * 50), (0, "u", "é" * 50), (8, "u", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (9, "u", "long\r\n\r\n" * 400_000), (10, "u", "long\r\n\r\n" * 400_000), (11, "u", "twice " * 30), (11, "u", "twice " * 30)]


def test_whole_table(spark, sf):
    pages = table(spark, sf, "pages")
    assert held(warc.round_trip(pages, tempfile.mkdtemp())) == plain([tuple(r)[:3] for r in pages.collect()])


@pytest.mark.parametrize("archive_bytes", [1, 5_000, 64 << 20])
def test_odd_rows_and_payloads(spark, archive_bytes):
    rows = ODD + [(100 + i, "u", "a page that a third of all have " * 9) for i in range(300)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, size string, sha int").repartition(3)
    back = warc.read_archives(warc.write_archives(pages, tempfile.mkdtemp(), archive_bytes)).cache()
    assert held(back) == plain(rows)
    payload = {r.page_id: r.payload for r in back.where("record_type = 'response' and page_id is not null").collect()}
    assert all(payload[i] == (html or "").encode() for i, _, html in rows if i in payload)
    assert {r.uri for r in back.where("page_id = 2").collect()} == {"http://a/%C3%A9%20b%0D%0AWARC-Type:%20x"}
    assert [r.uri for r in back.where("page_id = 3").collect()] == [None]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, tempfile.mkdtemp()).count() == 0


def test_members_and_sidecar(spark):
    """A stream is one member; normalised, every record is a member of its own at the sidecar's place."""
    folder = tempfile.mkdtemp()
    pages = spark.createDataFrame([r for r in ODD if r[0]], "page_id long, url string, html string").coalesce(1)
    streams = warc.write_streams(warc.records(pages), f"{folder}/streams").collect()
    assert sum(r.records for r in streams) == len([r for r in ODD if r[0]])
    for r in streams:
        one = zlib.decompressobj(31)
        one.decompress(Path(r.archive).read_bytes())
        assert one.eof and not one.unused_data
    manifest = warc.normalise(spark.createDataFrame(streams), f"{folder}/archives").collect()
    assert sum(r.records for r in manifest) == sum(r.records + 1 for r in streams)  # each with its warcinfo
    for r in manifest:
        data = Path(r.archive).read_bytes()
        index = [json.loads(x) for x in Path(r.archive + ".idx").read_text().splitlines()]
        assert [x["at"] for x in index] == [sum(y["size"] for y in index[:i]) for i in range(len(index))] and sum(x["size"] for x in index) == len(data) == r.bytes
        for x in index:
            whole = gzip.decompress(data[x["at"] : x["at"] + x["size"]])
            assert whole.startswith(b"WARC/1.0\r\nWARC-Type: " + x["type"].encode()) and x["id"].encode() in whole
        assert gzip.decompress(data).count(b"\r\nWARC-Record-ID: ") == len(index)  # any gzip reader still reads the file whole


def test_streams_of_several_members_and_broken_ones():
    parts = [b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9000000\r\n\r\n" + b"q" * 9_000_000 + b"\r\n\r\n"]
    for data in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [w for _, w in warc.split_records(warc.inflate(io.BytesIO(data)))] == parts
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(io.BytesIO(data[:-12]))))
    assert list(warc.split_records(warc.inflate(io.BytesIO(b"")))) == []
    with pytest.raises(ValueError):
        list(warc.split_records([parts[0][:-1]]))


def test_wrong_digest_fails(spark):
    folder = tempfile.mkdtemp()
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, folder)
    name = manifest.first().archive
    index = [json.loads(x) for x in Path(name + ".idx").read_text().splitlines()]
    data, spot = Path(name).read_bytes(), index[1]
    bad = warc.member(gzip.decompress(data[spot["at"] :]).replace(b"text\r\n\r\n", b"tent\r\n\r\n"))
    Path(name).write_bytes(data[: spot["at"]] + bad)
    Path(name + ".idx").write_text("\n".join(json.dumps(x | ({"size": len(bad)} if x is spot else {})) for x in index) + "\n")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(manifest).collect()
