"""WARC archives: pages to records, whole-file gzip streams to one member a record, and back.

A crawler that pipes its archive through gzip leaves one stream a file, which can only be
read from its start. The normaliser inflates such a stream once, piece by piece, rewrites every
record as a gzip member of its own and writes a sidecar with the place of each member. With that
index archives are read by offset, in splits that know nothing of each other.

Equal payloads are stored once: the record of the smallest id is a response, the others
are revisits of it that keep their HTTP head and the payload's digest.

Tasks write files of their own under names that no other attempt has; what counts as written is
the manifest, a table that Spark commits, so a lost executor leaves stray files but no wrong
archive. Folders are URIs that ``pyarrow.fs`` can open on every machine (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.session import cut, ship, shuffle_width

#: Payloads below this are stored again rather than revisited.
MIN_REVISIT_BYTES = 100
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes of one archive that a task reads back.
READ_BYTES = 8 << 20
PIECE = 1 << 20
GZIP = 31
#: Records carry the date they are given; pages have none.
DATE = "1970-01-01T00:00:00Z"
ID = "<urn:page:{}>"
URI_SAFE = "!#$%&'()*+,/:;=?@[]-._~"

MANIFEST = "archive string, records long, bytes long"
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
INDEX = "archive string, at long, size long, type string, id string"
_INDEX = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("type", pa.string()), ("id", pa.string())])
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def store(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id, url, digest: str, size: int, payload: bytes | None, refers_to) -> list[bytes]:
    """The pieces of one record; without a payload it is a revisit. Spaces, controls and non-ASCII of a url are percent-encoded, so no url can end its line."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda x: ID.format("" if x is None else x)
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=URI_SAFE) if url else None), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if payload is None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return [head(fields, len(http) + len(payload or b"")), http, payload or b"", b"\r\n\r\n"]


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, digest, size, payload, refers_to): a record per row, payload null where it is a revisit.

    The first of each payload is found with a map-side minimum over digests. Payloads then meet
    it in one join, which Spark leaves unshuffled where the repeated digests are few, and splits where one
    digest has very many rows. Rows with the id of the first are responses too, whatever their number; rows
    without an id revisit a first that has one, and are responses otherwise.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    firsts = rows.where(F.col("size") >= min_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(firsts, "sha", "left")
    return joined.select("page_id", "url", F.lower(F.hex("sha")).alias("digest"), "size", F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("first")).alias("refers_to"))


def write_streams(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Records as archives of one gzip stream each; returns the manifest. No rows, no archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        out = name = None
        count = size = 0

        def end() -> pa.RecordBatch:
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": count, "bytes": size}], schema=_MANIFEST)

        for b in batches:
            columns = [b.column(k) for k in range(b.num_columns)]
            for i in range(b.num_rows):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, pack = files.open_output_stream(f"{place}/{name}", compression=None), zlib.compressobj(1, wbits=GZIP)
                    about = b"software: fieldroute\r\nformat: WARC File Format 1.0\r\n"
                    out.write(pack.compress(head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], len(about)) + about + b"\r\n\r\n"))
                page_id, url, digest, n, payload, refers_to = (c[i].as_py() for c in columns)
                for piece in record(page_id, url, digest, n, payload, refers_to):
                    size += len(piece)
                    out.write(pack.compress(piece))
                count += 1
                if size >= archive_bytes:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    ship(rows.sparkSession)
    files, place = store(folder)
    files.create_dir(place)
    return cut(rows.mapInArrow(write, MANIFEST), "warc-streams")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, piece by piece; several members are read one after another."""
    unpack = zlib.decompressobj(GZIP)
    begun = False
    while data := stream.read(PIECE):
        while data:
            if unpack.eof:
                unpack = zlib.decompressobj(GZIP)
            begun = True
            piece = unpack.decompress(data, 4 * PIECE)
            if piece:
                yield piece
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
    if begun and not unpack.eof and (piece := unpack.flush()):
        yield piece
    if begun and not unpack.eof:
        raise ValueError("the gzip stream ends early")


def fields_of(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines.split(b"\r\n")[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of each record; one record is held at a time."""
    held, pieces = bytearray(), iter(pieces)

    def have(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while have(1):
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not have(seen + 1):
                raise ValueError("a record's head ends early")
        fields = fields_of(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not held.startswith(b"WARC/") or not have(size) or held[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("not a record, or one that ends early")
        yield fields, bytes(held[:size])
        del held[:size]


def member(whole: bytes) -> bytes:
    pack = zlib.compressobj(6, wbits=GZIP)
    return pack.compress(whole) + pack.flush()


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives of any gzip layout as archives with one member a record and a sidecar ``.idx`` each; returns the manifest.

    A sidecar has a JSON line a record: at, size (of the member), type and id.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        for b in batches:
            for archive in b.column(0).to_pylist():
                source, path = store(archive)
                name, at, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with source.open_input_stream(path, compression=None) as stream, files.open_output_stream(f"{place}/{name}", compression=None) as out, files.open_output_stream(f"{place}/{name}.idx") as side:
                    for fields, whole in split_records(inflate(stream)):
                        own = member(whole)
                        out.write(own)
                        side.write(json.dumps({"at": at, "size": len(own), "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}).encode() + b"\n")
                        at += len(own)
                        count += 1
                yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": count, "bytes": at}], schema=_MANIFEST)

    ship(archives.sparkSession)
    files, place = store(folder)
    files.create_dir(place)
    return cut(archives.select("archive").repartition(shuffle_width(archives.sparkSession)).mapInArrow(rewrite, MANIFEST), "warc-archives")


def index(archives: DataFrame) -> DataFrame:
    """(archive, at, size, type, id) of every member, from the sidecars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                files, path = store(f"{archive}.idx")
                with files.open_input_stream(path, compression=None) as stream:
                    rest = b""
                    while data := stream.read(PIECE):
                        *lines, rest = (rest + data).split(b"\n")
                        if lines:
                            yield pa.RecordBatch.from_pylist([{"archive": archive, **json.loads(x)} for x in lines], schema=_INDEX)

    ship(archives.sparkSession)
    return archives.select("archive").repartition(shuffle_width(archives.sparkSession)).mapInArrow(read, INDEX)


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix(ID.partition("{")[0]).removesuffix(">")
    return int(number) if number else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, read by their index: page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload.

    Bytes and digest are of the full payload; a revisit's are those it states, its payload is
    null, as all are without ``payloads``. A response whose payload does not have the stated digest fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name = stream = None
        for b in batches:
            rows, held = [], 0
            for archive, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != open_name:
                    files, path = store(archive)
                    open_name, stream = archive, files.open_input_file(path)
                stream.seek(at)
                fields, whole = next(split_records([zlib.decompress(stream.read(size), GZIP)]))
                block = whole[-4 - int(fields["content-length"]) : -4]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive}: the payload at {at} does not have its digest")
                n = int(fields_of(http)["content-length"]) if revisit else len(payload)
                kept = payload if payloads and not revisit else None
                rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], page_of(fields.get("warc-refers-to")), n, digest, kept))
                held += len(kept or b"")
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    spark = archives.sparkSession
    places = index(archives).where("type in ('response', 'revisit')").select("archive", "at", "size")
    splits = places.repartition(shuffle_width(spark), "archive", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("archive", "at")
    return splits.mapInArrow(read, RECORDS)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as normalised archives under ``folder``; returns their manifest (archive, records, bytes).

    A null html is an empty payload; null urls have no target; null ids stay null. Rows
    are records each, repeated ones too. An empty table has no archives. Columns other than the three named
    are not stored, whatever their names. The streams in between are removed when the manifest is committed.
    """
    streams = write_streams(records(pages, id_col, url_col, html_col), f"{folder}/streams", archive_bytes)
    out = normalise(streams, f"{folder}/archives")
    files, place = store(f"{folder}/streams")
    files.delete_dir(place)
    return out


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Every page as it is read back from the archives written for it."""
    return read_archives(write_archives(pages, folder), payloads=False)
