"""WARC archives as seekable Zstandard bundles: records grouped in independent frames, a seek table at the end, an index beside them.

A bundle is one file. Its frames hold whole WARC/1.1 records, up to ``FRAME`` bytes of them (a longer record has a frame of its
own), so each frame can be read and decompressed alone. The last frame is a skippable one with the seek table of the public
seekable format: compressed size, decompressed size and checksum of every frame. The index, a Parquet table, names for each
record its bundle, frame, and offset and length inside the decompressed frame.

Tasks write bundles straight into the shared folder. A repeated task writes new files; only those that the index names count.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, ready, store
from tidemark.session import fresh_path

#: Bytes of records in a frame, and of compressed frames in a bundle.
FRAME, BUNDLE = 1 << 20, 128 << 20
#: Shortest payload that a revisit may stand for.
LEAST = 1000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format and of WARC/1.1.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
LENGTH = "X-Payload-Length"

_UNSAFE = re.compile(rb"[\x00-\x20\x7F]")
_INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"
_RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_id string"


class DamagedArchive(ValueError):
    """A bundle, frame or record that is not what its table, checksum or digest says."""


@dataclass
class Archive:
    """``index``: one row per record; the bundles are the files it names."""

    index: DataFrame

    def bundles(self) -> DataFrame:
        return self.index.select("bundle").distinct()


# ---- records

def record_id(page_id: int | None, row: int) -> str:
    return f"<{NAME}{'' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    found = name[len(NAME) + 1 : -1].partition(":")[0]
    return int(found) if found else None


def _uri(url: str | None) -> bytes | None:
    """A url as a header value: white space and control characters as escapes."""
    return None if url is None else _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass"))


def make_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [b"WARC/1.1"]
    for name, value in fields:
        if value is not None:
            head.append(name.encode() + b": " + (value if isinstance(value, bytes) else str(value).encode()))
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(name: str, url: str | None, payload: bytes, digest: str, date: str = DATE) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
              ("WARC-Payload-Digest", _labelled(digest)), ("Content-Type", "application/http; msgtype=response")]
    return make_record(fields, http + payload)


def revisit(name: str, url: str | None, size: int, digest: str, refers: str, date: str = DATE) -> bytes:
    """A record without a block; the size of the payload it stands for is a field of our own."""
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
              ("WARC-Payload-Digest", _labelled(digest)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), (LENGTH, size)]
    return make_record(fields, b"")


def _labelled(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def split_record(data: bytes, at: int) -> tuple[dict[str, bytes], int, int]:
    """Fields (names in lower case) of the record at ``at``, and where its block starts and ends."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not data.startswith(b"WARC/1.1\r\n", at):
        raise DamagedArchive("no WARC record where one should start")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip()
    start = stop + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise DamagedArchive("a record does not end where its length says")
    return fields, start, end


def read_record(data: bytes, at: int) -> tuple[dict | None, int]:
    """The record at ``at`` (None for one that describes the bundle) and the start of the next; digests are verified."""
    fields, start, end = split_record(data, at)
    kind = fields["warc-type"].decode()
    if kind == "warcinfo":
        return None, end + 4
    digest = base64.b32decode(fields["warc-payload-digest"].partition(b":")[2]).hex()
    name, refers, payload = fields["warc-record-id"].decode(), fields.get("warc-refers-to"), None
    if kind == "response":
        payload = data[data.index(b"\r\n\r\n", start, end) + 4 : end]
        if sha1(payload).hexdigest() != digest:
            raise DamagedArchive(f"payload of {name} does not have its digest")
    url = fields.get("warc-target-uri")
    return {
        "record_id": name, "page_id": page_of(name), "url": None if url is None else url.decode("utf-8", "replace"),
        "payload_bytes": int(fields[LENGTH.lower()]) if payload is None else len(payload), "payload_digest": digest, "record_type": kind,
        "refers_to": None if refers is None else page_of(refers.decode()), "refers_id": None if refers is None else refers.decode(), "payload": payload,
    }, end + 4


# ---- bundles

def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """Skippable frame with ``(compressed size, size, checksum)`` of every frame and the footer."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int, int]]:
    """``(offset, compressed size, size, checksum)`` of every frame, found from the end of the file."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise DamagedArchive("no seek table at the end of the bundle")
    length = 12 * n + 9
    file.seek(size - length - 8)
    head, body = struct.unpack("<II", file.read(8)), file.read(12 * n)
    if head != (SKIPPABLE, length):
        raise DamagedArchive("the seek table is not whole")
    out, at = [], 0
    for packed, whole, check in struct.iter_unpack("<III", body):
        out.append((at, packed, whole, check))
        at += packed
    return out


def read_frame(file, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, whole, check = frame
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=whole)
    if len(data) != whole or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise DamagedArchive("a frame does not have its size or checksum")
    return data


class BundleWriter:
    """One task's bundles; ``add`` gives the index rows of the records whose frame has been written."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.file = folder, None
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def _open(self) -> None:
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.name, self.frames, self.written = f"{self.uri}/{name}", [], 0
        self.file = self.files.open_output_stream(f"{self.folder}/{name}", compression=None)
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        self.held, self.rows = [make_record(info, b"format: WARC File Format 1.1\r\n")], []
        self.size = len(self.held[0])

    def add(self, row: tuple, record: bytes) -> list[tuple]:
        if self.file is None:
            self._open()
        done = self._frame() if self.rows and self.size + len(record) > FRAME else []
        self.rows.append((*row, self.name, len(self.frames), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        if self.written > BUNDLE:
            done += self.close()
        return done

    def _frame(self) -> list[tuple]:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        done, self.held, self.rows, self.size = self.rows, [], [], 0
        return done

    def close(self) -> list[tuple]:
        if self.file is None:
            return []
        done = self._frame() if self.held else []
        self.file.write(seek_table(self.frames))
        self.file.close()
        self.file = None
        return done


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["record_id", "page_id", "record_type", "bundle", "frame", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = BundleWriter(folder)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                row, page, url, digest, size, of_row, of_page, payload = (batch.column(c)[i].as_py() for c in range(8))
                name = record_id(page, row)
                if of_row is None:
                    done += bundle.add((name, page, "response"), response(name, url, payload, digest))
                else:
                    done += bundle.add((name, page, "revisit"), revisit(name, url, size, digest, record_id(of_page, of_row)))
            if done:
                yield _index_batch(done)
        done = bundle.close()
        if done:
            yield _index_batch(done)

    return run


def write_archive(pages: DataFrame) -> Archive:
    """Write one record per row of ``pages`` (``page_id, url, html``); other columns are not touched.

    Of rows with equal payloads of at least ``LEAST`` bytes, the one with the largest page_id (null below all; then the largest url and
    row) is a response with the payload, the others are revisits that name it. Shorter payloads are all responses; a null html is the
    empty payload. A null url gives a record without a target, a null page_id one whose name holds no id; rows that repeat a page_id, or
    each other, are records of their own. No rows give no bundle and an empty index. Payloads are moved once, to meet the response of their digest; equal ones are counted before any move, and
    Spark splits a digest that many rows share.
    """
    spark = ready(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("row", "page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    rows = store(rows, "warc-rows")
    last = F.max(F.struct("page_id", "url", "row"))  # null is the smallest value of a field
    shared = rows.where(f"size >= {LEAST}").groupBy("digest").agg(last.alias("of"), F.count("*").alias("n")).where("n > 1")
    shared = store(shared.select(F.col("digest").alias("of_digest"), F.col("of.row").alias("of_row"), F.col("of.page_id").alias("of_page")), "warc-shared")
    met = rows.where(f"size >= {LEAST}").join(shared, F.expr("digest = of_digest"), "left").unionByName(
        rows.where(f"size < {LEAST}"), allowMissingColumns=True)  # short ones stay where they are
    again = F.expr("of_row is not null and of_row != row")
    met = met.select(
        "row", "page_id", "url", "digest", "size", F.when(again, F.col("of_row")).alias("of_row"), F.when(again, F.col("of_page")).alias("of_page"),
        F.when(~again, F.col("payload")).alias("payload"))
    folder = fresh_path(spark, "warc")
    _make_folder(spark, folder)
    index = store(met.mapInArrow(_write(folder), _INDEX), "warc-index")
    discard(rows, shared)
    return Archive(index)


def _make_folder(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def _open(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _record_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r[f.name] for r in rows] for f in schema}, schema)


def _schema(payloads: bool) -> pa.Schema:
    text, number = pa.string(), pa.int64()
    fields = [("record_id", text), ("page_id", number), ("url", text), ("payload_bytes", number), ("payload_digest", text), ("record_type", text),
              ("refers_to", number), ("refers_id", text)]
    return pa.schema(fields + [("payload", pa.binary())] * payloads)


def _read_bundles(payloads: bool):
    schema = _schema(payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                with _open(uri) as file:
                    for frame in read_seek_table(file, file.size()):
                        data, at, rows = read_frame(file, frame), 0, []
                        while at < len(data):
                            record, at = read_record(data, at)
                            if record is not None:
                                rows.append(record)
                        if rows:
                            yield _record_batch(rows, schema)

    return run


def read_archive(archive: Archive, payloads: bool = False) -> DataFrame:
    """One row per record of all bundles: ``record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_id``, and
    with ``payloads`` also ``payload`` (null for revisits). Checksums of frames and digests of payloads are verified.
    """
    bundles = archive.bundles()
    tasks = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bundles.repartition(tasks).mapInArrow(_read_bundles(payloads), _RECORD + ", payload binary" * payloads)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, uri, number, file, table, data = _schema(True), None, None, None, [], b""
    for batch in batches:
        for row in batch.to_pylist():
            if row["bundle"] != uri:
                if file is not None:
                    file.close()
                uri, number, file = row["bundle"], None, _open(row["bundle"])
                table = read_seek_table(file, file.size())
            if row["frame"] != number:
                number, data = row["frame"], read_frame(file, table[row["frame"]])
            record, end = read_record(data, row["offset"])
            if end != row["offset"] + row["length"] or record is None or record["record_id"] != row["record_id"]:
                raise DamagedArchive(f"{row['record_id']} is not where the index says")
            yield _record_batch([record], schema)
    if file is not None:
        file.close()


def fetch(archive: Archive, records: DataFrame) -> DataFrame:
    """The records whose ``record_id`` stands in ``records``, with payloads: only the frames that hold them are read.

    Names that the index does not know give no row; a name that is asked for twice comes once.
    """
    wanted = archive.index.join(records.select("record_id").distinct(), "record_id", "left_semi")
    wanted = wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return wanted.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(_fetch, _RECORD + ", payload binary")

