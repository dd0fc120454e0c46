"""WARC archives as seekable Zstandard bundles.

A bundle is one complete archive: records are grouped into frames that decompress on their own, and
a skippable frame at the end lists the frames' sizes. The index maps each record to its bundle, its
frame and its offset inside the decompressed frame, so that reading a record decompresses one frame.
Bundles and their index are rows of a table written by Spark to the shared folder, in any store that
Spark can write; the `content` column of a row is the file's bytes.

Payloads of at least LEAST_SHARED bytes that are equal (by SHA-1) are stored once: the record with
the largest id is the response, the others are revisits that refer to it.

Rows: a null payload counts as empty. A null id is the smallest, is written as such and read back as
null. Rows that repeat both the id and the payload of the response are responses too. Further
columns are ignored; an empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored, texts_of

LEAST_SHARED = 1000
#: Bytes of records in a frame before compression, and of a bundle after it; a longer record is not split.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: An extension header of ours in revisits, which the format allows: the size of the payload that they stand for.
PAYLOAD_LENGTH = "X-Payload-Length"
# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_RECORDS = "records array<struct<record_id: string, frame: int, `offset`: long, length: long>>"


def record(kind: str, record_id: str | None, url: str, payload: bytes, digest: bytes, size: int, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has headers only and tells the size of the payload it stands for."""
    name = lambda x: f"<urn:page:{quote('' if x is None else x, safe='')}>" if x is not None else "<urn:null>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(record_id)}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"{PAYLOAD_LENGTH}: {size}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames."""

    def __init__(self):
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[dict] = []
        self.size, self._open, self._filled = 0, [], 0
        self._compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record_id: str | None, data: bytes) -> None:
        if self._filled and self._filled + len(data) > FRAME_BYTES:
            self._close_frame()
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self._filled, "length": len(data)})
        self._open.append(data)
        self._filled += len(data)

    def _close_frame(self) -> None:
        frame = self._compressor.compress(b"".join(self._open))
        self.frames.append((frame, self._filled))
        self.size += len(frame)
        self._open, self._filled = [], 0

    def content(self) -> bytes:
        if self._open:
            self._close_frame()
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return b"".join(f for f, _ in self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def frame_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame, from the table at the end."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    begin = len(content) - 9 - n * width
    at, out = 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, begin + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at `at`, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
    begin, size = stop + 4, int(headers["Content-Length"])
    block = data[begin : begin + size]
    return headers, block[block.index(b"\r\n\r\n") + 4 :], begin + size + 4


def _id_of(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    kind = headers["WARC-Type"]
    if kind == "revisit":
        size, digest = int(headers[PAYLOAD_LENGTH]), base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return _id_of(headers["WARC-Record-ID"]), unquote(headers["WARC-Target-URI"]), size, digest, kind, _id_of(headers.get("WARC-Refers-To")), payload


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Per page what its record is: url, payload (null for revisits), digest, size, type and the record it refers to."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    marked = pages.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # Counted before anything is shuffled; payloads with copies only, one row each.
    last = marked.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "last")
    # Revisits are found by ids and digests alone; payloads are dealt out by both, so that copies of one payload don't meet in one task.
    copies = marked.filter(F.col("size") >= LEAST_SHARED).select("id", "digest").join(last, "digest").filter(~F.col("id").eqNullSafe(F.col("last")))
    copies = copies.select(F.col("id").alias("copy_id"), F.col("digest").alias("copy_digest"), "last").distinct()
    joined = marked.join(copies, (F.col("digest") == F.col("copy_digest")) & F.col("id").eqNullSafe(F.col("copy_id")), "left")
    again = F.col("last").isNotNull()
    return joined.select(
        F.col("id").cast("string").alias("id"), "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(again, F.col("last").cast("string")).alias("refers_to"),
    )


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives of pages; the table of bundles (bundle, content, records) as read back."""

    def row(bundle: Bundle) -> pa.RecordBatch:
        schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
        return pa.RecordBatch.from_pylist([{"bundle": uuid.uuid4().hex, "content": bundle.content(), "records": bundle.index}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        for batch in batches:
            for r in batch.to_pylist():
                bundle.add(r["id"], record(r["kind"], r["id"], r["url"], r["payload"] or b"", bytes.fromhex(r["digest"]), r["size"], r["refers_to"]))
                if bundle.size >= BUNDLE_BYTES:
                    yield row(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield row(bundle)

    return stored(plan(pages, key, url, payload).mapInArrow(run, f"bundle string, content binary, {_RECORDS}"), "warc", compression="uncompressed")


def index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: bundle, frame and offset inside the decompressed frame."""
    return bundles.select("bundle", F.inline("records"))


def read(bundles: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record of the bundles, frame by frame."""
    schema = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for frame in frame_table(data):
                    plain, at = read_frame(data, frame), 0
                    while at < len(plain):
                        headers, payload, at = parse(plain, at)
                        rows.append(_row(headers, payload)[:6])
                columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = bundles.select("content").mapInArrow(run, schema)
    return out.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def lookup(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose ids stand in the first column of ids: each opens its frame only."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("record_id")).distinct()
    at = index(bundles).join(wanted, "record_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def run(batches):
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = content.as_py()
                frames, opened, rows = frame_table(data), {}, []
                for p in places:
                    if p["frame"] not in opened:
                        opened = {p["frame"]: read_frame(data, frames[p["frame"]])}
                    rows.append(_row(*parse(opened[p["frame"]], p["offset"])[:2]))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    joined = bundles.join(at, "bundle").select("content", F.array_sort("places").alias("places"))
    return joined.mapInArrow(run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes pages as archives and reads every record back."""
    return read(write(pages, key, url, payload), dict(pages.dtypes)[key]).withColumnRenamed("id", key).drop("url")
