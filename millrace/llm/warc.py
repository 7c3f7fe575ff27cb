"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a
seek table in a skippable frame, so any frame can be found from the end of
the file and read alone. An index maps each record to its bundle, its frame
and its offset inside the frame.

Tasks write bundles under a temporary name and rename them when they are
whole. Rows are sorted inside a task and names come from the partition, so a
task that runs again writes the same bundles. Bundles are read back with
Spark's binary file source; their size is bounded.

Of records with equal payloads that with the smallest page id is a response
and the others are revisits that refer to it; payloads below ``least_bytes``
are all responses.

Defined cases: null html is an empty payload; null url has no target header;
a null page id is written without one, and is a revisit where another row
with the same payload has an id; rows that repeat id and payload of a
response are responses too; an empty table gives no bundle and an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import new_path, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, bundle string, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. The page id, the payload's length and the page referred to are in extension headers.

    In the target URI only blanks and control characters, which a header line
    cannot hold, are escaped; percent-encoded addresses stay as they are.
    """
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        body = HTTP + payload
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
        body = HTTP
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, body, offset, length) of the records of one frame."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = head_end + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield headers, data[begin:end], at, end + 4 - at
        at = end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame of frames' (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, raw) of each frame, from the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    at = len(bundle) - 9 - 8 * count
    if struct.unpack("<I", bundle[at - 8 : at - 4])[0] != SKIPPABLE:
        raise ValueError("the seek table has no head")
    out, offset = [], 0
    for i in range(count):
        small, raw = struct.unpack("<II", bundle[at + 8 * i : at + 8 * i + 8])
        out.append((offset, small, raw))
        offset += small
    return out


def _file_system(path: str):
    """The file system and inner path of a URI, on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


class _Bundles:
    """Writes one task's bundles and keeps the index rows of those that are whole."""

    def __init__(self, path: str, part: int, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.fs, self.root = _file_system(path)
        self.part, self.frame_bytes, self.bundle_bytes = part, frame_bytes, bundle_bytes
        self.packer, self.number, self.out = zstandard.ZstdCompressor(level=level), 0, None
        self.held: list[tuple[int | None, bytes]] = []
        self.held_bytes = 0
        self.index: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.held.append((page_id, data))
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:05d}.warc.zst"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.at, self.frames = self.fs.open_output_stream(self.temporary), 0, []
            self.number += 1
        raw = b"".join(x for _, x in self.held)
        small = self.packer.compress(raw)
        self.out.write(small)
        offset = 0
        for page_id, data in self.held:
            self.index.append((page_id, self.name, self.at, len(small), offset, len(data)))
            offset += len(data)
        self.frames.append((len(small), len(raw)))
        self.at += len(small)
        self.held, self.held_bytes = [], 0
        if self.at >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.out = None

    def rows(self) -> pa.RecordBatch:
        cols, self.index = list(zip(*self.index, strict=True)) or [()] * 6, []
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def write(
    pages: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    frame_bytes: int = 1 << 18,
    bundle_bytes: int = 1 << 25,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> tuple[str, DataFrame]:
    """Write all pages as bundles below ``path`` (a new shared folder if none); return it and the index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    # Only digests meet; the pages then find their page to refer to by id and digest, which no third of all rows share.
    light = own.select("page_id", "digest", "bytes")
    same = light.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    later = light.join(same, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "first").distinct()
    joined = own.join(later, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    rows = joined.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", F.col("first").alias("refers_to")).sortWithinPartitions("page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = _Bundles(path, TaskContext.get().partitionId(), frame_bytes, bundle_bytes, level)
        bundles.fs.create_dir(bundles.root)
        for batch in batches:
            ids, urls, digests, refs = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, payload in enumerate(batch.column(2)):
                bundles.add(ids[i], record(ids[i], urls[i], payload.as_py(), digests[i], refs[i], date))
            if len(bundles.index) >= 10_000 and bundles.out is None:
                yield bundles.rows()
        bundles.close()
        yield bundles.rows()

    return path, written(rows.mapInArrow(run, INDEX), "warc-index")


def read(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """Every record of the bundles below ``path``; digests of responses are recomputed and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column(0):
                bundle = content.as_buffer()
                for offset, small, raw in frames_of(memoryview(bundle)):
                    out = []
                    for headers, body, _, _ in records_of(unpack.decompress(memoryview(bundle)[offset : offset + small], max_output_size=raw)):
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = body[body.index(b"\r\n\r\n") + 4 :]
                        n = int(headers["X-Payload-Length"])
                        if kind == "response" and (n != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not agree with its digest")
                        url = headers.get("WARC-Target-URI")
                        ids = [int(headers[k]) if k in headers else None for k in ("X-Page-ID", "X-Refers-To-Page")]
                        out.append((ids[0], url, kind, digest, n, ids[1], payload if payloads and kind == "response" else None))
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
                    used = 7 if payloads else 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols[:used], kinds[:used], strict=True)], names=names[:used])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def fetch(path: str, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its index row: only its frame is read."""
    import zstandard

    fs, root = _file_system(path)
    with fs.open_input_file(f"{root}/{entry['bundle']}") as f:
        f.seek(entry["frame_offset"])
        data = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    part = data[entry["record_offset"] : entry["record_offset"] + entry["record_bytes"]]
    headers, body, _, _ = next(records_of(part))
    return headers, body


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, then read the archives back."""
    if pages.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORD)
    path, _ = write(pages, **options)
    return read(pages.sparkSession, path)
