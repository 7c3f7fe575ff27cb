import base64
import hashlib
import re

import zstandard

from millrace.llm import warc
from millrace.scratch import new_path

ROWS = [(3, "http://a/x y", "<p>é</p>"), (1, "http://b/%7E", "<p>é</p>"), (2, None, ""), (5, "u", None), (9, "http://c", "z" * 300_000), (9, "http://c", "z" * 300_000), (None, "n", "<p>é</p>"), (4, "http://\r\nbad", "\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    path, index = warc.write(pages(spark), new_path(spark, "t"), frame_bytes=1000, bundle_bytes=500)
    got = [(r.page_id, r.url, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to) for r in warc.read(spark, path).collect()]
    want = []
    for i, u, h in ROWS:
        body = (h or "").encode()
        same = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
        first = min(same) if same else None
        refers = None if i == first or first is None else first
        url = None if u is None else re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", u)  # percent signs stay
        want.append((i, url, "response" if refers is None else "revisit", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), refers))
    assert sorted(got, key=str) == sorted(want, key=str)
    entry = next(r for r in index.collect() if r.page_id == 3).asDict()
    headers, body = warc.fetch(path, entry)
    assert headers["WARC-Type"] == "revisit" and headers["X-Refers-To-Page"] == "1"
    entry = next(r for r in index.collect() if r.page_id == 9).asDict()
    assert warc.fetch(path, entry)[1].endswith(b"z" * 300_000)


def test_payloads_come_back(spark):
    path, _ = warc.write(pages(spark))
    got = {r.page_id: r.payload for r in warc.read(spark, path, payloads=True).collect() if r.payload is not None}
    assert bytes(got[1]).decode() == "<p>é</p>" and bytes(got[4]) == b"\r\n\r\nWARC/1.1\r\n"


def test_plain_decoder_reads_a_whole_bundle(spark):
    """A reader that knows nothing of the seek table skips it."""
    import glob

    path, _ = warc.write(pages(spark).coalesce(1), frame_bytes=100)
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path.removeprefix("file://") + "/*.warc.zst")))
    raw = b""
    at = 0
    while at < len(data):  # frame by frame, as any decoder does
        d = zstandard.ZstdDecompressor().decompressobj()
        if int.from_bytes(data[at : at + 4], "little") == warc.SKIPPABLE:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        raw += d.decompress(data[at:])
        at = len(data) - len(d.unused_data)
    assert raw.count(b"WARC-Type: ") == len(ROWS)


def test_least_bytes_and_empty(spark):
    path, _ = warc.write(pages(spark), least_bytes=100)
    kinds = {(r.page_id, r.record_type) for r in warc.read(spark, path).collect()}
    assert (3, "response") in kinds and (9, "response") in kinds
    assert warc.archive(pages(spark, []).limit(0)).count() == 0
