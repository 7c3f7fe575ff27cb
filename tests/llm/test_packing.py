import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, plain, room):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in docs:
        ids, at = plain(text), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[at : at + room]
            assert (r.piece, r.start, r.length) == (k, at, len(part))
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += len(part)
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= room
    return len(bins)


def test_all_documents_round_trip(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()
    bins = check(rows, docs, plain, 2048)
    total = sum(r.length for r in rows)
    assert bins <= -(-total // 2048) * 1.02 + 2


TEXTS = ["", None, "a  b\tc\r\nd\x0be\xa0f", "don't STOP é́ ΑΣ x　y", "<|endoftext|>", "word " * 5000, "y" * 3000, "123 !!! 😀😀"]


def test_awkward_texts(spark, plain):
    docs = list(enumerate(TEXTS))
    table = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, piece long")
    check(packing.pack_documents(table, PATH, room=64).collect(), docs, plain, 64)


def test_memo_is_bounded_and_keeps_no_long_chunk(plain, monkeypatch):
    words = packing.WordBytes(PATH)
    monkeypatch.setattr(packing, "MOST_CACHED_BYTES", 20_000)
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcXYZ,.", k=rng.choice((3, 9, 300)))) for _ in range(20)) + "中文" * 200
        got = packing.token_bytes(text, words)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == plain(text)
        assert max(map(len, words)) <= packing.LONGEST_CACHED
        assert sum(packing.ENTRY + len(k) + len(v) for k, v in words.items()) <= 20_000 + 60 * (packing.ENTRY + 400)


def test_ties_and_repeated_rows_are_dealt_over_groups(spark, plain):
    """One row 5,000 times: no group holds them all, and every copy is packed."""
    docs = spark.createDataFrame([(7, "the same few words")] * 5000, "doc_id long, text string").repartition(8)
    rows = packing.pack_documents(docs, PATH, room=64, group_pieces=500).collect()
    assert len(rows) == 5000 and {(r.piece, r.start, r.length) for r in rows} == {(0, 0, len(plain("the same few words")))}
    spots = {(r.sequence_id, r.offset) for r in rows}
    assert len(spots) == 5000 and len({s >> 33 for s, _ in spots}) >= 8


def test_places_keep_to_their_stretch(spark, plain):
    docs = [(i, "word " * (i % 40)) for i in range(1200)]
    table = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, at long")
    rows = packing.pack_documents(table, PATH, place_col="at", room=64, group_pieces=300).collect()
    check(rows, docs, plain, 64)
    assert all(r.sequence_id >> 33 == r.doc_id // 300 for r in rows if r.length < 64)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_rule_against_its_definition():
    """Each placement makes the sum of squares smallest, by trying every bin."""
    rng, room = random.Random(3), 20
    lengths = [rng.randint(1, 20) for _ in range(200)]
    bins, offsets = packing.sum_of_squares(lengths, room)
    gaps = {}

    def squares(g):
        count = {}
        for x in g.values():
            if 0 < x < room:
                count[x] = count.get(x, 0) + 1
        return sum(n * n for n in count.values())

    for n, b, o in zip(lengths, bins, offsets, strict=True):
        options = [squares({**gaps, c: gaps[c] - n}) for c in gaps if gaps[c] >= n] + [squares({**gaps, "new": room - n})]
        assert o == room - gaps.get(b, room)
        gaps[b] = gaps.get(b, room) - n
        assert squares(gaps) == min(options)
