import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import crosstoken, registry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table():
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}


class Plain:
    """Whole texts by the libraries, no chunks and no memo."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.table = byte_table()

    def tokens(self, text):
        if not text:
            return [], []
        found = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.table[c] for c in self.a.id_to_token(i))) for i in found]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return a, b

    def aligned(self, text):
        a, b = self.tokens(text)
        ends = [list(np.cumsum([len(x) for _, x in t])) for t in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = []
        for t, es in zip((a, b), ends, strict=True):
            own = {c: [] for c in cuts}
            for (i, _), at in zip(t, np.searchsorted(cuts, es), strict=True):
                own[cuts[at]].append(i)
            sides.append(own)
        groups = ["|".join(",".join(map(str, own[c])) for own in sides) for c in cuts]
        at = {e: i for (i, _), e in zip(b, ends[1], strict=True)}  # no token is empty
        links = [(i, at[e]) for (i, _), e in zip(a, ends[0], strict=True) if e in at]
        return len(a), len(b), groups, links


def expected(texts):
    plain = Plain()
    found = [plain.aligned(t) for t in texts]
    counts = Counter(x for f in found for x in f[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    docs = {}
    for f in found:
        for pair in set(f[3]):
            docs[pair] = docs.get(pair, 0) + 1
    rows = [(f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == highest[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), ";".join(f[2])) for f in found]
    return rows, counts, docs, highest


def test_all_documents_against_the_libraries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows, _, _, _ = expected([r.text for r in docs])
    got = {r.doc_id: r for r in registry.op12(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r, want in zip(docs, rows, strict=True):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum) == want[:6]
        assert g.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")


ODD = ["", None, " ", "  ", "\n", "a\n", "\na", "a ", " a", "a  b", "a\t b", "a\t\n b", "x　y z", "x\x1c y", "a\x85\nb", "▁a b", "a▁", "<s> </s> <|endoftext|> <unk>", "it's they'll", "naïve 😀 ﷺ", "é o", "\x00 a", "w" * 5000, "don't\r\nstop\r\n", "12 345,6"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return [*ODD, *["".join(rng.choices(["a", "the", " ", "  ", "\n", "\t", "\r\n", ".", "'s", "é", "\xa0", "漢", "12", ";\r", "}", " "], k=rng.randint(1, 30))) for _ in range(n)]]


@pytest.mark.parametrize("room", [8192, 8])
def test_odd_texts_and_pair_counts(spark, monkeypatch, room):
    texts = odd_texts(300, 4)
    rows, counts, doc_counts, highest = expected(texts)
    if room == 8:  # many containers, bitmaps and a memo that is emptied, in this process
        for name, value in (("ROOM", 64), ("BITMAP", 8), ("MOST_LINKS", 500), ("MOST_MEMO_BYTES", 20_000)):
            monkeypatch.setattr(crosstoken, name, value)
        known, places, pairs = crosstoken.Aligner(A, B), [], []
        for k, idx in enumerate(known.numbered(texts[:64])):
            if any(known.numbers[2, i] < 0 for i in idx):
                continue
            for i in idx:
                n, begin = known.numbers[2:, i]
                pairs += known.links[begin : begin + n]
                places += [k] * n
        found, planes = crosstoken.planes_by_pair(np.array(pairs, np.int64), np.array(places, np.int64))
        named = list(known.pair)
        assert {(p >> 32, p & (2**32 - 1)) for p in named} == set(expected(texts[:64])[1])
        want = Counter(zip(pairs, places, strict=True))
        got = {(p, int(d)): 0 for p, own in zip(found.tolist(), planes, strict=True) for plane in own for d in crosstoken.places_of(plane)}
        for p, own in zip(found.tolist(), planes, strict=True):
            for digit, plane in enumerate(own):
                for d in crosstoken.places_of(plane):
                    got[p, int(d)] += 1 << digit
            assert crosstoken.popcount(crosstoken.merged(own)) == len({d for q, d in want if q == p})
        assert got == want
        return
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_a long").repartition(3)
    posted = crosstoken.postings(docs, A, B)
    got = {r.doc_id: r for r in crosstoken.scores(posted).collect()}
    for i, want in enumerate(rows):
        g = got[i]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups) == want, texts[i]
    pairs = {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in crosstoken.pair_counts(posted).collect()}
    assert pairs == {p: (doc_counts[p], n, n == highest[p[1]]) for p, n in counts.items()}


def test_repeats_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(map(str, (r.doc_id, r.n_links, r.count_sum))) for r in crosstoken.align(docs, A, B).collect())
    assert got == [("1", "2", "5"), ("1", "2", "5"), ("None", "0", "0"), ("None", "1", "3")]
    assert crosstoken.align(docs.limit(0), A, B).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 8192):
        places = np.sort(rng.choice(crosstoken.ROOM, n, replace=False))
        packed = crosstoken.compressed(places)
        assert crosstoken.places_of(packed).tolist() == places.tolist() and crosstoken.popcount(packed) == n and len(packed) <= crosstoken.BITMAP
