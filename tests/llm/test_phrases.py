import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import phrases
from tests.llm.sql import same_as_sql


def plain(rows, least=30, top=2000, cover=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in held.items():
        k = len(words)
        cuts = [(2_000_000 * a // (counts[lang, words[:j]] + counts[lang, words[j:]]), j) for j in range(1, k)]
        score, j = min(cuts)
        longer = [b for (other, w), b in held.items() if other == lang and len(w) > k and any(w[i : i + k] == words for i in range(len(w) - k + 1))]
        if not any(100 * b >= cover * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:j]], counts[lang, words[j:]]))
    return {(lang, rank): (p.decode(), -a, left, right, totals[lang], -s) for lang, own in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def got(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_whole_table_against_sql(spark):
    same_as_sql(spark, "op11_phrase_collocations")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["a", "B", "the", "of", "é", "É", "x-1", "ö", "new", "york", "\x1c", "'s"]
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts += rng.choice([["New", "York", "of"], ["x-1"], [rng.choice(words)], [rng.choice(words), rng.choice(words)]])
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "!?", ""]))
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(parts)))
    return [*rows, ("en", None), ("en", ""), ("en", ".. \n"), (None, "new york " * 3000), ("zz", "ab cd " * 5)]


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_counts(spark, monkeypatch, texts, small):
    """Small: containers burst at once, tries spill, the dictionary is renewed and the filter is full, in tasks of this process' settings."""
    table = spark.createDataFrame([(lang, t, 1) for lang, t in texts], "lang string, text string, f long").repartition(3)
    want = plain(texts, least=8, top=30)
    assert len(want) > 40 and any(s for *_, s in want.values())
    if small:
        monkeypatch.setattr(phrases, "MOST_BITS", 1024)
    assert got(phrases.collocations(table, least=8, top=30)) == want


def columns_of(counter):
    keys = sorted(counter)
    return np.array(keys, np.int64).T, np.array([counter[k] for k in keys], np.int64)


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_tries_burst_spill_and_count(monkeypatch, length):
    rng = random.Random(length)
    trie, want = phrases.HatTrie(length), Counter()
    monkeypatch.setattr(phrases, "BURST", 5)
    for step in range(40):
        keys = Counter(tuple(rng.choices(range(1, 6), k=length)) for _ in range(60))
        trie.add(*columns_of(keys))
        want.update(keys)
        assert trie.size == len(want) == sum(s for s, _ in trie.subtrees())
        if step % 7 == 6:
            _, word = max(trie.subtrees())
            columns, counts = trie.taken([word])
            for phrase, n in zip(zip(*columns.tolist(), strict=True), counts.tolist(), strict=True):
                assert (length == 1 or phrase[0] == word) and want.pop(phrase) == n
    if length == 3:
        assert phrases.Node in map(type, trie.root.values())
    columns, counts = trie.taken([w for _, w in trie.subtrees()])
    assert dict(zip(zip(*columns.tolist(), strict=True), counts.tolist(), strict=True)) == want and trie.size == 0


def test_cells_add_up():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 3000, np.uint64)
    hashes = np.concatenate([hashes, np.repeat(hashes[:50], 7)])
    import pyarrow as pa

    rows = sorted((b, c) for part in np.array_split(hashes, 5) for b, c in phrases.sketched(part, 6))
    table = pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "cells": [c for _, c in rows]})
    some = pa.Table.from_batches(list(phrases._cell_merger(6, False)(iter(table.to_batches(9)))))
    found = pa.Table.from_batches(list(phrases._cell_merger(6, True)(iter(some.to_batches()))))
    bits = {b: np.unpackbits(np.frombuffer(c, np.uint8), bitorder="little") for b, c in zip(*(found.column(i).to_pylist() for i in (0, 1)), strict=True)}
    block, place = phrases.cells_of(hashes)
    want = Counter(zip(block.tolist(), place.tolist(), strict=True))
    assert all(bits[b][p] == (n >= 6) for (b, p), n in want.items()) and sum(int(x.sum()) for x in bits.values()) == sum(n >= 6 for n in want.values()) >= 50


def test_runs_of_spilled_tries_merge(monkeypatch, texts):
    """The counting of one task, run here with room for few phrases and words, then merged."""
    import pyarrow as pa

    for name, value in (("MOST_ENTRIES", 50), ("MOST_WORDS", 9), ("SLAB", 40), ("BURST", 4)):
        monkeypatch.setattr(phrases, name, value)
    taken = {}

    class Frame:
        sparkSession = sparkContext = property(lambda self: self)
        select = lambda self, *_: self

        def broadcast(self, value):
            self.value = value
            return self

        def mapInArrow(self, f, _):
            taken["run"] = f

    for name in ("col", "coalesce", "lit"):
        monkeypatch.setattr(phrases.F, name, lambda *_: _Any())
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in texts]), pa.array([t for _, t in texts], pa.string())], names=["lang", "text"])
    for lengths in ((1,), (2,), (3, 4)):
        phrases.counted(Frame(), lengths, 2, bitmap=np.full(1 << 24, 255, np.uint8))
        rows = [(r["lang"], r["phrase"], r["f"]) for b in taken["run"](iter([batch])) for r in b.to_pylist() if r["lang"]]
        merged = [tuple(r.values()) for b in phrases._merger(2)(iter(pa.Table.from_pylist([dict(zip(("lang", "phrase", "f"), r, strict=True)) for r in sorted(rows)]).to_batches(7))) for r in b.to_pylist()]
        want = Counter()
        for lang, text in texts:
            piece = []
            for w in [*phrases.words_of((text or "").encode()), b"."]:
                if w == b".":
                    want.update((lang or "und", " ".join(piece[i : i + n])) for n in lengths for i in range(len(piece) - n + 1))
                    piece = []
                else:
                    piece.append(w.decode())
        assert len(rows) > len(want) and sorted(merged) == sorted((*k, n) for k, n in want.items() if n >= 2)


class _Any:
    def __getattr__(self, _):
        return lambda *_: self


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    bits = 1 << 17
    words = np.zeros(bits // 64, np.uint64)
    for at, mask in phrases.probes(hashes, bits):
        np.bitwise_or.at(words, at, mask)
    assert phrases.among(hashes, words).all()
    assert phrases.among(rng.integers(0, 2**64, 20_000, np.uint64), words).mean() < 0.02


def test_large_counts_are_exact(spark):
    rows = [("x", "a b", 5 * 10**18, 2), ("x", "a", 6 * 10**18, 1), ("x", "b", 9 * 10**18, 1)]
    r = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, f long, words int")).collect()[0]
    assert r.score == 2_000_000 * 5 * 10**18 // (15 * 10**18)


def test_nothing_frequent_and_empty(spark):
    table = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrases.collocations(table).count() == 0 and phrases.collocations(table.limit(0)).count() == 0
