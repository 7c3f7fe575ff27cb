"""Phrase collocations counted in HAT-tries.

Each task counts phrases in a HAT-trie for each language and length: a shallow
trie of word ids whose leaves are hash containers of what follows; a container
that grows past ``BURST`` phrases bursts into a trie node with a container for
each next word. When a task's tries hold more than ``MOST_ENTRIES`` phrases,
whole subtrees, the largest first, leave as runs sorted by their words. Runs
are dealt by their phrases' prefixes (a crowded prefix over ``SLOTS`` parts by
the last word), sorted and merged in one pass.

The texts are read three times. The first pass counts words, and pairs of
words in the cells of a sketch: a pair can only be frequent if its cell is.
The second counts the pairs whose cells are frequent. The third counts phrases
of three and four words whose pairs pass a blocked Bloom filter of the
frequent ones, since a phrase can only be frequent if all its parts are. Sketch
and filter have a fixed greatest size; on larger corpora they spare less, and
the result is the same. Counts are exact: words are compared as text when runs
are merged, and sums of products are decimals.

Defined cases: null texts are empty; a null language is ``und``, together with
that name; punctuation or line breaks alone give no words; repeated rows count
each; ties of score and count go by phrase in byte order; an empty table, or
one without a frequent phrase, gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written

LONGEST = 4
BURST = 4096
MOST_ENTRIES = 600_000
MOST_WORDS = 1_000_000
SLAB = 1 << 20
SLOTS = 32
MOST_BITS = 1 << 27
CELL_BITS = 27  # the sketch has 2 to this power cells
BLOCK_BITS = 20  # of its cells are merged together
MERGES = 8  # groups that a block's cells are merged in first
BITS_A_PHRASE = 16
PROBES = 4

#: A-Z are lower-cased, and what ends a piece becomes a full stop.
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b",;:!?\x0a\x0b\x0c\x0d", string.ascii_lowercase.encode() + b"." * 9)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Node(dict):
    """A trie node: next word id to node or container (a plain dict of what follows to its count)."""


class HatTrie:
    """Counts of phrases of ``n`` words; a container's keys hold one or two word ids of 31 bits."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.root = Node() if n > 1 else {}
        self.size = 0

    def add(self, columns: np.ndarray, counts: np.ndarray) -> None:
        """Add phrases, a column of word ids for each word, sorted by their words."""
        if self.n == 1:
            self._into(self.root, columns[0].tolist(), counts.tolist())
        elif columns.shape[1]:
            self._below(self.root, columns, counts)

    def _into(self, container: dict, keys: list[int], counts: list[int]) -> None:
        before = len(container)
        for key, count in zip(keys, counts, strict=True):
            container[key] = container.get(key, 0) + count
        self.size += len(container) - before

    def _below(self, node: Node, columns: np.ndarray, counts: np.ndarray) -> None:
        first, rest = columns[0], columns[1:]
        begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        ends = [*begins[1:].tolist(), len(first)]
        keys, numbers = (rest[0] if len(rest) == 1 else rest[0] << 31 | rest[1]).tolist() if len(rest) < 3 else None, counts.tolist()
        for word, begin, end in zip(first[begins].tolist(), begins.tolist(), ends, strict=True):
            below = node.get(word)
            if below is None:
                below = node[word] = {} if keys is not None else Node()
            if type(below) is Node:
                self._below(below, rest[:, begin:end], counts[begin:end])
                continue
            self._into(below, keys[begin:end], numbers[begin:end])
            if len(below) > BURST and len(rest) == 2:
                node[word] = burst(below)

    def subtrees(self) -> list[tuple[int, int]]:
        """Size and word of the subtrees below the root; 0 for a trie of single words."""
        if self.n == 1:
            return [(self.size, 0)] if self.size else []
        return [(held(sub), word) for word, sub in self.root.items()]

    def taken(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Remove the subtrees of ``words`` and return their phrases, a column for each word, and counts."""
        out: tuple[list[int], ...] = tuple([] for _ in range(self.n + 1))
        if self.n == 1:
            sub, self.root = self.root, {}
            walked(sub, [], 1, out)
        for word in words if self.n > 1 else ():
            walked(self.root.pop(word), [word], self.n - 1, out)
        self.size -= len(out[-1])
        return np.array(out[:-1], np.int64), np.array(out[-1], np.int64)


def burst(container: dict) -> Node:
    node = Node()
    for key, n in container.items():
        node.setdefault(key >> 31, {})[key & ((1 << 31) - 1)] = n
    return node


def held(sub: dict) -> int:
    return sum(map(held, sub.values())) if type(sub) is Node else len(sub)


def walked(sub: dict, prefix: list[int], left: int, out: tuple[list[int], ...]) -> None:
    """Append what is below ``prefix`` to the columns of ``out``."""
    if type(sub) is Node:
        for word, below in sub.items():
            walked(below, [*prefix, word], left - 1, out)
        return
    for column, word in zip(out, prefix, strict=False):
        column.extend([word] * len(sub))
    if left == 2:
        out[-3].extend([k >> 31 for k in sub])
        out[-2].extend([k & ((1 << 31) - 1) for k in sub])
    else:
        out[-2].extend(sub)
    out[-1].extend(sub.values())


class Words(dict):
    """Word to id, from 1; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.names = [b""]
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(xxh64_intdigest(word))
        return n


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, a full stop where a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


def phrase_hashes(lang: str, words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``n``-word windows over an array of word hashes."""
    from xxhash import xxh64_intdigest

    out = np.full(max(0, len(words) - n + 1), xxh64_intdigest(lang.encode()), np.uint64)
    for j in range(n):
        out = (out ^ words[j : j + len(out)]) * _ODD
        out ^= out >> np.uint64(32)
    return out


def probes(hashes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word number and mask of each probe, all within one block of eight 64-bit words."""
    first = (hashes % np.uint64(bits // 512)) * np.uint64(8)
    second = hashes * _ODD
    for j in range(PROBES):
        bit = second >> np.uint64(64 - 9 * (j + 1)) & np.uint64(511)
        yield first + (bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63))


def among(hashes: np.ndarray, filter_words: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at, mask in probes(hashes, 64 * len(filter_words)):
        found &= filter_words[at] & mask != 0
    return found


def bloom(phrases: DataFrame) -> np.ndarray:
    """Filter of ``phrases(lang, phrase)`` as 64-bit words, at most ``MOST_BITS`` bits: the only thing that comes to the driver."""
    n = phrases.count()
    bits = min(MOST_BITS, 1 << max(10, (n * BITS_A_PHRASE - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            hashes = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = np.array([xxh64_intdigest(w) for w in phrase.encode().split(b" ")], np.uint64)
                hashes[i] = phrase_hashes(lang, words, len(words))[0]
            for at, mask in probes(hashes, bits):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(mask.view(np.int64))], names=["at", "mask"])

    merged = phrases.select("lang", "phrase").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[merged.column("at").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return out


def windows(ids: np.ndarray, n: int, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word windows within pieces, a column for each word, sorted by their words, and their counts; ``pairs`` says which two-word windows may be frequent."""
    if n == 1:
        known, counts = np.unique(ids[ids > 0], return_counts=True)
        return known[None], counts
    ok = np.ones(max(0, len(ids) - n + 1), bool)
    for j in range(n - 1):
        ok &= pairs[j : j + len(ok)]
    at = np.flatnonzero(ok)
    columns = [ids[at + j] for j in range(n)]
    keys = [columns[j] << 32 | (columns[j + 1] if j + 1 < n else 0) for j in range(0, n, 2)]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    changed = np.zeros(len(at), bool)
    changed[:1] = True
    for key in keys:
        key = key[order]
        changed[1:] |= key[1:] != key[:-1]
    begins = np.flatnonzero(changed)
    return np.stack([c[order[begins]] for c in columns]), np.diff(np.r_[begins, len(at)])


def cells_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and place in it of each hash."""
    cells = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return cells >> BLOCK_BITS, cells & ((1 << BLOCK_BITS) - 1)


def sketched(hashes: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """Occupied cells by block, as 32-bit numbers: place << 12 | count, counts not above ``most``."""
    block, place = cells_of(hashes)
    cells, counts = np.unique(block << BLOCK_BITS | place, return_counts=True)
    begins = np.flatnonzero(np.r_[True, (cells[1:] >> BLOCK_BITS) != (cells[:-1] >> BLOCK_BITS)]) if len(cells) else []
    packed = ((cells & ((1 << BLOCK_BITS) - 1)) << 12 | np.minimum(counts, most)).astype("<u4")
    for begin, part in zip(begins, np.split(packed, begins[1:]), strict=True) if len(cells) else ():
        yield int(cells[begin] >> BLOCK_BITS), part.tobytes()


def _cell_merger(most: int, final: bool):
    """Sum of the cells of each block in rows sorted by block; ``final``: a bitmap of the cells that reach ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now = np.zeros(1 << BLOCK_BITS, np.int32), None

        def closed() -> Iterator[pa.RecordBatch]:
            if now is not None:
                at = np.flatnonzero(sums)
                data = np.packbits(sums >= most, bitorder="little") if final else (at << 12 | np.minimum(sums[at], most)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "cells"])
                sums[:] = 0

        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    yield from closed()
                    now = block
                packed = np.frombuffer(cells.as_buffer(), "<u4")
                sums[packed >> 12] += (packed & 4095).astype(np.int32)  # a place occurs once in a row
        yield from closed()

    return run


def sketch(cells: DataFrame, least: int) -> np.ndarray:
    """Bytes of a bitmap with a bit for each cell that ``least`` pairs fall into: 16 MB, the only thing that comes to the driver."""
    kind = "block int, cells binary"
    most = min(least, 4095)
    some = cells.repartition("block", F.pmod(F.xxhash64("cells"), F.lit(MERGES))).sortWithinPartitions("block").mapInArrow(_cell_merger(most, False), kind)
    whole = some.repartition("block").sortWithinPartitions("block").mapInArrow(_cell_merger(most, True), kind).toArrow()
    out, size = np.zeros(1 << (CELL_BITS - 3), np.uint8), 1 << (BLOCK_BITS - 3)
    for block, data in zip(whole.column("block").to_pylist(), whole.column("cells").to_pylist(), strict=True):
        out[block * size : (block + 1) * size] = np.frombuffer(data, np.uint8)
    return out


RUNS = "lang string, phrase string, f long, block int, cells binary"


def counted(docs: DataFrame, lengths: tuple[int, ...], least: int, *, bitmap: np.ndarray | None = None, filter_words: np.ndarray | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Sorted runs ``(lang, phrase, f)`` of the tasks' tries, and with length 1 the sketch's cells ``(block, cells)`` of pairs.

    Longer phrases are counted where their pairs are in the sketch's ``bitmap``
    or in a filter.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bitmap if bitmap is not None else filter_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        words, tries, slabs = Words(), {}, {}

        def insert(lang: str) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(slabs.pop(lang))
            pairs = None
            if len(ids) > 1:
                hashes = phrase_hashes(lang, np.array(words.hashes, np.uint64)[ids], 2)
                pairs = (ids[:-1] > 0) & (ids[1:] > 0)
                at = np.flatnonzero(pairs)
                if 1 in lengths:
                    rows = list(sketched(hashes[at], least))
                    none = pa.nulls(len(rows))
                    yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=names)
                elif known.dtype == np.uint8:
                    cells = (hashes[at] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                    pairs[at] = known[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1
                else:
                    pairs[at] = among(hashes[at], known)
            for n in lengths:
                if len(ids) >= n:
                    tries.setdefault((lang, n), HatTrie(n)).add(*windows(ids, n, pairs))
            if sum(t.size for t in tries.values()) > MOST_ENTRIES:
                yield from spilled(MOST_ENTRIES // 2)

        def spilled(down_to: int) -> Iterator[pa.RecordBatch]:
            """Sorted runs of the largest subtrees until ``down_to`` phrases are left."""
            left, chosen = sum(t.size for t in tries.values()), {}
            for size, key, word in sorted(((s, key, w) for key, t in tries.items() for s, w in t.subtrees()), reverse=True):
                if left <= down_to:
                    break
                left -= size
                chosen.setdefault(key, []).append(word)
            if not chosen:
                return
            named = pa.array(words.names, pa.binary())
            rank = np.empty(len(named), np.int64)
            rank[pc.array_sort_indices(named).to_numpy()] = np.arange(len(named))
            for (lang, n), own in chosen.items():
                columns, counts = tries[lang, n].taken(own)
                order = np.lexsort([rank[c] for c in columns[::-1]])
                for begin in range(0, len(order), 50_000):
                    at = order[begin : begin + 50_000]
                    parts = [named.take(pa.array(c[at])) for c in columns]
                    phrase = (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrase, pa.array(counts[at]), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=names)

        names = ["lang", "phrase", "f", "block", "cells"]
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                tokens = words_of(text.as_py() or b"")
                ids = np.zeros(len(tokens) + 1, np.int64)
                ids[:-1] = list(map(words.__getitem__, tokens))
                slabs.setdefault(lang, []).append(ids)
                sizes[lang] = sizes.get(lang, 0) + len(ids)
                if sizes[lang] >= SLAB:
                    sizes[lang] = 0
                    yield from insert(lang)
                if len(words) > MOST_WORDS:
                    for own in list(slabs):
                        sizes[own] = 0
                        yield from insert(own)
                    yield from spilled(0)
                    words, tries = Words(), {}
        for own in list(slabs):
            yield from insert(own)
        yield from spilled(0)

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, RUNS)


def merged(runs: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, f, words)``: sums of the phrases of ``runs`` that reach ``least``."""
    prefix = F.regexp_replace("phrase", r" [^ ]*\z", "")
    last = F.pmod(F.xxhash64(F.substring_index("phrase", " ", -1)), F.lit(SLOTS))
    dealt = runs.select("lang", "phrase", "f").repartition("lang", prefix, last).sortWithinPartitions("lang", "phrase")
    out = dealt.mapInArrow(_merger(least), "lang string, phrase string, f long")
    return written(out.withColumn("words", F.size(F.split("phrase", " "))), "phrases")


def _merger(least: int):
    """Sum of equal neighbours in sorted rows; sums below ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            lang, phrase, f = batch.columns
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(phrase[1:], phrase[:-1])).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, ~same])
            sums = np.add.reduceat(f.to_numpy(), begins)
            summed = pa.RecordBatch.from_arrays([lang.take(begins), phrase.take(begins), pa.array(sums)], names=["lang", "phrase", "f"])
            held = summed.slice(summed.num_rows - 1)
            yield summed.slice(0, summed.num_rows - 1).filter(pa.array(sums[:-1] >= least))
        if held is not None:
            yield held.filter(pc.greater_equal(held.column("f"), least))

    return run


def parts(words: Column) -> Column:
    """Array of struct(cut, side, part): both parts of each cut of an array of words."""
    at = F.sequence(F.lit(1), F.size(words) - 1)
    both = lambda k: F.array(
        F.struct(k.alias("cut"), F.lit("l").alias("side"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("cut"), F.lit("r").alias("side"), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("part")),
    )
    return F.flatten(F.transform(at, both))


def inner(words: Column) -> Column:
    """The shorter phrases of two words or more inside an array of words."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), of))


def scored(counts: DataFrame, *, cover: int = 80) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the candidates among ``counts(lang, phrase, f, words)`` that no longer one covers by ``cover`` in a hundred."""
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")
    split = F.split("phrase", " ")
    asked = candidates.select("lang", "phrase", "a", F.inline(parts(split)))
    known = counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), "f")
    met = asked.join(known, (F.col("lang") == F.col("of_lang")) & (F.col("part") == F.col("of")))
    f_of = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    cuts = range(1, LONGEST)
    sides = met.groupBy("lang", "phrase", "a").agg(*[f_of(k, s) for k in cuts for s in "lr"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    one = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * wide("a"), wide(f"l{k}") + wide(f"r{k}")).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]
    lowest = sides.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*one))).alias("lowest")).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")
    covering = candidates.where("words > 2").select(F.col("lang").alias("of_lang"), F.explode(inner(split)).alias("of"), "a").groupBy("of_lang", "of").agg(F.max("a").alias("longer"))
    left = lowest.join(covering, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of")), "left")
    covered = F.lit(100).cast("decimal(18,0)") * wide("longer") >= F.lit(cover).cast("decimal(18,0)") * wide("a")
    return left.where(~F.coalesce(covered, F.lit(False))).select(*lowest.columns)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank: rows are dealt to ranges of the order, and only ranges that begin before ``top`` are numbered."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = written(rows.repartitionByRange(F.asc("lang"), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("lang", "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select(F.col("lang").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")).where(F.col("start") < top)
    near = dealt.join(starts, (F.col("lang") == F.col("of")) & (F.col("range") == F.col("at")))
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    return near.withColumn("rank", (F.col("start") + place).cast("long")).where(F.col("rank") <= top).select("rank", *rows.columns)


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to four words."""
    columns = {"lang_col": lang_col, "text_col": text_col}
    first = written(counted(docs, (1,), least, **columns), "words")
    singles = merged(first.where("block is null"), 1)
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    bitmap = sketch(first.where("block is not null").select("block", "cells"), least)
    twos = merged(counted(docs, (2,), least, bitmap=bitmap, **columns), least)
    longer = merged(counted(docs, (3, 4), least, filter_words=bloom(twos), **columns), least)
    counts = singles.where(F.col("f") >= least).unionByName(twos).unionByName(longer)
    best = ranked(written(scored(counts, cover=cover), "scored"), top)
    named = totals.withColumnRenamed("lang", "of")
    return best.join(named, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
