"""Alignment of two tokenizers by inverted pair bitmaps.

Each text, with one space put before it, is cut by a byte-level BPE (A) and by
a sentencepiece model (B). Byte offsets where tokens of both end cut the text
into groups; the A and the B token that end at such an offset are linked.

Documents are dealt to containers of at most ``ROOM`` documents. For each pair
of ids a container keeps compressed bitmaps of its documents, one for each
binary digit of the number of links that the document holds (multiplicity
planes): an array of 16-bit places, or a bitmap where that is shorter. The
planes OR-merged and popcounted are the pair's document count there, and
popcounted by digit its link count; containers hold different documents, so
corpus counts are their sums. Then the postings meet their pair's corpus count
and carry it back to their container, where every document adds up its scores.

Texts are cut into chunks before a blank or line feed that follows no white
space. A never crosses that boundary, and B has no piece that does, so a
chunk's tokens are kept in a memo, bounded in bytes, and the tokens of a text
are those of its chunks in a row. Marks that end a word are a unit of their own.

Defined cases: null and empty texts, and texts whose joined token bytes are
not the text's (such as those with U+2581), have no tokens: zeros and an empty
``groups``. Special tokens' strings are plain text. Repeated rows count each;
ids may repeat or be null; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

#: Documents of a container at most; a bitmap has ROOM / 8 bytes.
ROOM = 8192
BITMAP = ROOM // 8
MOST_LINKS = 2_000_000
MOST_MEMO_BYTES = 1 << 27
LONGEST_KEPT = 64
#: Texts whose new chunks are aligned together.
SLAB = 128
ENTRY = 400  # bytes of a memo entry besides its texts, about

MARK = "▁"
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
#: A text without these, and without white space in front, has each blank and line feed alone between other characters.
_UNUSUAL = ("  ", " \n", "\n ", "\n\n", *map(chr, (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Byte-level models write printable Latin-1 bytes as themselves and the others as the code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Aligner:
    """The two tokenizers and a memo of aligned chunks: token counts, groups and numbers of linked pairs (A id << 32 | B id) by chunk number."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for piece, i in names.items():
            if all(c in _BYTE_OF for c in piece):
                self.a_bytes[i] = bytes(map(_BYTE_OF.__getitem__, piece))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes, self.joined = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses the boundary of a chunk")
                self.b_bytes.append(piece.replace(MARK, " ").encode())
                self.joined.update(map("".join, zip(piece, piece[1:], strict=False)))
        self.a_length, self.b_length = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.a_name, self.b_name = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))
        self.alone = self.b.piece_to_id(MARK)
        self.emptied()

    def emptied(self) -> None:
        self.word: dict[str, int] = {}  # chunks without the blank in front of them, or beginning with a line feed
        self.chunk: dict[str, int] = {}  # chunks of texts with unusual white space, whole
        self.unit: dict[str, int] = {}  # what chunks are put together from: a word with its blank, the marks after it
        self.groups: list[bytes] = []
        self.numbers = np.zeros((4, 1024), np.int64)  # A tokens, B tokens, links (-1: bytes differ), first link
        self.links: list[int] = []  # by their pair's number
        self.pair: dict[int, int] = {}
        self.held = 0

    def numbered(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the chunks of each text."""
        cut = []
        for text in texts:
            if not text:
                cut.append(([], self.word))
            elif text[0] in " \n" or any(map(text.__contains__, _UNUSUAL)):
                cut.append((_BOUNDARY.split(" " + text), self.chunk))
            else:
                cut.append((text.replace("\n", " \n").split(" "), self.word))
        own: dict[int, dict[str, int]] = {}
        for known, align in ((self.word, self.composed), (self.chunk, self.learn)):
            fresh = dict.fromkeys(p for parts, of in cut if of is known for p in parts if p not in known)
            found = dict(zip(fresh, align(list(fresh)), strict=True))
            own[id(known)] = {p: n for p, n in found.items() if len(p) > LONGEST_KEPT}
            known.update((p, n) for p, n in found.items() if len(p) <= LONGEST_KEPT)
        out = []
        for parts, known in cut:
            long = own[id(known)]
            out.append([long[p] if p in long else known[p] for p in parts] if long else list(map(known.__getitem__, parts)))
        return out

    def composed(self, words: list[str]) -> list[int]:
        """Numbers of chunks given without their blank; the marks that end a word are aligned apart from it.

        A parts a letter from the marks after it, and so does B where no piece
        has both in a row.
        """
        cut = []
        for word in words:
            head = word.rstrip(string.punctuation)
            if head and head != word and head[-1] < "\u0530" and head[-1].isalpha() and head[-1] + word[len(head)] not in self.joined:
                cut.append((head if head[0] == "\n" else " " + head, "\n" + word[len(head) :]))
            else:
                cut.append((word if word[:1] == "\n" else " " + word, ""))
        fresh = list(dict.fromkeys(h for h, _ in cut if h not in self.unit))
        found = dict(zip(fresh, self.learn(fresh), strict=True))
        marks = list(dict.fromkeys(t for _, t in cut if t and t not in self.unit))
        found |= dict(zip(marks, self.learn(marks, bare=True), strict=True))
        self.unit.update((k, n) for k, n in found.items() if len(k) <= LONGEST_KEPT)
        of = lambda k: found[k] if k in found else self.unit[k]
        both = [(of(h), of(t)) for h, t in cut if t]
        numbers = iter(self._joined(both))
        return [next(numbers) if t else of(h) for h, t in cut]

    def _joined(self, pairs: list[tuple[int, int]]) -> range:
        """Numbers of chunks that are two units in a row."""
        first, rows, out = len(self.groups), [], []
        parts = [self.numbers[:, list(x)].T.tolist() for x in zip(*pairs, strict=True)]
        for (x, y), (a1, b1, n1, f1), (a2, b2, n2, f2) in zip(pairs, *parts, strict=True) if pairs else ():
            if n1 < 0 or n2 < 0:
                rows.append((0, 0, -1, len(self.links)))
                out.append(b"")
                continue
            rows.append((a1 + a2, b1 + b2, n1 + n2, len(self.links)))
            out.append(self.groups[x] + b";" + self.groups[y])
            self.links += self.links[f1 : f1 + n1]
            self.links += self.links[f2 : f2 + n2]
            self.held += ENTRY // 2 + 2 * len(out[-1]) + 8 * (n1 + n2)
        self._add(rows, out)
        return range(first, first + len(rows))

    def _add(self, rows: list[tuple[int, int, int, int]], groups: list[bytes]) -> None:
        first, n = len(self.groups), len(groups)
        if first + n > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros((4, max(n, self.numbers.shape[1])), np.int64)], axis=1)
        if n:
            self.numbers[:, first : first + n] = np.array(rows, np.int64).T
        self.groups += groups

    def learn(self, chunks: list[str], bare: bool = False) -> range:
        """Align ``chunks``, each of which begins with a blank or a line feed; ``bare``: a line feed in front that is no part of them."""
        first = len(self.groups)
        by_a = self.a.encode_batch_fast(chunks, add_special_tokens=False) if chunks else []
        by_b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1) if chunks else []
        a_bytes, b_bytes, a_length, b_length, a_name, b_name = self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.a_length.__getitem__, self.b_length.__getitem__, self.a_name.__getitem__, self.b_name.__getitem__
        pair, links, rows, out, comma = self.pair, self.links, [], [], ",".join
        for chunk, found, bs in zip(chunks, by_a, by_b, strict=True):
            ids = found.ids
            if chunk[0] == "\n":
                bs = bs[1:]  # the blank that the model adds
            elif chunk == " ":
                bs = [self.alone]
            data = chunk.encode()
            if b"".join(map(a_bytes, ids)) != data or b"".join(map(b_bytes, bs)) != data:
                rows.append((0, 0, -1, len(links)))
                out.append(b"")
                continue
            if bare:
                ids, bs = ids[1:], bs[1:]
            begin, parts, from_a, from_b = len(links), [], 0, 0
            a_ends, b_ends = list(accumulate(map(a_length, ids))), list(accumulate(map(b_length, bs)))
            cuts = set(a_ends).intersection(b_ends)
            for cut in sorted(cuts) if len(cuts) > 1 else cuts:
                i, j = a_ends.index(cut, from_a) + 1, b_ends.index(cut, from_b) + 1
                parts.append(f"{comma(map(a_name, ids[from_a:i]))}|{comma(map(b_name, bs[from_b:j]))}")
                links.append(pair.setdefault(ids[i - 1] << 32 | bs[j - 1], len(pair)))
                from_a, from_b = i, j
            out.append(";".join(parts).encode())
            rows.append((len(ids), len(bs), len(parts), begin))
            self.held += ENTRY + 4 * len(chunk) + len(out[-1]) + 8 * len(parts)
        self._add(rows, out)
        return range(first, len(self.groups))


_kept: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a_path, b_path) not in _kept:
        _kept[a_path, b_path] = Aligner(a_path, b_path)
    return _kept[a_path, b_path]


def compressed(places: np.ndarray) -> bytes:
    """Sorted places in a container as 16-bit numbers, or as a bitmap where that is shorter."""
    if 2 * len(places) < BITMAP:
        return places.astype("<u2").tobytes()
    bits = np.zeros(ROOM, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def places_of(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < BITMAP:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def popcount(bitmap: bytes) -> int:
    return len(bitmap) // 2 if len(bitmap) < BITMAP else int(np.bitwise_count(np.frombuffer(bitmap, np.uint64)).sum())


def merged(planes: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    return planes[0] if len(planes) == 1 else compressed(np.unique(np.concatenate([places_of(p) for p in planes])))


def planes_by_pair(numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct pair numbers of a container's links, sorted, and each one's multiplicity planes."""
    keys, counts = np.unique(numbers * ROOM + places, return_counts=True)
    known = np.unique(keys // ROOM)
    out: list[list[bytes]] = [[] for _ in known]
    for digit in range(int(counts.max(initial=0)).bit_length()):
        own = keys[counts >> digit & 1 == 1]
        of, at = np.searchsorted(known, own // ROOM), own % ROOM
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(own) else []
        for pair, part in zip(of[begins].tolist(), np.split(at, begins[1:]), strict=True) if len(own) else []:
            out[pair] += [b""] * (digit - len(out[pair])) + [compressed(part)]
    return known, out


SCHEMA = pa.schema(
    [("container", pa.int64()), ("pair", pa.int64()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("planes", pa.list_(pa.binary())), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string())]
)
COLUMNS = "container long, pair long, n_docs long, n_links long, planes array<binary>, place int, n_a long, n_b long, n_groups long, groups string"


def postings(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each document (pair null) and for each pair of each container (place null).

    Columns: container, pair (A id << 32 | B id), n_docs, n_links, planes;
    place, n_a, n_b, n_groups, groups (``a,a|b;a|b,b``, its SHA-256 in hex with
    ``digest``), doc_id. The table is written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        container, chunks, rows, n_links = part << 32, [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal container, chunks, rows, n_links
            n = len(rows)
            if n:
                none = pa.nulls(n)
                own = [[container] * n, none, none, none, none, range(n), *(list(x) for x in zip(*[r[1:] for r in rows], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) if not isinstance(x, pa.Array) else x.cast(t.type) for x, t in zip(own, SCHEMA, strict=True)] + [pa.concat_arrays([r[0] for r in rows])], names=names)
            if chunks:
                at, places = np.concatenate(chunks), np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
                counts, begins = known.numbers[2][at], known.numbers[3][at]
                ends = np.cumsum(counts)
                links = np.array(known.links, np.int64)[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
                own_pairs, planes = planes_by_pair(links, np.repeat(places, counts))
                pairs = np.fromiter(known.pair, np.int64, len(known.pair))[own_pairs]
                for k in range(0, len(pairs), 10_000):
                    own, n = planes[k : k + 10_000], len(pairs[k : k + 10_000])
                    n_docs = [popcount(merged(p)) for p in own]
                    totals = [sum(popcount(x) << d for d, x in enumerate(p)) for p in own]
                    none = [pa.nulls(n, t.type) for t in list(SCHEMA)[5:]]
                    yield pa.RecordBatch.from_arrays([pa.array([container] * n, pa.int64()), pa.array(pairs[k : k + 10_000]), pa.array(n_docs, pa.int64()), pa.array(totals, pa.int64()), pa.array(own, pa.list_(pa.binary())), *none, pa.nulls(n, id_type)], names=names)
            container, chunks, rows, n_links = container + 1, [], [], 0

        names, id_type = [*SCHEMA.names, "doc_id"], pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for begin in range(0, batch.num_rows, SLAB):
                slab = batch.slice(begin, SLAB)
                for i, numbers in enumerate(known.numbered(slab.column(1).to_pylist())):
                    idx = np.array(numbers, np.int64)
                    n_a, n_b, n, _ = known.numbers[:, idx]
                    if not len(idx) or n.min() < 0:
                        idx, found = idx[:0], (0, 0, 0, "")
                    else:
                        groups = b";".join(map(known.groups.__getitem__, numbers))
                        found = (int(n_a.sum()), int(n_b.sum()), int(n.sum()), hashlib.sha256(groups).hexdigest() if digest else groups.decode())
                    rows.append((slab.column(0).slice(i, 1), *found))
                    chunks.append(idx)
                    n_links += found[2]
                    if len(rows) == ROOM or n_links >= MOST_LINKS:
                        yield from closed()
                if known.held > MOST_MEMO_BYTES:
                    yield from closed()
                    known.emptied()
        yield from closed()

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(own.mapInArrow(run, f"{COLUMNS}, doc_id {own.schema['doc_id'].dataType.simpleString()}"), "postings")


def pair_counts(posted: DataFrame) -> DataFrame:
    """``(pair, a, b, n_docs, n_links, best)`` of ``postings``: corpus counts, and whether no other pair of its B id has more links."""
    counts = written(posted.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("of")).agg(F.max("n_links").alias("highest"))
    marked = counts.withColumn("b", b).join(highest, F.col("b") == F.col("of"))
    return marked.select("pair", F.shiftright("pair", 32).alias("a"), "b", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def scores(posted: DataFrame) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum)`` of every document of ``postings``."""
    counts = pair_counts(posted).select(F.col("pair").alias("of"), F.col("n_links").alias("count"), "best")
    sent = posted.where("pair is not null").select("container", "pair", "planes").join(counts, F.col("pair") == F.col("of")).select("container", "count", "best", "planes")
    docs = posted.where("pair is null").select("container", "place", "doc_id", "n_a", "n_b", "n_groups", "groups")
    both = docs.unionByName(sent, allowMissingColumns=True)
    kind = posted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, [], np.zeros((3, ROOM), np.int64)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, sums
            if held:
                table = pa.Table.from_batches(held)
                at = table.column("place").to_numpy()
                own = [table.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "groups")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(s[at]) for s in sums)], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"])
            held, sums = [], np.zeros((3, ROOM), np.int64)

        for batch in batches:
            containers = batch.column("container").to_numpy()
            begins = np.flatnonzero(np.r_[True, containers[1:] != containers[:-1]]) if len(containers) else []
            for begin, end in zip(begins, [*begins[1:], len(containers)], strict=True):
                if containers[begin] != now:
                    yield from closed()
                    now = containers[begin]
                part = batch.slice(begin, end - begin)
                on = part.column("place").is_valid()
                if on.true_count:
                    held.append(part.filter(on))
                sent = part.filter(part.column("place").is_null())
                if sent.num_rows:
                    _add(sums, sent)
        yield from closed()

    dealt = both.repartition("container").sortWithinPartitions("container", F.col("place").asc_nulls_last())
    return dealt.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long")


def _add(sums: np.ndarray, sent: pa.RecordBatch) -> None:
    """Add the links, best links and counts of postings to their container's documents."""
    counts, best = sent.column("count").to_numpy(), sent.column("best").to_numpy(zero_copy_only=False)
    short, long = [], []
    for row, planes in enumerate(sent.column("planes").to_pylist()):
        for digit, plane in enumerate(planes):
            (short if len(plane) < BITMAP else long).append((row, digit, plane))
    if short:
        sizes = [len(p) // 2 for _, _, p in short]
        places = np.frombuffer(b"".join(p for _, _, p in short), "<u2")
        rows, links = np.repeat([r for r, _, _ in short], sizes), np.repeat([1 << d for _, d, _ in short], sizes)
        for out, weight in zip(sums, (links, links * best[rows], links * counts[rows]), strict=True):
            np.add.at(out, places, weight)
    for row, digit, plane in long:
        places, links = places_of(plane), 1 << digit
        for out, weight in zip(sums, (links, links * int(best[row]), links * int(counts[row])), strict=True):
            out[places] += weight


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Tokenise, link and score all of ``docs``: see ``postings`` and ``scores``."""
    return scores(postings(docs, a_path, b_path, id_col=id_col, text_col=text_col, digest=digest))
