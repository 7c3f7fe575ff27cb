"""Sum-of-squares packing of tokenised documents into sequences.

A document is tokenised, ended by an end id and, where longer than a
sequence, cut into pieces. Pieces go to bins by the sum-of-squares rule: of
the open bins' gaps that fit, and a new bin, take the one after which the sum
of squared counts of open bins per gap is smallest.

Pieces that fill a sequence need no bin. The others are dealt by hash, or by
their place in a stream, into groups of about ``group_pieces``, each packed on its own in order of falling
length; the number of groups follows the number of pieces, so a group's size
does not grow with the data. A group's bins that stay open are a share of
about one in a thousand.

Defined cases: null and empty texts have the end id alone; repeated rows are
packed each; equal lengths go by hash, id and piece; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

END_ID = 0
MOST_CACHED_BYTES = 1 << 28
LONGEST_CACHED = 64
ENTRY = 240  # bytes of an entry besides its texts, about


class WordBytes(dict):
    """Token ids of blank-free chunks as little-endian 32-bit words; a memo of the tokenizer, bounded in bytes.

    Chunks of more than ``LONGEST_CACHED`` characters (texts without blanks,
    encoded data) are not kept.

    The tokenizer cuts at white space, and between a letter and ASCII
    punctuation but for an apostrophe, before anything else, and does not look
    across either. A text's ids are those of its chunks in a row, and a chunk's
    those of its word and of the punctuation that ends it. It lower-cases, so
    ASCII words are kept in lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.emptied()

    def emptied(self) -> None:
        self.clear()
        self[""] = b""
        self.held = 0

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of ``chunks``; the short ones and their parts are kept."""
        import numpy as np

        parts, out = {}, {}
        for chunk in chunks:
            head = chunk.rstrip(_MARKS)
            if not head[-1:].lower()[-1:].isalpha():  # the lower case of one letter ends in a mark
                head = chunk
            parts[chunk] = (head.lower() if head.isascii() else head, chunk[len(head) :])
        fresh = [x for x in {x for pair in parts.values() for x in pair} if x not in self]
        rest = []
        for x in fresh:
            low = x.lower()
            # A word of letters alone is one unit of the model: no rule of the normalizer or splitter applies but lower case.
            if low.isalpha() and (x.isascii() or "\u03a3" not in x and is_normalized("NFC", x)):
                units = low if x.isascii() else low.encode().decode("latin-1").translate(_UNITS)
                out[x] = np.array([t.id for t in self.model.tokenize(units)], "<u4").tobytes()
            else:
                rest.append(x)
        for x, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[x] = np.array(found.ids, "<u4").tobytes()
        of = lambda x: out[x] if x in out else self[x]
        whole = {chunk: of(head) + of(tail) for chunk, (head, tail) in parts.items()}
        for x, ids in (out | whole).items():
            if len(x) <= LONGEST_CACHED and x not in self:
                self[x] = ids
                self.held += ENTRY + len(x) + len(ids)
        return whole


_BLANK = re.compile(r"[\t\n\r]")
_MARKS = "".join(c for c in string.punctuation if c != "'")
#: Byte-level models write printable Latin-1 bytes as themselves and the others as the code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_UNITS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_memo: dict[str, WordBytes] = {}


def word_bytes(path: str) -> WordBytes:
    """The memo of this Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _memo:
        _memo[path] = WordBytes(path)
    return _memo[path]


def token_bytes(text: str | None, words: WordBytes, memo_bytes: int | None = None) -> bytes:
    """All ids of a text and the end id; the memo is emptied once it holds more than ``memo_bytes``, or ``MOST_CACHED_BYTES``."""
    chunks = _BLANK.sub(" ", text or "").split(" ")
    fresh = {c for c in set(chunks) if c not in words}
    if fresh:
        new = words.learn(fresh)
        out = b"".join([new[c] if c in new else words[c] for c in chunks])
    else:
        out = b"".join(map(words.__getitem__, chunks))
    if words.held > (MOST_CACHED_BYTES if memo_bytes is None else memo_bytes):
        words.emptied()
    return out + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None, room: int = 2048, memo_bytes: int | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, place)`` per piece; place is that of the document, null without ``place_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_bytes(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = token_bytes(text.as_py(), words, memo_bytes)
                for k, begin in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[begin : begin + 4 * room]
                    row.append(i)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column(2).take(at)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "place"],
            )

    place = F.lit(None) if place_col is None else F.col(place_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), place.cast("long").alias("place"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long")


def sum_of_squares(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, placed in the order given."""
    import numpy as np

    open_bins: list[list[int]] = [[] for _ in range(room + 1)]  # by gap
    counts = np.zeros(room + 1, np.int64)
    # Moving a bin from gap g to g - n changes the sum of squares by
    # -2 N(g) + 1 + 2 N(g - n) + 1; gap 0 is closed and counts nothing.
    bins, offsets, made = [], [], 0
    for n in lengths:
        left = room - n
        gain = 2 - 2 * counts[n : room + 1]
        gain[1:] += 2 * counts[1 : left + 1]
        gain[0] -= 1  # filled up
        fresh = 2 * int(counts[left]) + 1 if left else 0
        usable = counts[n : room + 1] > 0
        gain = np.where(usable, gain, np.iinfo(np.int64).max)
        k = int(gain.argmin())
        if usable[k] and gain[k] <= fresh:
            gap = n + k
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = room, made
            made += 1
        bins.append(b)
        offsets.append(room - gap)
        if gap > n:
            open_bins[gap - n].append(b)
            counts[gap - n] += 1
    return bins, offsets


def pack(cut: DataFrame, *, room: int = 2048, group_pieces: int = 32_768) -> DataFrame:
    """``cut`` with sequence_id and offset; ``cut`` must be cheap to read twice.

    Pieces with a place are grouped by runs of ``group_pieces`` places, so
    sequences keep to their stretch of the stream and sequence ids follow it;
    others by a hash of the piece and its row, which also deals out rows that
    repeat.
    """
    full = cut.where(F.col("length") == room)
    rest = cut.where(F.col("length") < room)
    groups = max(1, -(-rest.count() // group_pieces))
    by_hash = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(groups))
    dealt = rest.withColumn("group", F.coalesce(F.floor(F.col("place") / group_pieces), by_hash).cast("long"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].tolist(), room)
        rows["sequence_id"] = [int(rows["group"].iloc[0]) * (1 << 33) + 2 * b for b in bins]
        rows["offset"] = offsets
        return rows[list(out)]

    out = {"doc_id": cut.schema["doc_id"].dataType.simpleString(), "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"}
    placed = dealt.drop("place").groupBy("group").applyInPandas(place, ", ".join(f"{k} {v}" for k, v in out.items()))
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone.select(*out))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None, room: int = 2048, group_pieces: int = 32_768, memo_bytes: int | None = None) -> DataFrame:
    """Tokenise, cut and pack all of ``docs``: a row per piece. ``place_col`` numbers the documents from 0 along the training stream."""
    cut = written(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, place_col=place_col, room=room, memo_bytes=memo_bytes), "pieces")
    return pack(cut, room=room, group_pieces=group_pieces)
