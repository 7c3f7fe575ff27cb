"""Token counts by greedy word-piece matching with a linear automaton.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that continue one. A node's failure link leads to the node for what is left
after the longest pieces have been popped from the node's string, and the
node keeps how many that were. Walking a word's characters and following
failure links counts its pieces in time linear in its length, without
building them. A word that cannot be cut into pieces counts as one unknown
token.

Words are runs of letters, marks and digits; any other character that is not
white space is a word of its own.

Defined cases: null and empty text has 0 tokens and 0 words; words have no
greatest length; repeated rows each get a row; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
BEGINS = "▁"
MOST_CACHED = 1_000_000


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, rest = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(BEGINS):
            begin.append(piece[1:])
        else:
            rest.append(piece)
    # A single character continues a word wherever it begins one.
    rest += [p for p in begin if len(p) == 1]
    return sorted({p for p in begin if p}), sorted({p for p in rest if p})


class Automaton:
    """Trie nodes as parallel lists: children, failure link (-1: none) and the pieces popped on the way to it."""

    ROOT, INSIDE = 0, 1

    def __init__(self, begin: list[str], rest: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.piece = [False, False]
        for root, pieces in ((self.ROOT, begin), (self.INSIDE, rest)):
            for p in pieces:
                node = root
                for c in p:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        self.piece.append(False)
                self.piece[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([self.ROOT, self.INSIDE])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if self.piece[child]:
                    self.fail[child], self.popped[child] = self.INSIDE, 1
                else:
                    back, n = self.fail[node], self.popped[node]
                    while back >= 0 and c not in self.next[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.popped[child] = self.next[back][c], n
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of one word, 1 if it has no cut."""
        node, n = self.ROOT, 0
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                n += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node not in (self.ROOT, self.INSIDE):
            if self.fail[node] < 0:
                return 1
            n += self.popped[node]
            node = self.fail[node]
        return n


class Counts(dict):
    """A bounded memo of word lengths in pieces."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(self) >= MOST_CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Automaton(*vocabulary(vocabulary_path)))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                found = WORD.findall(text.as_py() or "")
                n_words.append(len(found))
                n_tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
