"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words that toxic texts use far more
often than others, and stems whose many endings do so. It is held as a trie.
A word is run through the intersection of the trie with Levenshtein automata
(a state is a set of trie nodes with the edits spent), made deterministic on
demand, so misspelled terms are found without comparing a word to each term.

Every hit is seen in its window of words. Context words are learned too: words
that stand near hits in toxic texts more, or less, often than near hits in
others (reports and rejections). Hits inside quotation marks are summed apart
from the rest. A logistic model over these sums decides what quotation, context
and company of a hit are worth; nothing of that is fixed by hand.

What is learned is bounded by the sample of labelled rows, not by a rank: all
terms, stems and context words that pass the thresholds are kept.

Defined cases: null and empty texts score as texts without a hit; without
toxic and other training rows every score is 0; repeated labels of an id count
as toxic if any does; repeated rows each get a row; an empty table gives an
empty result; further columns of the input may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from millrace.llm.columns import free_name
from millrace.scratch import written

WORD = re.compile(r"\w+")
WINDOW = 8
MOST_CACHED = 500_000
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
def edits_for(term: str) -> int:
    """Edits a term of this length allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    terms: dict[str, float]  # weight of the exact term
    stems: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)  # weight of its misspellings
    context: dict[str, float] = field(default_factory=dict)  # log odds of a word near hits


class TrieAutomaton:
    """Deterministic on demand: states are frozen sets of (node, edits spent)."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]  # edits that some term below allows
        for word, at in [*((w, self.term) for w in lexicon.terms), *((w, self.stem) for w in lexicon.stems)]:
            node, path = 0, [0]
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            at[node] = word
            if at is self.term:
                for x in path:
                    self.most[x] = max(self.most[x], edits_for(word))
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """The state of these nodes and of those a left-out letter leads to; -1 if there are none."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            e = spent[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < spent.get(child, 99):
                    spent[child] = e
                    todo.append(child)
        key = frozenset(spent.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= edits_for(self.term[n])]
            self.ends.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] or cost == 0:
                    spent[child] = min(cost, spent.get(child, 99))
            if e + 1 <= self.most[node]:
                spent[node] = min(e + 1, spent.get(node, 99))
        to = self.moves[state][c] = self._state(spent)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and the edits to it; a stem that begins the word counts as exact."""
        node, stem = 0, None
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            stem = self.stem[node] or stem
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        end = self.ends[state] if state >= 0 else None
        if end and end[1] == 0:
            return end
        if stem:
            return stem, -1
        return end


class Matches(dict):
    """A bounded memo of words: None, or (term, edits)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.automaton = TrieAutomaton(lexicon)

    def __missing__(self, word: str):
        found = self.automaton.find(word)
        if len(self) >= MOST_CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        if len(self.automaton.sets) > 200_000:  # states that are made on demand stay bounded
            self.automaton = TrieAutomaton(self.lexicon)
        return found


def hits_of(text: str | None, matches: Matches) -> tuple[list[str], list[tuple[int, str, int]]]:
    """The words of a text and its hits: (place, term, edits; -1 for a stem)."""
    words = WORD.findall((text or "").lower())
    found = list(map(matches.__getitem__, words))
    return words, [(i, *m) for i, m in enumerate(found) if m]


@dataclass
class Hit:
    weight: float
    quoted: bool
    near: list[str]  # the other words of its window
    others: int  # neighbours in its window


def in_windows(text: str, words: list[str], hits: list[tuple[int, str, int]], lexicon: Lexicon) -> list[Hit]:
    """Each hit with its weight and what its window says of it."""
    if not hits:
        return []
    lower = text.lower()
    spans = [m.span() for m in WORD.finditer(lower)]
    places = [h[0] for h in hits]
    out = []
    for k, (i, term, edits) in enumerate(hits):
        weight = lexicon.terms.get(term, 0.0) if edits == 0 else lexicon.stems.get(term, 0.0) if edits < 0 else lexicon.fuzzy.get(term, 0.0)
        begin, end = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
        left, right = lower[begin : spans[i][0]], lower[spans[i][1] : end]
        quoted = any(left.count(o) % 2 if o == c else left.count(o) > left.count(c) for o, c in zip(OPENING, CLOSING, strict=True) if o in left and c in right and o != "'")
        others = (k > 0 and i - places[k - 1] <= WINDOW) + (k + 1 < len(places) and places[k + 1] - i <= WINDOW)
        out.append(Hit(weight, quoted, words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1], others))
    return out


FEATURES = 7


def features(text: str | None, matches: Matches, lexicon: Lexicon) -> list[float]:
    """One, the greatest and summed weight of plain hits, their share of the words, the summed weight of quoted hits, the mean context of all hits, and the share of hits in company."""
    words, found = hits_of(text, matches)
    hits = [h for h in in_windows(text or "", words, found, lexicon) if h.weight > 0]
    if not hits:
        return [1.0] + [0.0] * (FEATURES - 1)
    plain, quoted = [h.weight for h in hits if not h.quoted], [h.weight for h in hits if h.quoted]
    context = sum(max(-3.0, min(3.0, sum(lexicon.context.get(w, 0.0) for w in h.near))) for h in hits) / len(hits)
    return [1.0, max(plain, default=0.0), math.log1p(sum(plain)), sum(plain) / (10 + len(words)), math.log1p(sum(quoted)), context, sum(h.others > 0 for h in hits) / len(hits)]


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Ridge logistic fit by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trained: Column | None = None, most_rows: int = 20_000) -> DataFrame:
    """``(text, toxic)`` of about ``most_rows`` labelled documents, those with the lowest hashes of their ids.

    The sampled labels are bounded by ``most_rows`` and broadcast, so texts are not shuffled.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if trained is not None:
        own = own.where(trained)
    share = min(1.0, most_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**31)) < int(2**31 * share))
    sample = own.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    return docs.join(F.broadcast(sample), docs[id_col] == sample["__id"]).select(docs[text_col].alias("text"), "toxic")


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, toxic, other)``: training documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(set(WORD.findall((text or "").lower())))
            terms = sorted({*counts[0], *counts[1]})
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])

    partial = rows.mapInArrow(run, "term string, toxic long, other long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(rows: DataFrame, *, least_docs: int = 4, least_odds: float = 3.0, least_context: float = 1.0) -> Model | None:
    """Fit on ``rows(text, toxic)``, a bounded sample.

    The driver gets the terms, stems and context words that pass the
    thresholds (terms stand in ``least_docs`` toxic texts at least, so they
    are a share of the sample's words) and a few numbers a row.
    """
    rows = written(rows, "training")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    terms = written(term_counts(rows), "terms")
    odds = F.log((F.col("toxic") + 0.1) / (n1 + 0.2)) - F.log((F.col("other") + 0.1) / (n0 + 0.2))
    chosen = terms.withColumn("w", odds).where((F.col("toxic") >= least_docs) & (F.col("w") >= least_odds) & (F.length("term") >= 3))
    top = {r["term"]: r["w"] for r in chosen.orderBy("term").collect()}
    prefixes = terms.where(F.length("term") >= 5).select("term", "toxic", "other", F.explode(F.expr("transform(sequence(4, least(7, length(term) - 1)), n -> substring(term, 1, n))")).alias("stem"))
    stems = prefixes.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count_if(F.col("toxic") > 0).alias("endings"))
    stems = stems.withColumn("w", odds).where((F.col("endings") >= 5) & (F.col("toxic") >= 3 * least_docs) & (F.col("w") >= least_odds + 1))
    kept: dict[str, float] = {}
    for r in stems.orderBy(F.length("stem"), "stem").collect():
        if not any(r["stem"][:k] in kept for k in range(4, len(r["stem"]))):
            kept[r["stem"]] = r["w"]
    lexicon = Lexicon(top, kept, {t: 1.0 for t in top})
    # Misspellings and context: how often training texts hold them decides what they weigh.
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def seen_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        matches = Matches(own)
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, found = hits_of(text, matches)
                near = {w for h in in_windows(text or "", words, found, own) for w in h.near if matches[w] is None}
                counts[toxic].update({(False, t) for _, t, e in found if e > 0} | {(True, w) for w in near})
            seen = sorted({*counts[0], *counts[1]})
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.bool_()), pa.array([t for _, t in seen], pa.string()), pa.array([counts[1][t] for t in seen], pa.int64()), pa.array([counts[0][t] for t in seen], pa.int64())], names=["context", "term", "toxic", "other"])

    near = rows.mapInArrow(seen_near, "context boolean, term string, toxic long, other long").groupBy("context", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    near = written(near.where((~F.col("context")) | (F.col("toxic") + F.col("other") >= least_docs)), "near")
    counted = {r["term"]: (r["toxic"], r["other"]) for r in near.where("not context").collect()}
    for t, w in top.items():
        a, b = counted.get(t, (0, 0))
        seen = math.log((a + 0.5 * n1 / (n0 + n1) + 0.1) / (n1 + 1)) - math.log((b + 0.5 * n0 / (n0 + n1) + 0.1) / (n0 + 1))
        lexicon.fuzzy[t] = max(0.0, min(w, seen)) if a + b else 0.6 * w
    # Context words: their odds near hits against those that hits have anyway, drawn to nought where they are rare.
    sums = near.where("context").agg(F.sum("toxic"), F.sum("other")).first()
    if sums[0] and sums[1]:
        p1 = sums[0] / (sums[0] + sums[1])
        shift = F.log((F.col("toxic") + 10 * p1) / p1) - F.log((F.col("other") + 10 * (1 - p1)) / (1 - p1))
        lexicon.context.update({r["term"]: r["w"] for r in near.where("context").select("term", shift.alias("w")).where(F.abs("w") >= least_context).collect()})
    shared = spark.sparkContext.broadcast(lexicon)
    names = [f"f{i}" for i in range(FEATURES)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(shared.value)
        for batch in batches:
            own = [features(t, matches, shared.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], pa.float64()) for i in range(FEATURES)] + [batch.column(1)], names=[*names, "toxic"])

    # In a fixed order, so that a fit does not depend on which task ends first.
    table = rows.mapInArrow(measured, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas().sort_values([*names, "toxic"])
    weights = logistic(table[names].to_numpy(), table["toxic"].to_numpy(float))
    return Model(lexicon, weights.tolist())


def score_name(docs: DataFrame) -> str:
    """The column that ``score`` adds with ``carry``."""
    return free_name("score", docs.columns)


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, score)`` of every row, or with ``carry`` all columns of ``docs`` and the score under ``score_name``."""
    name = score_name(docs) if carry else "score"
    if model is None:
        return docs.select("*", F.lit(0.0).alias(name)) if carry else docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = shared.value.lexicon, shared.value.weights
        matches = Matches(lexicon)
        for batch in batches:
            at = batch.schema.get_field_index(text_col if carry else "text")
            out = []
            for text in batch.column(at):
                z = sum(a * b for a, b in zip(features(text.as_py(), matches, lexicon), w, strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            cols = list(batch.columns) if carry else [batch.column(0)]
            names = list(batch.schema.names) if carry else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.float64())], names=[*names, name])

    if carry:
        return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
