import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from millrace.llm import registry, wordpiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(begin, rest):
    """Greedy word pieces by the tokenizers library: continuing pieces carry a prefix there."""
    vocab = {"[UNK]": 0}
    for p in begin:
        vocab.setdefault(p, len(vocab))
    for p in rest:
        vocab.setdefault("##" + p, len(vocab))
    model = Tokenizer(WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9))
    return lambda word: len(model.model.tokenize(word))


def plain(word, begin, rest):
    at, n = 0, 0
    while at < len(word):
        own = begin if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_random_vocabularies_against_greedy():
    rng = random.Random(7)
    for _ in range(300):
        piece = lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))
        begin, rest = {piece() for _ in range(rng.randint(1, 12))}, {piece() for _ in range(rng.randint(1, 12))}
        automaton = wordpiece.Automaton(sorted(begin), sorted(rest))
        for _ in range(40):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
            assert automaton.count(word) == plain(word, begin, rest), (word, begin, rest)


def test_all_documents_against_the_library(spark, sf):
    begin, rest = wordpiece.vocabulary(PATH)
    pieces = library(begin, rest)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in registry.op6(spark, "/root/testdata/sf0.001").collect()}
    memo = {}
    for i, text in texts.items():
        words = wordpiece.WORD.findall(text or "")
        for w in words:
            if w not in memo:
                memo[w] = pieces(w)
        assert got[i] == (len(words), sum(memo[w] for w in words))


@pytest.mark.parametrize("rows", [[(1, ""), (2, None), (3, "a" * 300_000), (3, "naïve_x 😀!"), (None, "two words")]])
def test_awkward_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens long")
    got = [tuple(r) for r in wordpiece.token_counts(docs, PATH).collect()]
    assert len(got) == len(rows) and (1, 0, 0) in got and (2, 0, 0) in got
    assert next(n for i, w, n in got if i == 3 and w == 1) > 1
    assert wordpiece.token_counts(docs.limit(0), PATH).count() == 0
