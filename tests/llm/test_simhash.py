import random

import numpy as np
import pytest
import xxhash

from millrace.llm import components, simhash


def plain_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def union(items, near):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if near(a, b):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {x: find(x) for x in items}


def test_groups_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: plain_fp(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    want = union(sorted(rows), lambda a, b: bin(rows[a] ^ rows[b]).count("1") <= 2)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == rows
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_links_join_exactly_the_near_ones(spark, segments):
    rng = random.Random(segments)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    fps = set(centres)
    for c in centres:
        at = c
        for _ in range(8):
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
            fps.add(at)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    items = sorted(map(signed, fps))
    edges = simhash.links(spark.createDataFrame([(x,) for x in items], "fp long"), segments)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    want = union(items, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert {x: roots.get(x, x) for x in items} == want


def test_crowded_points_are_split_without_losing_links(spark):
    """Points above the bound give the same groups as points below it; one crowd of 300 near copies."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i + 1)} | {rng.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = union(sorted(map(signed, fps)), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    for small in (3, 64, 10_000):
        roots = {r.node: r.root for r in components.components(simhash.links(table, small=small)).collect()}
        assert {x: roots.get(x, x) for x in want} == want


def test_manhattan_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    pairs += [(a, a ^ (1 << rng.randrange(63))) for a, _ in pairs]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.manhattan(F.col("a"), F.col("b"), 16).alias("m")).collect()
    for r in got:
        counts = lambda x: [(x >> 4 * i & 15).bit_count() for i in range(16)]
        assert r.m == simhash._segment_distance(np.array([r.a]), np.array([r.b]), 16)[0]
        assert r.m == sum(abs(x - y) for x, y in zip(counts(r.a), counts(r.b), strict=True)) <= (r.a ^ r.b).bit_count()


def test_awkward_texts_and_repeats(spark):
    rows = [(5, "", "x"), (3, None, "y"), (9, " \t\n", "z"), (4, "One two", "a"), (4, "one TWO", "b"), (7, "w " * 200_000, "c"), (None, "one two", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (4, 4), (7, 7), (None, 4)], key=str)
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    got = components.components(edges).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}
