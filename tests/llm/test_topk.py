import math
import random

from pyspark.sql import functions as F

from millrace.llm import topk


def plain(rows, every, k):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in ints:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_exact_over_many_annuli_and_equal_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, [0.5, 0.25, -1.0, 0.0, 2.0, 1.0]) for i in range(400)]  # one vector, very often
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5, pivot_rows=100, ring_rows=40, block_rows=64, query_rows=7)
    import struct

    single = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    assert found(got) == plain(single, 50, 5)


def test_all_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert found(topk.search(table, F.col("vec_id") % 50 == 0)) == plain(rows, 50, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (100, [2.0, 1.0, 0.5]), (8, [1.0, 1.0, 1.0]), (9, [0.0, 0.0]), (150, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    assert found(topk.search(table, F.col("vec_id") % 50 == 0)) == plain(rows, 50, 5)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(table.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def clustered(clusters=40, each=60, dim=24):
    rng = random.Random(8)
    rows = []
    for c in range(clusters):
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        rows += [(c + clusters * i, [x * (1 + i % 4) + rng.gauss(0, 0.05) for x in centre]) for i in range(each)]
    return rows


def test_bounds_hold_for_every_vector(spark):
    ints = spark.createDataFrame([(i, [math.floor(256 * x) for x in v]) for i, v in clustered(10, 40)], "vec_id long, v array<long>")
    placed, index = topk.build(ints, 400, 5000, pivot_rows=50, ring_rows=10)
    cell_of = {r.vec_id: r.cell for r in placed.collect()}
    rows = {r.vec_id: r.v for r in ints.collect()}
    at = {c: n for n, c in enumerate(index.cells["cell"])}
    import numpy as np

    for q, v in list(rows.items())[::9]:
        bound = topk.bounds_of(np.array([v]), index)[0]
        assert all(sum(a * b for a, b in zip(v, w, strict=True)) <= bound[at[cell_of[i]]] for i, w in rows.items())


def test_clustered_vectors_leave_most_annuli_unvisited(spark):
    table = spark.createDataFrame(clustered(), "vec_id long, embedding array<double>")
    sizes = {"pivot_rows": 40, "ring_rows": 20, "block_rows": 64, "query_rows": 16}
    assert found(topk.search(table, F.col("vec_id") % 50 == 0, **sizes)) == plain(clustered(), 50, 5)
    assert topk.visited_share(table, F.col("vec_id") % 50 == 0, **sizes) < 0.2
