"""Exact top-k inner products with a pivot-distance index.

Each vector is keyed by its nearest pivot, its angle to that pivot and its
length. Angles obey the triangle inequality, so a query at angle t from a
pivot is at least t - hi or lo - t away from every vector of an annulus
[lo, hi]; by Cauchy-Schwarz the inner product with a vector of length up to
``most`` is then at most ``|query| * most * cos(that angle)``. A pivot's
vectors are cut by length and angle into annuli of about ``ring_rows``.

A query expands annuli in order of falling bound: first those that hold k
vectors, then, knowing its k-th best score, all others whose bound reaches
it. The rest cannot hold a better vector, so the result is exact. How much
that spares depends on the vectors: clustered ones leave most annuli
unvisited, while independent directions in many dimensions are all at nearly
the same angle and leave none (``visited_share`` tells).

Queries and annuli meet in blocks: an annulus of more than ``block_rows``
rows is split by hash, and so are the queries that visit it, ``query_rows`` a
part, so neither side of a block grows with the table.

Defined cases: vectors that are null, empty, or hold null or non-finite
components, and null ids take no part; vectors of different lengths do not
meet, and each length has an index of its own; rows with the query's own id
are not candidates; repeated ids give each of their vectors as a candidate,
and the query that is least by components; ties go to the smaller id; fewer
than k candidates give all; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import written

RINGS, BANDS = 64, 8
MOST_PIVOTS, MOST_CELLS = 4096, 65_536


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """``(vec_id, v)``: floor(factor * component)."""
    x = F.col("x")
    sound = x.isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return own.where(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda c: F.floor(c * factor).cast("long")).alias("v"))

@dataclass
class Index:
    """What the driver keeps of an index: pivots and annuli, at most ``MOST_CELLS`` and one a pivot."""

    pivots: np.ndarray  # (pivots, dim), of length one
    cells: pd.DataFrame  # cell, pivot, lo, hi, short, long, n, salts
    exact_float: bool


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector keeps its zeros."""
    v = v.astype(np.float64)
    size = np.sqrt((v * v).sum(1))
    return v / np.where(size > 0, size, 1.0)[:, None], size


def spread_out(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the directions of ``v`` at most, each the farthest from those before it."""
    units, size = _units(v)
    units = units[size > 0]
    if not len(units):
        return np.eye(1, v.shape[1])
    picked, near = [0], units @ units[0]
    while len(picked) < n and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, units @ units[picked[-1]])
    return units[picked]


def build(ints: DataFrame, n: int, most: int, *, pivot_rows: int = 4096, ring_rows: int = 2048, block_rows: int = 16_384) -> tuple[DataFrame, Index]:
    """The keyed rows ``(cell, salt, vec_id, v)`` of vectors of one length, and their index.

    Pivots grow with the rows, a pivot per ``pivot_rows``, to ``MOST_PIVOTS``;
    they are picked from a bounded sample, and every row is indexed.
    """
    spark, dim = ints.sparkSession, len(ints.first()["v"])
    if float(most) ** 2 * dim >= 2**62:
        raise ArithmeticError("inner products of these vectors do not fit in a long")
    pivots_n = int(min(MOST_PIVOTS, max(4, n // pivot_rows)))
    ring_rows = max(ring_rows, n // MOST_CELLS)
    picked = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(4 * pivots_n).collect()
    pivots = spread_out(np.array([r["v"] for r in picked], np.int64), pivots_n)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, size = _units(_matrix(batch.column(1)))
            cos = units @ shared.value.T
            near = cos.argmax(1)
            angle = np.where(size > 0, np.arccos(np.clip(cos[np.arange(len(cos)), near], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(angle), pa.array(size)], names=["vec_id", "v", "pivot", "angle", "size"])

    keyed = written(ints.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, pivot int, angle double, size double"), "keyed")
    steps = lambda m: [i / m for i in range(1, m)]
    edges = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("size").alias("short"), F.max("size").alias("long"), F.percentile_approx("angle", steps(RINGS), 2000).alias("angles"), F.percentile_approx("size", steps(BANDS), 2000).alias("sizes")).collect()
    bounds = []
    for r in edges:
        parts = max(1, r["n"] // ring_rows)
        bands = int(min(BANDS, np.sqrt(parts))) if r["long"] > 1.02 * r["short"] else 1
        rings = int(min(RINGS, max(1, parts // bands)))
        cut = lambda values, m, most: sorted({values[round(most * i / m) - 1] for i in range(1, m)})
        bounds.append((r["pivot"], cut(r["angles"], rings, RINGS), cut(r["sizes"], bands, BANDS)))
    cuts = spark.createDataFrame(bounds, "pivot int, angles array<double>, sizes array<double>")  # a row per pivot
    place = lambda c, x: F.size(F.filter(c, lambda e: e < F.col(x)))
    cell = F.when(F.col("size") == 0, F.lit(-1)).otherwise((F.col("pivot") * BANDS + place("sizes", "size")) * RINGS + place("angles", "angle"))
    celled = keyed.join(F.broadcast(cuts), "pivot").withColumn("cell", cell.cast("int"))
    cells = celled.groupBy("cell").agg(F.min("pivot").alias("pivot"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("size").alias("short"), F.max("size").alias("long"), F.count("*").alias("n")).toPandas()
    cells["salts"] = np.maximum(1, -(-cells["n"] // block_rows))
    placed = celled.join(F.broadcast(_salts(spark, cells)), "cell").select("cell", F.pmod(F.xxhash64("vec_id", "v"), "salts").cast("int").alias("salt"), "vec_id", "v")
    return placed, Index(pivots, cells.sort_values("cell").reset_index(drop=True), float(most) ** 2 * dim < 2**52)


def _salts(spark: SparkSession, cells: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(cells[["cell", "salts"]].astype(int).values.tolist(), "cell int, salts int")  # a row per annulus


def bounds_of(v: np.ndarray, index: Index) -> np.ndarray:
    """Upper bounds of the inner products of each row of ``v`` with the vectors of each annulus."""
    cells = index.cells
    pivot, lo, hi, short, long = (cells[c].to_numpy() for c in ("pivot", "lo", "hi", "short", "long"))
    units, size = _units(v)
    at = np.arccos(np.clip(units @ index.pivots.T, -1, 1))[:, pivot]
    cos = np.cos(np.maximum(0.0, np.maximum(at - hi, lo - at) - 1e-6))
    most = size[:, None] * np.where(cos >= 0, long, short) * cos
    return most + 1e-9 * size[:, None] * long + 1e-6


def _visits(queries: DataFrame, index: Index, k: int, first: bool) -> DataFrame:
    """``(cell, query_id)``: the annuli a query visits, in the first or the second round."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, cell = own.cells["n"].to_numpy(), own.cells["cell"].to_numpy()
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                bound = bounds_of(_matrix(batch.column(1)), own)
                rows, cells = [], []
                for i, least in enumerate(batch.column(2).to_pylist()):
                    order = np.lexsort((cell, -bound[i]))
                    need = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1  # its own row may be among them
                    take = order[:need] if first else order[need:]
                    if not first and least is not None:
                        take = take[bound[i][take] >= least]
                    rows.append(np.full(len(take), i))
                    cells.append(cell[take])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int32)), batch.column(0).take(pa.array(np.concatenate(rows).astype(np.int64)))], names=["cell", "query_id"])

    return written(queries.select("query_id", "v", "least").mapInArrow(run, "cell int, query_id long"), "visits")


def _search(visits: DataFrame, queries: DataFrame, placed: DataFrame, index: Index, k: int, query_rows: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best k of every block for each query that visits it, from its ``least`` on."""
    as_float = index.exact_float

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            rows = rows.sort_values("vec_id")
            ids = rows["vec_id"].to_numpy()
            kind = np.float64 if as_float else np.int64
            x = np.stack(rows["v"].to_numpy()).astype(kind)
            for begin in range(0, len(asked), 128):
                part = asked.iloc[begin : begin + 128]
                scores = np.stack(part["v"].to_numpy()).astype(kind) @ x.T
                for q, least, s in zip(part["query_id"].to_numpy(), part["least"].to_numpy(), scores, strict=True):
                    keep = np.flatnonzero((ids != q) & (s >= least))
                    if len(keep) > k:
                        cut = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                        keep = keep[s[keep] >= cut]
                        keep = keep[np.argsort(-s[keep], kind="stable")][:k]  # by id already
                    found += [(q, ids[i], int(s[i])) for i in keep]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    # A row per annulus, of which there are few: how many parts the queries that visit it make.
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
    shape = written(parts.join(F.broadcast(_salts(placed.sparkSession, index.cells)), "cell"), "parts")
    asked = visits.join(queries, "query_id").join(F.broadcast(shape), "cell").select("cell", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "query_id", "v", F.coalesce("least", F.lit(-(2**63))).alias("least"))
    offered = placed.join(F.broadcast(shape.drop("salts")), "cell").select("cell", "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
    block = ["cell", "salt", "part"]
    return offered.groupBy(block).cogroup(asked.groupBy(block)).applyInPandas(best, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(ints: DataFrame, is_query: Column, k: int, n: int, most: int, query_rows: int, sizes: dict) -> tuple[DataFrame, DataFrame, Index]:
    """Vectors of one length: the result, the visits of both rounds and the index."""
    placed, index = build(ints, n, most, **sizes)
    queries = written(ints.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("least", F.lit(None).cast("long")), "queries")
    visited = _visits(queries, index, k, True)
    first = written(_search(visited, queries, placed, index, k, query_rows), "first")
    kth = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))
    bounded = written(queries.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "v", F.col("kth").alias("least")), "bounded")
    more = _visits(bounded, index, k, False)
    second = _search(more, bounded, placed, index, k, query_rows)
    result = _ranked(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return result, visited.unionByName(more), index


def _by_length(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> list[tuple[DataFrame, int, int]]:
    """The integer vectors of each length with their number and largest component; lengths come to the driver."""
    ints = written(integer_vectors(vectors, id_col=id_col, vector_col=vector_col, factor=factor), "vectors")
    dims = ints.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("array_max(transform(v, c -> abs(c)))")).alias("most")).orderBy("dim").collect()
    return [(ints.where(F.size("v") == r["dim"]), r["n"], r["most"]) for r in dims]


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, query_rows: int = 4096, **sizes) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on the column ``vec_id``."""
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for no, (ints, n, most) in enumerate(_by_length(vectors, id_col, vector_col, factor)):
        one = _rounds(ints, is_query, k, n, most, query_rows, sizes)[0]
        out = one if no == 0 else out.unionByName(one)
    return out


def visited_share(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, query_rows: int = 4096, **sizes) -> float:
    """The share of all (query, vector) pairs that ``search`` looks at."""
    seen = whole = 0
    for ints, n, most in _by_length(vectors, id_col, vector_col, factor):
        _, visits, index = _rounds(ints, is_query, k, n, most, query_rows, sizes)
        held = dict(zip(index.cells["cell"].tolist(), index.cells["n"].tolist(), strict=True))
        seen += sum(held[r["cell"]] * r["count"] for r in visits.groupBy("cell").count().collect())
        whole += n * ints.where(is_query).select("vec_id").distinct().count()
    return seen / whole if whole else 0.0
