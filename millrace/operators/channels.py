"""Hotelling's T2 over several channels, with components and limit taken from the data."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

ALPHA = 0.01
DRAWS = 50  # random matrices of the parallel analysis
MERGES = 64  # rows of moments that reach the driver, at most


class PrincipalModel(NamedTuple):
    mean: np.ndarray
    sd: np.ndarray
    values: np.ndarray  # of the components kept
    loadings: np.ndarray
    limit: float
    rows: int


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its power series from the side where that is shorter; a tail under e to the -80 is nought."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    if front < -80:
        return float(x > a / (a + b))
    length = lambda a, x: max(0.0, ((a + b) * x - a) / (1 - x)) + 40 / -math.log(x)
    if x > 0.5 or length(a, x) > max(0.0, (a + b) * (1 - x) - b) / x + 40 / -math.log1p(-x):
        a, b, x, other = b, a, 1 - x, True
    else:
        other = False
    term, total, n = 1.0, 1.0, 0
    while term > total * 1e-16:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    share = total * math.exp(front) / a
    return 1 - share if other else share


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value under which an F variable with d1 and d2 degrees of freedom lies with probability p."""
    lo, hi = -745.0, 36.0  # log odds of the beta variable, which are monotone in it
    while hi - lo > 1e-13 * max(1.0, abs(lo)):
        mid = (lo + hi) / 2
        if beta_share(d1 / 2, d2 / 2, 1 / (1 + math.exp(-mid))) < p:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2) * d2 / d1


def _merged(n: np.ndarray, mean: np.ndarray, cross: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several sets of rows together: counts (k), means (k, m) and centred cross products (k, m, m)."""
    total = n.sum()
    both = (n[:, None] * mean).sum(0) / max(total, 1)
    off = mean - both
    return int(total), both, cross.sum(0) + np.einsum("k,ki,kj->ij", n, off, off)


def moments(wide: DataFrame, channels: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred cross products of the rows that have all channels.

    Each batch makes a matrix, a task merges its batches, groups of tasks are
    merged in Spark, and at most ``MERGES`` matrices reach the driver.
    """
    m = len(channels)
    kind = "part int, n long, mean array<double>, crossed array<double>"

    def rows(n: int, mean: np.ndarray, cross: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([cross.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "n", "mean", "crossed"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = (0, np.zeros(m), np.zeros((m, m)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, m))
            mean = x.mean(0) if len(x) else np.zeros(m)
            centred = x - mean
            own = _merged(np.array([own[0], len(x)]), np.stack([own[1], mean]), np.stack([own[2], centred.T @ centred]))
        if own[0]:
            yield rows(*own, TaskContext.get().partitionId() % MERGES)

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, mean, cross = own.get(r["part"], (0, np.zeros(m), np.zeros((m, m))))
                own[r["part"]] = _merged(np.array([n, r["n"]]), np.stack([mean, r["mean"]]), np.stack([cross, np.reshape(r["crossed"], (m, m))]))
        for part, found in own.items():
            yield rows(*found, part)

    whole = wide.select(*[F.col(c).cast("double").alias(c) for c in channels]).na.drop()
    found = whole.mapInArrow(of_task, kind).repartition("part").mapInArrow(of_group, kind).orderBy("part").collect()
    if not found:
        return 0, np.zeros(m), np.zeros((m, m))
    return _merged(np.array([r.n for r in found]), np.array([r.mean for r in found]), np.array([np.reshape(r.crossed, (m, m)) for r in found]))


def random_values(n: int, m: int, draws: int = DRAWS, seed: int = 0) -> np.ndarray:
    """Mean eigenvalues, from the largest, of the covariance of ``n`` rows of ``m`` independent normal channels.

    A covariance is drawn from its own law by its triangular factor, so the
    work does not grow with the rows.
    """
    rng = np.random.default_rng(seed)
    total = np.zeros(m)
    for _ in range(draws):
        factor = np.tril(rng.standard_normal((m, m)), -1)
        factor[np.diag_indices(m)] = np.sqrt(rng.chisquare(np.maximum(n - 1 - np.arange(m), 1e-9)))
        total += np.linalg.eigvalsh(factor @ factor.T / (n - 1))[::-1]
    return total / draws


def principal_model(wide: DataFrame, channels: list[str], alpha: float = ALPHA, draws: int = DRAWS, seed: int = 0) -> PrincipalModel:
    """Standardised principal components of ``wide``, as many as stand out from random data, and the T2 limit at ``alpha``.

    Components are kept up to the first whose eigenvalue is not above that of
    random data of the same size, at least one. A constant channel counts as
    zero. Too few rows (not more than channels, plus one) are an error.
    """
    n, mean, cross = moments(wide, channels)
    m = len(channels)
    if n < m + 2:
        raise ValueError(f"{n} whole rows are too few for {m} channels")
    sd = np.sqrt(np.diag(cross) / (n - 1))
    sd[sd == 0] = 1.0
    values, vectors = np.linalg.eigh(cross / (n - 1) / np.outer(sd, sd))
    values, vectors = values[::-1], vectors[:, ::-1]
    plain = np.flatnonzero(values <= random_values(n, m, draws, seed))
    kept = max(1, int(plain[0]) if len(plain) else m)
    limit = kept * (n - 1) * (n + 1) / (n * (n - kept)) * f_quantile(1 - alpha, kept, n - kept)
    return PrincipalModel(mean, sd, values[:kept], vectors[:, :kept], limit, n)


def hotelling(wide: DataFrame, channels: list[str], model: PrincipalModel) -> DataFrame:
    """``wide`` with t2 and flag (above the limit), as column arithmetic; a row without all channels has no t2 and no flag."""
    z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(channels, model.mean, model.sd, strict=True)]
    total = F.lit(0.0)
    for value, loading in zip(model.values, model.loadings.T, strict=True):
        score = F.lit(0.0)
        for part, weight in zip(z, loading, strict=True):
            score = score + part * float(weight)
        total = total + score * score / float(value)
    return wide.withColumn("t2", total).withColumn("flag", F.coalesce(F.col("t2") > model.limit, F.lit(False)))


def detection(flags: DataFrame, faults: DataFrame) -> DataFrame:
    """``(run, detected, delay_rows, rate_after, false_rate)``: T2 flags of ``flags(run, row_no, flag)`` against ``faults(run, fault_row)``; a run without a fault has only a false rate."""
    own = flags.join(written(faults.select(F.col("run").alias("_run"), "fault_row"), "faults"), F.col("run") == F.col("_run"), "left")
    after = F.coalesce(F.col("row_no") >= F.col("fault_row"), F.lit(False))
    first = F.min(F.when(after & F.col("flag"), F.col("row_no") - F.col("fault_row")))
    return own.groupBy("run").agg(first.isNotNull().alias("detected"), first.alias("delay_rows"), F.avg(F.when(after, F.col("flag").cast("int"))).alias("rate_after"), F.avg(F.when(~after, F.col("flag").cast("int"))).alias("false_rate"))
