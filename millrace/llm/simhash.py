"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into segments and mapped to the bit count of each
segment. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so fingerprints that differ in at most two bits
lie within Manhattan distance two. On the integer grid two such vectors share
a grid point within distance one of both: every fingerprint is dealt to the
grid points within distance one of its vector (1 + 2 per segment). That is a
range join: those that meet at a point are checked by Manhattan distance, the
lower bound, and then by the differing bits themselves. Points with a single
fingerprint are done; points with many are split further, so that a crowd of
near copies costs in proportion to its size (see ``links``).

Defined cases: null or blank text has fingerprint zero, linked like any
other; equal rows share a fingerprint and so a component; ids may repeat; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.buckets import buckets
from millrace.llm.columns import free_name
from millrace.llm.components import components
from millrace.scratch import written

BITS = 64


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of one UTF-8 text; a bit is set if it is in over half the shingle hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=42), parts), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[begin : begin + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint_of(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, fp long")


def grid_points(fp: Column, segments: int) -> Column:
    """Array of struct(point, segment, step): the vector's own grid point (step 0) and those one step up or down in a segment.

    A point is a long: the hash of the segment counts when they need over 63 bits, else the counts packed side by side.
    """
    width = BITS // segments
    digit = width.bit_length()
    packed = digit * segments < BITS
    full = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(full))).cast("long") for i in range(segments)]

    def point(at: int, step: int) -> Column:
        own = [c + step if i == at else c for i, c in enumerate(counts)]
        if not packed:
            return F.xxhash64(*own)
        total = own[0]
        for i, c in enumerate(own[1:], 1):
            total = total + F.shiftleft(c, i * digit)
        return total

    here = [F.struct(point(-1, 0).alias("point"), F.lit(-1).alias("segment"), F.lit(0).alias("step"))]
    near = [
        F.when(counts[i] + s <= width, F.when(counts[i] + s >= 0, F.struct(point(i, s).alias("point"), F.lit(i).alias("segment"), F.lit(s).alias("step"))))
        for i in range(segments)
        for s in (-1, 1)
    ]
    return F.filter(F.array(*here, *near), lambda x: x.isNotNull())


def manhattan(a: Column, b: Column, segments: int) -> Column:
    """The Manhattan distance of two fingerprints' segment counts."""
    width = BITS // segments
    count = lambda x, i: F.bit_count(F.shiftrightunsigned(x, i * width).bitwiseAND(F.lit((1 << width) - 1)))
    return sum((F.abs(count(a, i) - count(b, i)) for i in range(1, segments)), F.abs(count(a, 0) - count(b, 0)))


def one_bit_values(segments: int) -> Column:
    """The 64-bit values on a grid point that differ from ``fp`` in at most one bit; of the columns fp, segment and step."""
    width = BITS // segments
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("segment") * width + k).cast("int"))
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.struct(bit(k).alias("bit"), (F.col("fp").bitwiseAND(bit(k)) != 0).alias("set"))),
        lambda x: x["set"] == (F.col("step") < 0),
    )
    return F.when(F.col("step") == 0, F.array(F.col("fp"))).otherwise(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x["bit"])))


def _segment_distance(a: np.ndarray, b: np.ndarray, segments: int) -> np.ndarray:
    """``manhattan`` of arrays of fingerprints."""
    width, total = BITS // segments, np.zeros(len(a), np.int64)
    mask = np.uint64((1 << width) - 1)
    for i in range(segments):
        counts = [np.bitwise_count((x.view(np.uint64) >> np.uint64(i * width)) & mask).astype(np.int64) for x in (a, b)]
        total += np.abs(counts[0] - counts[1])
    return total


def links(fps: DataFrame, segments: int = 16, small: int = 64) -> DataFrame:
    """``(a, b)`` with a > b: edges that join exactly the distinct fingerprints ``fps(fp)`` within two bits.

    Fingerprints are dealt to their grid points and sorted by them in one
    shuffle. Those of a point with up to ``small`` of them meet each other
    there. A point with more is split by the values on it that differ from
    its fingerprints in at most one bit: two fingerprints within two bits
    share such a value, and its smallest fingerprint stands for it, so the
    components are those of the full link graph. Every pair that meets is
    checked by Manhattan distance, then bit by bit.
    """
    names = ["a", "b", "segment", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, head in buckets(batches, small):
            point, fp = part[0], part[1]
            if head is not None:
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(part[2]), pa.array(part[3])], names=names)
                continue
            begins = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
            sizes = np.diff(np.r_[begins, len(point)])
            ends, at, lag, found = np.repeat(begins + sizes, sizes), np.arange(len(point)), 1, []
            while len(at := at[at + lag < ends[at]]):
                a, b = fp[at], fp[at + lag]
                near = _segment_distance(a, b, segments) <= 2
                a, b = a[near], b[near]
                same = np.bitwise_count((a ^ b).view(np.uint64)) <= 2
                found.append(np.stack([np.maximum(a, b)[same], np.minimum(a, b)[same]]))
                lag += 1
            pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
            if pairs.shape[1]:
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none], names=names)

    dealt = fps.select("fp", F.inline(grid_points(F.col("fp"), segments))).select("point", "fp", F.col("segment").cast("long").alias("segment"), F.col("step").cast("long").alias("step"))
    met = written(dealt.repartition("point").sortWithinPartitions("point").mapInArrow(run, "a long, b long, segment long, step long"), "met")
    crowd = met.where("b is null").select(F.col("a").alias("fp"), "segment", "step")
    listed = written(crowd.select("fp", F.explode(one_bit_values(segments)).alias("value")), "values")
    least = listed.groupBy("value").agg(F.min("fp").alias("b"))
    stars = listed.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    checked = stars.where((manhattan(F.col("a"), F.col("b"), segments) <= 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    return met.where("b is not null").select("a", "b").unionByName(checked).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segments: int = 16) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; component_id is the smallest id that links reach."""
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    # A fingerprint becomes a few dozen rows: the small table is dealt out first, about 20,000 to a task.
    spread = firsts.select("fp").repartition(max(1, -(-firsts.count() // 20_000)))
    edges = written(links(spread, segments), "links")
    roots = components(edges)
    grouped = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    several = grouped.where("linked or n > 1")
    least = several.groupBy("root").agg(F.min("first").alias("component_id"))
    known = several.join(least, "root").select(F.col("fp").alias("known_fp"), "component_id")
    out = marked.join(known, marked["fp"] == known["known_fp"], "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, grouped: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in a group and not its smallest; a row with a null id stays.

    Where a kept id repeats within its group, one of its rows stays.
    """
    key = free_name("key", docs.columns)
    gone = grouped.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    twice = grouped.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    kept = docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
    if twice.isEmpty():  # as a rule: the texts are then joined once
        return kept
    once = kept.join(twice, F.col(id_col) == F.col(key), "left_anti")
    again = kept.join(twice, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col])
    return once.unionByName(again)
