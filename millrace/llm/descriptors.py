"""Edited and cropped image copies through local descriptors.

An image is a grey PGM (P5) in a binary column. On each level of a scale
pyramid, corners are local maxima of the Harris measure; each gets the
orientation of its patch's intensity centroid, and a 128-bit descriptor of
brightness tests whose places are turned by that orientation. Corners are
kept per level and per area, so a crop keeps its share, and small images have
enlarged levels, so a copy of half the size meets the whole one. Descriptors
meet in Hamming tables: a table is keyed by some of the bits, and descriptors
that agree on them share a bucket. Every bucket is compared whole, but for
images that are joined already: in one table, then in all, each image is first
compared with the first one of its bucket, which joins large groups of copies.
A bucket whose images are all joined is left out of what follows. Two images
are linked if enough of all their corners agree on one scale, turn and shift.

Images with equal bytes are one group from the start and their corners are
counted once.

Defined cases: null, empty or unreadable images, images below 32 pixels a
side and images without a corner are groups of their own, joined only with
equal bytes (null with nothing); repeated rows stay; ids may repeat, and rows
with an equal id are one image only if their bytes are equal; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.buckets import buckets
from millrace.llm.components import components
from millrace.scratch import written

BITS, RADIUS = 128, 13
#: Levels of the pyramid, half an octave apart. Small images have levels above one; below one, a level is used where it is large enough.
SCALES = tuple(2.0 ** (1 - k / 2) for k in range(16))
ENLARGED = 128
AREAS = 3
#: A corner in three longs: its place (x and y in eighths of a pixel, turn in 4096ths, scale), and its 128 bits.
POINT = "geo long, hi long, lo long"
EIGHTHS, TURNS = 8, 4096
#: Bits of a table's key (fixed, so that what meets does not depend on the size of the table): 18 more than it takes to number 2^26 descriptors.
KEY = 44


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM, or None."""
    try:
        if not data or data[:2] != b"P5":
            return None
        parts = data.split(maxsplit=4)
        width, height, most = int(parts[1]), int(parts[2]), int(parts[3])
        if most != 255 or width < 1 or height < 1:
            return None
        return np.frombuffer(data[-width * height :], np.uint8).reshape(height, width)
    except (ValueError, IndexError):
        return None


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over windows of 2r + 1; the edge repeats."""
    for axis in (0, 1):
        pad = [(r + 1, r) if i == axis else (0, 0) for i in (0, 1)]
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        a = (np.take(c, range(2 * r + 1, c.shape[axis]), axis) - np.take(c, range(c.shape[axis] - 2 * r - 1), axis)) / (2 * r + 1)
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = (max(1, int(round(n * scale))) for n in a.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 2), np.minimum(x.astype(int), a.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx
    low = a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


@dataclass
class Level:
    """The corners of one level of a pyramid: strengths, places, turns and the smoothed pixels around them."""

    scale: float
    strength: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    turn: np.ndarray
    smooth: np.ndarray

    def bits(self, places: np.ndarray) -> np.ndarray:
        """(corners, tests): whether the first place of each test is darker than the second, both turned with the corner."""
        c, s = np.cos(self.turn)[:, None], np.sin(self.turn)[:, None]

        def at(px: np.ndarray, py: np.ndarray) -> np.ndarray:
            u = np.clip(np.rint(self.xs[:, None] + c * px - s * py).astype(int), 0, self.smooth.shape[1] - 1)
            v = np.clip(np.rint(self.ys[:, None] + s * px + c * py).astype(int), 0, self.smooth.shape[0] - 1)
            return self.smooth[v, u]

        return at(places[:, 0], places[:, 1]) < at(places[:, 2], places[:, 3])


def spread(strength: np.ndarray, xs: np.ndarray, ys: np.ndarray, width: int, height: int, per_area: int) -> np.ndarray:
    """The ``per_area`` strongest corners of each of ``AREAS`` by ``AREAS`` areas, so that a crop keeps its share."""
    area = (ys * AREAS // height) * AREAS + xs * AREAS // width
    order = np.lexsort((xs, ys, -strength, area))
    rank = np.arange(len(order)) - np.searchsorted(area[order], area[order])
    return order[rank < per_area]


def levels_of(pixels: np.ndarray, most: int) -> Iterator[Level]:
    """The levels of an image; at most about ``most`` corners on each."""
    if min(pixels.shape) < 32:
        return
    r = 7
    oy, ox = np.mgrid[-r : r + 1, -r : r + 1]
    disc = (oy * oy + ox * ox) <= r * r
    oy, ox = oy[disc], ox[disc]
    for scale in SCALES:
        if scale > 1 and min(pixels.shape) * scale > ENLARGED:
            continue
        a = _box(_resized(_box(pixels.astype(np.float64), int(0.5 / scale)), scale), 1)
        if min(a.shape) <= 2 * RADIUS + 2:
            return
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        harris = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = harris[RADIUS:-RADIUS, RADIUS:-RADIUS]
        peak = inner.copy()
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    np.maximum(peak, harris[RADIUS + dy : harris.shape[0] - RADIUS + dy, RADIUS + dx : harris.shape[1] - RADIUS + dx], out=peak)
        ys, xs = np.nonzero((inner >= peak) & (inner > 1.0))
        if not len(ys):
            continue
        kept = spread(inner[ys, xs], xs, ys, inner.shape[1], inner.shape[0], max(1, round(most / AREAS**2)))
        strength, ys, xs = inner[ys, xs][kept], ys[kept] + RADIUS, xs[kept] + RADIUS
        # The centroid of a disc around the corner gives its turn.
        patch = a[ys[:, None] + oy, xs[:, None] + ox]
        yield Level(scale, strength, xs, ys, np.arctan2((patch * oy).sum(1), (patch * ox).sum(1)), _box(a, 2))


def noise_picture(seed: int, side: int = 96, cells: int = 24) -> np.ndarray:
    """Soft blocks of random brightness."""
    grey = np.clip(np.random.default_rng(seed).normal(128, 52, (cells, cells)), 0, 255)
    at = np.arange(side) * cells // side
    return _box(grey[at][:, at], 1).round().astype(np.uint8)


@lru_cache(maxsize=1)
def tests(bits: int = BITS, *, tried: int = 1024, pictures: int = 60, reach: float = RADIUS - 1.0, seed: int = 11) -> np.ndarray:
    """Places of the brightness tests: (bits, 4).

    They are learned from random pictures: of ``tried`` random pairs of places
    those whose outcomes are nearest to even, as long as they hang together
    little. The order is then shuffled, so each table reads a fair share.
    """
    rng = np.random.default_rng(seed)
    pairs = rng.uniform(-reach, reach, (8 * tried, 4))
    far = (pairs[:, 0] - pairs[:, 2]) ** 2 + (pairs[:, 1] - pairs[:, 3]) ** 2
    pairs = pairs[(np.hypot(pairs[:, 0], pairs[:, 1]) <= reach) & (np.hypot(pairs[:, 2], pairs[:, 3]) <= reach) & (far >= 25)][:tried]
    seen = np.concatenate([level.bits(pairs) for i in range(pictures) for level in levels_of(noise_picture(i, cells=(12, 24, 32)[i % 3]), 36)]).astype(np.float64)
    z = (seen - seen.mean(0)) / np.maximum(1e-6, seen.std(0))
    together = np.abs(z.T @ z) / len(z)
    order = np.argsort(np.abs(seen.mean(0) - 0.5), kind="stable")
    limit, picked = 0.2, []
    while len(picked) < bits:
        picked, limit = [], limit + 0.02
        for i in order:
            if len(picked) < bits and (not picked or together[i, picked].max() < limit):
                picked.append(int(i))
    return pairs[rng.permutation(picked)]


def corners_of(pixels: np.ndarray, most: int, places: np.ndarray | None = None) -> list[tuple[float, float, float, float, int, int]]:
    """(x, y, scale, turn, hi, lo) of the corners of all levels; x and y in pixels of the image."""
    places, found = tests() if places is None else places, []
    for level in levels_of(pixels, most):
        words = np.packbits(level.bits(places), axis=1).view(">i8").astype(np.int64)
        xs, ys = (level.xs + 0.5) / level.scale - 0.5, (level.ys + 0.5) / level.scale - 0.5
        found += [(float(x), float(y), level.scale, float(t), int(w[0]), int(w[1])) for x, y, t, w in zip(xs, ys, level.turn, words, strict=True)]
    return found


def packed(x: float, y: float, scale: float, turn: float) -> int:
    part = int(round(turn / (2 * np.pi) * TURNS)) % TURNS
    return (int(round(max(0.0, x) * EIGHTHS)) & 0xFFFFF) << 36 | (int(round(max(0.0, y) * EIGHTHS)) & 0xFFFFF) << 16 | part << 4 | SCALES.index(scale)


def corners(images: DataFrame, most: int = 36) -> DataFrame:
    """``(image_id, sum, points)``: the digest of each image's bytes and its corners, in one pass over the images."""
    import hashlib

    kind, places = pa.list_(pa.struct([("geo", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])), tests()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, points = [], []
            for data in batch.column(1):
                data = data.as_py()
                pixels = read_pgm(data)
                sums.append(None if data is None else hashlib.sha256(data).hexdigest())
                points.append([] if pixels is None else [{"geo": packed(*p[:4]), "hi": p[4], "lo": p[5]} for p in corners_of(pixels, most, places)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), pa.array(points, kind)], names=["image_id", "sum", "points"])

    return images.mapInArrow(run, f"image_id long, sum string, points array<struct<{POINT.replace(' long', ':long')}>>")


def dealt(points: DataFrame, *, tables: int = 6, key_bits: int = KEY, only: int | None = None) -> DataFrame:
    """``(bucket, image, hi, lo)``: each descriptor of ``points(image, points)`` once an image in its bucket of every table, or of the first ``only`` ones; a ``root`` of the image goes along.

    A table reads ``key_bits`` of the descriptor; the tables begin at even steps.
    """
    step = (BITS - key_bits) // (tables - 1)

    def key(t: int):
        begin, mask = t * step, F.lit((1 << key_bits) - 1)
        if begin + key_bits <= 64:
            return F.shiftrightunsigned("hi", 64 - begin - key_bits).bitwiseAND(mask)
        if begin >= 64:
            return F.shiftrightunsigned("lo", 128 - begin - key_bits).bitwiseAND(mask)
        left = begin + key_bits - 64
        return F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << (64 - begin)) - 1)), left).bitwiseOR(F.shiftrightunsigned("lo", 64 - left))

    place = lambda t: F.lit(t << 56).bitwiseOR(key(t))
    words = F.array_distinct(F.transform("points", lambda p: F.struct(p["hi"].alias("hi"), p["lo"].alias("lo"))))
    root = [c for c in points.columns if c == "root"]
    return points.select("image", *root, F.inline(words)).select(F.explode(F.array(*[place(t) for t in range(only or tables)])).alias("bucket"), "image", "hi", "lo", *root)


def of_several(rows: DataFrame) -> DataFrame:
    """The ``rows(bucket, image, hi, lo, root)`` of buckets in which two images are not joined yet."""
    of = Window.partitionBy("bucket")
    return rows.select("*", F.min("root").over(of).alias("p"), F.max("root").over(of).alias("q")).where("p <> q").drop("p", "q")


def _near(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count((hi[i] ^ hi[j]).view(np.uint64)) + np.bitwise_count((lo[i] ^ lo[j]).view(np.uint64))


MET = "a long, b long, n long, bucket long, hi long, lo long"


def _met(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of images (2, n) with how often each is among them."""
    names = [x.split()[0] for x in MET.split(", ")]
    if pairs and (both := np.concatenate(pairs, 1)).shape[1]:
        found, n = np.unique(np.stack([both.max(0), both.min(0)]), axis=1, return_counts=True)
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(n.astype(np.int64)), none, none, none], names=names)


def _left(part: np.ndarray, large: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, image, hi, lo) that are to be compared later; n is 1 for those of ``large`` buckets."""
    names = [x.split()[0] for x in MET.split(", ")]
    if part.shape[1]:
        none = pa.nulls(part.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part[1]), none, pa.array(np.ones(part.shape[1], np.int64)) if large else none, pa.array(part[0]), pa.array(part[2]), pa.array(part[3])], names=names)


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "image")


def with_first(rows: DataFrame, most_bits: int, small: int, *, gathered: bool = False) -> DataFrame:
    """``(a, b, n)``: how often a descriptor of an image is near that of its bucket's first image; and, with null b, each row ``(bucket, a, hi, lo)`` of buckets with more than two, n being 1 if it has more than ``small``.

    A crowd of copies is joined at a cost in proportion to it. Rows whose
    buckets are ``gathered`` in tasks already are not shuffled again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, head in buckets(batches, small):
            bucket, image, hi, lo = part
            if head is None:
                begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                sizes = np.diff(np.r_[begins, len(bucket)])
                lead = np.repeat(begins, sizes)
                at = np.flatnonzero((image != image[lead]) & (_near(hi, lo, np.arange(len(bucket)), lead) <= most_bits))
                yield from _met([np.stack([image[at], image[lead[at]]])])
                yield from _left(part[:, np.repeat(sizes > 2, sizes)])
            else:
                far = np.bitwise_count((hi ^ head[2]).view(np.uint64)) + np.bitwise_count((lo ^ head[3]).view(np.uint64))
                at = np.flatnonzero((image != head[1]) & (far <= most_bits))
                yield from _met([np.stack([image[at], np.full(len(at), head[1])])])
                yield from _left(part, large=True)

    own = rows.select("bucket", "image", "hi", "lo")
    return (own.sortWithinPartitions("bucket", "image") if gathered else _in_buckets(own)).mapInArrow(run, MET)


def with_all(rows: DataFrame, most_bits: int, small: int) -> DataFrame:
    """``(a, b, n)``: how often descriptors of two images of different ``root`` are near in buckets of at most ``small`` of the ``rows``; and, with null b, each row of larger buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, head in buckets(batches, small):
            if head is not None:
                yield from _left(part[:4], large=True)
                continue
            bucket, image, hi, lo, root = part
            begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[begins, len(bucket)])
            ends, at, pairs, lag = np.repeat(begins + sizes, sizes), np.arange(len(bucket)), [], 1
            while len(at := at[at + lag < ends[at]]):
                near = at[(root[at] != root[at + lag]) & (_near(hi, lo, at, at + lag) <= most_bits)]
                pairs.append(np.stack([image[near], image[near + lag]]))
                lag += 1
            yield from _met(pairs)

    return _in_buckets(rows.select("bucket", "image", "hi", "lo", "root")).mapInArrow(run, MET)


def often(pairs: DataFrame, meet: int) -> DataFrame:
    """The ``pairs(a, b, n)`` that met ``meet`` times in all."""
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= meet).select("a", "b")


def still_apart(large: DataFrame, *, most_bits: int, block: int = 512) -> DataFrame:
    """``(a, b, n)`` of the images of different root in ``large(bucket, image, hi, lo, root)``, each bucket compared whole.

    A bucket of more than about ``block`` rows is cut into parts by hash, and
    each two parts meet under a key of their own.
    """
    sizes = large.groupBy("bucket").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.ceil(F.count("*") / block).cast("int").alias("parts")).where("p <> q").select("bucket", "parts")
    cut = large.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("image"), "parts").cast("int"))
    side = lambda own, other: cut.select("bucket", F.col("part").alias(own), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other), "image", "hi", "lo", "root")
    far = F.bit_count(F.col("x.hi").bitwiseXOR(F.col("y.hi"))) + F.bit_count(F.col("x.lo").bitwiseXOR(F.col("y.lo")))
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    cond = same & (F.col("x.image") > F.col("y.image")) & (F.col("x.root") != F.col("y.root")) & (far <= most_bits)
    return side("i", "j").alias("x").join(side("j", "i").alias("y"), cond).groupBy(F.col("x.image").alias("a"), F.col("y.image").alias("b")).agg(F.count("*").alias("n"))


def agree(p: np.ndarray, q: np.ndarray, least: int, *, slack: float = 2.5, turn: float = 20.0, octaves: float = 0.75) -> bool:
    """Whether ``least`` of the matched corners agree on one turn, scale and shift.

    ``p`` and ``q`` have a row (x, y, scale, turn) a match. Each two matches
    give a similarity; the others agree if it takes them to their place and
    if their own turn and scale differ as it says. A corner counts once on
    either side.
    """
    if len(p) < least:
        return False
    a, b = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    spin, size = q[:, 3] - p[:, 3], np.log2(p[:, 2] / q[:, 2])
    one, two = np.triu_indices(len(a), 1)
    apart = (np.abs(a[one] - a[two]) >= 8) & (np.abs(b[one] - b[two]) >= 8)
    one, two = one[apart], two[apart]
    of, on = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    for begin in range(0, len(one), 2048):
        i, j = one[begin : begin + 2048], two[begin : begin + 2048]
        by = (b[j] - b[i]) / (a[j] - a[i])
        off = np.abs(by[:, None] * (a[None, :] - a[i][:, None]) + b[i][:, None] - b[None, :])
        angle = np.abs((np.angle(by)[:, None] - spin[None, :] + np.pi) % (2 * np.pi) - np.pi)
        fits = off <= slack * (1 / q[None, :, 2] + np.abs(by)[:, None] / p[None, :, 2])
        fits &= (angle <= np.radians(turn)) & (np.abs(np.log2(np.abs(by))[:, None] - size[None, :]) <= octaves)
        for row in fits[fits.sum(1) >= least]:
            if len(set(of[row])) >= least and len(set(on[row])) >= least:
                return True
    return False


def _places(geo: np.ndarray) -> np.ndarray:
    return np.stack([(geo >> 36 & 0xFFFFF) / EIGHTHS, (geo >> 16 & 0xFFFFF) / EIGHTHS, np.array(SCALES)[geo & 15], (geo >> 4 & 0xFFF) * 2 * np.pi / TURNS], 1)


def consensus(pairs: DataFrame, heads: DataFrame, *, most_bits: int, least: int = 6) -> DataFrame:
    """The ``pairs(a, b)`` of which ``least`` corners agree; all corners of ``heads(image, points)`` are compared, not only those that met."""
    side = lambda n: heads.select(F.col("image").alias(n), F.col("points").alias(f"{n}_points"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_points", "b_points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            lists = [batch.column(2), batch.column(3)]
            ends = [c.offsets.to_numpy() for c in lists]
            words = [{n: c.values.field(n).to_numpy() for n in ("geo", "hi", "lo")} for c in lists]
            for r in range(batch.num_rows):
                a, b = ({n: w[n][e[r] : e[r + 1]] for n in w} for w, e in zip(words, ends, strict=True))
                far = np.bitwise_count((a["hi"][:, None] ^ b["hi"][None, :]).view(np.uint64)) + np.bitwise_count((a["lo"][:, None] ^ b["lo"][None, :]).view(np.uint64))
                i, j = np.nonzero(far <= most_bits)
                if len(i) >= least and agree(_places(a["geo"][i]), _places(b["geo"][j]), least):
                    keep.append(r)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def settled(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` once ``links(a, b)`` hold too; what is joined already takes no part, so a crowd of copies is not gone through again."""
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    ends = written(ends.where("a <> b").distinct(), "ends")
    if ends.isEmpty():
        return roots
    more = written(components(ends), "roots")
    onto = more.select(F.col("node").alias("root"), F.col("root").alias("onto"))
    known = roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    return written(known.unionByName(more.join(roots, "node", "left_anti")), "roots")


def linked(heads: DataFrame, *, most_bits: int = 16, least: int = 6, small: int = 64) -> DataFrame:
    """``(node, root)`` of the images of ``heads(image, points)`` that have a copy.

    Pairs of images are compared corner by corner if near descriptors of
    theirs meet in buckets at least a third of ``least`` times. First each image
    meets the first one of each of its buckets of one table, and of these is
    compared with the one it meets most often, which joins a large group of
    copies by no more links than it has images; then with those of them that
    are still apart. Then the same is done in all tables, in buckets that hold
    images still apart, so a group that is joined by then leaves no rows; then
    all that are still apart meet in every bucket of more than two rows.
    """
    meet = max(1, least // 3)
    verified = lambda tried: written(consensus(tried, heads, most_bits=most_bits, least=least), "links")
    totals = lambda once: written(once.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= meet), "pairs")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        root_of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
        return pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "n")

    def with_best(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        best = written(pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "best")
        roots = settled(roots, verified(best))
        return settled(roots, verified(written(apart(pairs, roots).select("a", "b").join(best, ["a", "b"], "left_anti"), "pairs")))

    tried = totals(with_first(dealt(heads, only=1), most_bits, small).where("b is not null"))
    roots = with_best(heads.sparkSession.createDataFrame([], "node long, root long"), tried)
    own = heads.join(roots, F.col("image") == F.col("node"), "left").select("image", "points", F.coalesce("root", "image").alias("root"))
    met = written(with_first(of_several(dealt(own)), most_bits, small, gathered=True), "met")
    once = met.where("b is not null").select("a", "b", "n")
    pairs = totals(once)
    roots = with_best(roots, written(apart(pairs.join(tried, ["a", "b"], "left_anti"), roots), "pairs"))
    rows = met.where("b is null").select("bucket", F.col("a").alias("image"), "hi", "lo", F.col("n").isNotNull().alias("large"))
    named = written(rows.join(roots, F.col("image") == F.col("node"), "left").select("bucket", "image", "hi", "lo", "large", F.coalesce("root", "image").alias("root")), "named")
    again = with_all(named.where("not large"), most_bits, small).where("b is not null").select("a", "b", "n")
    more = again.unionByName(still_apart(named.where("large"), most_bits=most_bits))
    # A bucket whose first image is one of a pair counts twice here; all that is decided by it is which pairs are looked at corner by corner.
    # Those that met the first ones often enough have been looked at, or were joined.
    rest = often(more.unionByName(once), meet).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return settled(roots, verified(written(rest, "pairs")))


def copies(images: DataFrame, *, id_col: str = "image_id", image_col: str = "image", most: int = 36, least: int = 6) -> DataFrame:
    """``(image_id, group_id, corners)`` of every row; group_id is the smallest id of its copies."""
    own = images.select(F.col(id_col).cast("long").alias("image_id"), F.col(image_col).cast("binary").alias("data"))
    marked = written(corners(own, most), "corners")
    same = marked.where("sum is not null and image_id is not null").groupBy("sum").agg(F.min("image_id").alias("image"), F.max(F.size("points")).alias("corners"))
    first = same.select(F.col("sum").alias("of"), "image")
    # An image stands for all with its bytes; where ids repeat with other bytes, the digest tells them apart.
    heads = marked.join(first, (F.col("sum") == F.col("of")) & (F.col("image_id") == F.col("image"))).select(F.xxhash64("image", "sum").alias("image"), "points").dropDuplicates(["image"])
    roots = linked(written(heads, "heads"), least=least)
    named = same.withColumn("node_id", F.xxhash64("image", "sum"))
    joined = named.join(roots, F.col("node_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "node_id"))
    least_id = joined.groupBy("root").agg(F.min("image").alias("group_id"))
    known = joined.join(least_id, "root").select(F.col("sum").alias("of"), "group_id", "corners")
    out = marked.select("image_id", "sum").join(known, F.col("sum") == F.col("of"), "left")
    return out.select("image_id", F.coalesce("group_id", "image_id").alias("group_id"), F.coalesce("corners", F.lit(0)).cast("long").alias("corners"))


# ---- images from vectors: what stands in for a media column


@lru_cache(maxsize=8)
def _projection(n: int, cells: int) -> np.ndarray:
    return np.random.default_rng(n).normal(size=(n, cells))


def picture(vector: list[float], side: int = 96, cells: int = 24) -> np.ndarray:
    """A picture drawn from a vector: its random projection (a fixed one per length) as a grid of soft blocks."""
    v = np.asarray(vector, np.float64)
    grid = (v @ _projection(len(v), cells * cells)).reshape(cells, cells)
    spread = grid.std() or 1.0
    grey = np.clip(128 + 52 * (grid - grid.mean()) / spread, 0, 255)
    at = np.arange(side) * cells // side
    return _box(grey[at][:, at], 1).round().astype(np.uint8)


EDITS = ("trimmed", "halved", "turned", "cropped")


def edited(pixels: np.ndarray, seed: int, kind: str = "trimmed") -> np.ndarray:
    """A trimmed, halved (in size), quarter-turned or cropped (to half the area) picture with other brightness, contrast and some noise."""
    rng = np.random.default_rng(seed)
    height, width = pixels.shape
    if kind == "trimmed":
        top, left = rng.integers(0, 14, 2)
        part = pixels[top : height - int(rng.integers(0, 14)), left : width - int(rng.integers(0, 14))]
    elif kind == "halved":
        part = _resized(_box(pixels.astype(np.float64), 1), 0.5)
    elif kind == "turned":
        part = np.rot90(pixels, int(rng.integers(1, 4)))
    else:
        h, w = int(height * 0.7072), int(width * 0.7072)
        top, left = int(rng.integers(0, height - h + 1)), int(rng.integers(0, width - w + 1))
        part = pixels[top : top + h, left : left + w]
    return np.clip(part * rng.uniform(0.85, 1.1) + rng.uniform(-10, 10) + rng.normal(0, 1.5, part.shape), 0, 255).round().astype(np.uint8)


def pictures(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 10) -> DataFrame:
    """``(image_id, image, copy_of)``: an image of every vector under twice its id, and for ids divisible by ``every`` a copy under the next one, the four kinds of edit in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ids, images, of = [], [], []
                part = batch.slice(begin, 256)
                for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if i is None or not v or any(x is None or x != x or abs(x) == float("inf") for x in v):
                        continue
                    pixels = picture(v)
                    ids.append(2 * i)
                    images.append(write_pgm(pixels))
                    of.append(None)
                    if i % every == 0:
                        ids.append(2 * i + 1)
                        images.append(write_pgm(edited(pixels, i, EDITS[i // every % len(EDITS)])))
                        of.append(2 * i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary()), pa.array(of, pa.int64())], names=["image_id", "image", "copy_of"])

    own = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "image_id long, image binary, copy_of long")
