import numpy as np

from millrace.llm import descriptors as D


def noise_picture(seed, side=96):
    return D.picture(np.random.default_rng(seed).normal(size=64).tolist(), side)


def test_edited_copies_are_found_and_others_left(spark):
    rows = [(i, D.write_pgm(noise_picture(i)), None) for i in range(0, 60)]
    rows += [(1000 + i, D.write_pgm(D.edited(noise_picture(i), i)), i) for i in range(0, 60, 3)]
    rows += [(2000, rows[7][1], 7), (2001, rows[7][1], 7)]  # equal bytes
    table = spark.createDataFrame(rows, "image_id long, image binary, copy_of long")
    got = {r.image_id: r.group_id for r in D.copies(table).collect()}
    made = [(i, of) for i, _, of in rows if of is not None]
    assert sum(got[i] == got[of] for i, of in made) / len(made) >= 0.9
    assert got[2000] == got[2001] == got[7]
    plain = [i for i in range(60) if i % 3 and i != 7]
    assert sum(got[i] == i for i in plain) / len(plain) >= 0.95


def test_every_kind_of_edit_is_found(spark):
    base = {i: noise_picture(i) for i in range(80)}
    rows = [(i, D.write_pgm(p)) for i, p in base.items()] + [(1000 + i, D.write_pgm(D.edited(p, i, D.EDITS[i % 4]))) for i, p in base.items()]
    got = {r.image_id: r.group_id for r in D.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    for k, kind in enumerate(D.EDITS):
        own = [i for i in base if i % 4 == k]
        assert sum(got[1000 + i] == i for i in own) / len(own) >= 0.9, kind
    assert all(got[i] == i for i in base)


def plain_groups(images, least=6, most_bits=16):
    """Every corner of every image against every corner of every other one."""
    import itertools

    own = {i: D.corners_of(p, 36) for i, p in images.items()}
    place = lambda c: np.array([x[:4] for x in c]).reshape(-1, 4)
    roots = {i: i for i in images}
    find = lambda i: i if roots[i] == i else find(roots[i])
    for a, b in itertools.combinations(images, 2):
        near = [(m, n) for m, x in enumerate(own[a]) for n, y in enumerate(own[b]) if (((x[4] ^ y[4]) & (2**64 - 1)).bit_count() + ((x[5] ^ y[5]) & (2**64 - 1)).bit_count()) <= most_bits]
        if len(near) >= least and D.agree(place(own[a])[[m for m, _ in near]], place(own[b])[[n for _, n in near]], least):
            roots[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in images}


def test_groups_equal_those_of_all_pairs(spark):
    """60 images, two thirds of them edited copies: the tables lose no link that comparing all pairs has."""
    images = {i: noise_picture(i) for i in range(20)}
    images |= {100 + i: D.edited(images[i % 10], i, D.EDITS[i % 4]) for i in range(40)}
    table = spark.createDataFrame([(i, D.write_pgm(p)) for i, p in images.items()], "image_id long, image binary")
    want = plain_groups(images)
    assert {r.image_id: r.group_id for r in D.copies(table).collect()} == want
    assert sum(want[100 + i] == i % 10 for i in range(40)) >= 36


def counted(pairs):
    from collections import Counter

    out = Counter()
    for a, b in pairs:
        if a != b:
            out[max(a, b), min(a, b)] += 1
    return out


def test_meetings_equal_plain_ones(spark):
    """Buckets of all kinds of sizes, in many small batches."""
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 64, 65, 300, 3, 1, 2, 700]
    rows = [(k, int(rng.integers(0, 50)), int(rng.integers(0, 4)), 0) for k, n in enumerate(sizes) for _ in range(n)]
    table = spark.createDataFrame([(*r, r[1] % 7) for r in rows], "bucket long, image long, hi long, lo long, root long")
    near = lambda x, y: (x[2] ^ y[2]).bit_count() <= 1
    of = [sorted(r for r in rows if r[0] == k) for k in range(len(sizes))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        first, every = D.with_first(table, 1, 64).collect(), D.with_all(table, 1, 64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = lambda got: {k: n for k, n in _sum((r.a, r.b, r.n) for r in got if r.b is not None).items()}
    left = lambda got: sorted((r.bucket, r.a, r.hi, r.lo) for r in got if r.b is None)
    assert left(first) == sorted(r for r in rows if sizes[r[0]] > 2) and left(every) == sorted(r for r in rows if sizes[r[0]] > 64)
    pairs = [(x[1], y[1]) for own in of if len(own) <= 64 for i, x in enumerate(own) for y in own[:i] if x[1] % 7 != y[1] % 7 and near(x, y)]
    assert seen(every) == counted(pairs)
    images = {r.b if r.b in {own[0][1] for own in of} else r.a for r in first if r.b is not None}
    assert images <= {own[0][1] for own in of}
    assert sum(seen(first).values()) <= sum(n - 1 for n in sizes)


def _sum(rows):
    out = {}
    for a, b, n in rows:
        out[a, b] = out.get((a, b), 0) + n
    return out


def test_hundreds_of_copies_of_one_picture_are_one_group(spark):
    base = noise_picture(3)
    rows = [(0, D.write_pgm(base))] + [(i, D.write_pgm(D.edited(base, i))) for i in range(1, 301)] + [(1000 + i, D.write_pgm(noise_picture(100 + i))) for i in range(40)]
    got = {r.image_id: r.group_id for r in D.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert sum(got[i] == 0 for i in range(301)) >= 300
    assert all(got[1000 + i] == 1000 + i for i in range(40))


def crowded(images=300):
    """Images with the same eight words but for bits that no table reads, at places of their own; the last is a copy of the first."""
    rng = np.random.default_rng(1)
    words = [tuple(int(w) << 8 for w in rng.integers(-(2**54), 2**54, 2)) for _ in range(8)]
    spots = lambda: [D.packed(float(x), float(y), 1.0, 0.0) for x, y in rng.integers(20, 2000, (8, 2))]
    points = lambda places: [(p, hi, lo | int(rng.integers(0, 256))) for p, (hi, lo) in zip(places, words, strict=True)]
    own = spots()
    return [(0, points(own))] + [(i, points(spots())) for i in range(1, images)] + [(images, points(own))]


def test_a_crowd_of_copies_has_no_more_links_than_images(spark, monkeypatch):
    """Copies that lack some corners have different first ones in their buckets; each used to be linked to all of these."""
    rng = np.random.default_rng(3)
    words = [tuple(int(w) for w in rng.integers(-(2**62), 2**62, 2)) for _ in range(24)]
    spots = [D.packed(float(x), float(y), 1.0, 0.0) for x, y in rng.integers(20, 2000, (24, 2))]
    rows = [(i, [(spots[k], *words[k]) for k in sorted(rng.choice(24, 14, replace=False))]) for i in range(100)]
    table = spark.createDataFrame([(i, [(int(p), h, w) for p, h, w in points]) for i, points in rows], "image long, points array<struct<geo:long,hi:long,lo:long>>")
    counts, components = [], D.components

    def noted(edges):
        counts.append(edges.count())
        return components(edges)

    monkeypatch.setattr(D, "components", noted)
    assert {(r.node, r.root) for r in D.linked(table).collect()} == {(i, 0) for i in range(100)}
    assert max(counts) <= len(rows)


def test_a_crowd_that_is_joined_leaves_no_rows(spark, monkeypatch):
    """Each row of a crowd's buckets used to be kept and joined with its image's root before these were left out."""
    rng = np.random.default_rng(5)
    point = lambda w: (D.packed(*(float(x) for x in rng.integers(20, 2000, 2)), 1.0, 0.0), *(int(x) for x in w))
    words = lambda n: rng.integers(-(2**62), 2**62, (n, 2))
    common, own = [point(w) for w in words(12)], [[point(w) for w in words(3)] for _ in range(80)]
    # Two more have one of the crowd's words each: their bucket is kept, the others are not.
    rows = [(i, common + own[i]) for i in range(80)] + [(100 + i, [point(common[i][1:])] + [point(w) for w in words(6)]) for i in range(2)]
    kept, written = {}, D.written

    def noted(df, tag):
        out = written(df, tag)
        kept[tag] = out
        return out

    monkeypatch.setattr(D, "written", noted)
    table = spark.createDataFrame(rows, "image long, points array<struct<geo:long,hi:long,lo:long>>")
    assert {(r.node, r.root) for r in D.linked(table).collect()} == {(i, 0) for i in range(80)}
    left = kept["met"].where("b is null")
    assert left.select("bucket").distinct().count() == 2 * 6 and left.count() == 2 * 6 * 81


def test_crowded_buckets_are_compared_whole(spark):
    table = spark.createDataFrame(crowded(), "image long, points array<struct<geo:long,hi:long,lo:long>>")
    assert {(r.node, r.root) for r in D.linked(table).collect()} == {(0, 0), (300, 0)}
    moved = spark.createDataFrame([(300 - i, p) for i, p in crowded()[:-1]] + [(1000, crowded()[150][1])], table.schema)
    assert {(r.node, r.root) for r in D.linked(moved).collect()} == {(150, 150), (1000, 150)}


def test_keys_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Two images meet in the same buckets beside many others; keys used to lengthen with the table."""
    schema = "image long, points array<struct<geo:long,hi:long,lo:long>>"
    rng, two = np.random.default_rng(5), crowded(2)[:2]
    others = [(1000 + i, [(1, int(h), int(w)) for h, w in rng.integers(-(2**62), 2**62, (8, 2))]) for i in range(3000)]
    used, dealt = [], D.dealt

    class Seen(Exception):
        pass

    def noted(points, **how):
        used.append({(r.bucket, r.image) for r in dealt(points, **how).where("image < 1000").collect()})
        raise Seen

    monkeypatch.setattr(D, "dealt", noted)
    for rows in (two, two + others):
        try:
            D.linked(spark.createDataFrame(rows, schema))
        except Seen:
            continue
    assert len(used) == 2 and used[0] and used[0] == used[1]


def test_corners_that_differ_in_fourteen_bits_match(spark):
    (_, first), *_ = crowded(1)
    noisy = [(p, hi ^ 0b11111110000000111111100000000, lo) for p, hi, lo in first]
    table = spark.createDataFrame([(1, first), (2, noisy)], "image long, points array<struct<geo:long,hi:long,lo:long>>")
    assert {(r.node, r.root) for r in D.linked(table).collect()} == {(1, 1), (2, 1)}


def test_awkward_images(spark):
    flat = D.write_pgm(np.full((64, 64), 9, np.uint8))
    rows = [(1, None), (2, b""), (3, b"P5 x"), (4, D.write_pgm(np.zeros((8, 8), np.uint8))), (5, flat), (6, flat), (7, None), (None, flat), (8, b"P5 2000000000 9 255\n")]
    table = spark.createDataFrame([(i, d, "clash") for i, d in rows], "image_id long, image binary, sum string")
    got = sorted(((r.image_id, r.group_id, r.corners) for r in D.copies(table).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 5, 0), (7, 7, 0), (8, 8, 0), (None, 5, 0)], key=str)
    assert D.copies(table.limit(0)).count() == 0


def test_pictures_of_vectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").limit(50)
    made = D.pictures(vectors).collect()
    assert len(made) == 50 + sum(r.copy_of is not None for r in made) and all(D.read_pgm(bytes(r.image)) is not None for r in made)
