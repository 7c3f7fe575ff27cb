"""Tile merging against going through the pairs one by one."""

import random

import pytest

from millrace.operators import tiles

SCHEMA = "sheet string, tile int, id long, class string, tag string, confidence double, x0 double, y0 double, x1 double, y1 double, edges array<string>"


def overlap(a, b):
    ix, iy = (max(0.0, min(a[2 + k], b[2 + k]) - max(a[k], b[k])) for k in (0, 1))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    both = ix * iy
    union = area(a) + area(b) - both
    return (both / union if union > 0 else 0.0), (both / min(area(a), area(b)) if min(area(a), area(b)) > 0 else 0.0)


def seam(a, b, ea, eb):
    if not ea or not eb:
        return False
    ix, iy = (min(a[2 + k], b[2 + k]) - max(a[k], b[k]) for k in (0, 1))
    if ix < 0 or iy < 0:
        return False
    touched = set(ea) | set(eb)
    return bool(touched & {"left", "right"} and iy >= 0.5 * min(a[3] - a[1], b[3] - b[1])) or bool(touched & {"top", "bottom"} and ix >= 0.5 * min(a[2] - a[0], b[2] - b[0]))


def plain(boxes):
    """Box to symbol; ``boxes``: tuples of the schema."""
    pairs = []
    for a in boxes:
        for b in boxes:
            if a[0] == b[0] and a[2] < b[2] and a[1] != b[1]:
                iou, inside = overlap(a[6:10], b[6:10])
                if a[3] == b[3] and (iou >= 0.3 or inside >= 0.6):
                    pairs.append((max(iou, inside), a[2], b[2]))
                elif a[3] == b[3] and seam(a[6:10], b[6:10], a[10], b[10]):
                    pairs.append((max(iou, 0.01), a[2], b[2]))
                elif a[3] != b[3] and iou >= 0.5:
                    pairs.append((iou - 0.5, a[2], b[2]))
    group = {b[2]: {b[2]} for b in boxes}
    tile = {b[2]: b[1] for b in boxes}
    for _, a, b in sorted(pairs, reverse=True):
        if group[a] is not group[b] and not {tile[x] for x in group[a]} & {tile[x] for x in group[b]}:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    return {x: min(g) for x, g in group.items()}


def crowd(seed, sheets=6, n=60):
    rng, out = random.Random(seed), []
    for s in range(sheets):
        for _ in range(n):
            x, y, w, h = rng.randint(0, 300), rng.randint(0, 200), rng.randint(10, 90), rng.randint(10, 60)
            edges = rng.choice([[], [], ["left"], ["right", "top"], ["bottom"]])
            out.append((f"s{s}", rng.randint(0, 5), len(out), rng.choice(["pump", "valve"]), rng.choice([None, "", "A-1", "B-2"]), rng.choice([0.2, 0.5, 0.9]), float(x), float(y), float(x + w), float(y + h), edges))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_crowded_sheets(spark, seed):
    rows = crowd(seed)
    want = plain(rows)
    boxes = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.symbol for r in tiles.grouped(boxes, tiles.candidates(boxes)).collect()}
    assert got == want and len(set(want.values())) < len(want)
    rng = random.Random(seed)
    shown = [(r[0], r[2], rng.choice([x[2] for x in rows if x[0] == r[0] and x[1] == r[1]] + [-1])) for r in rows for _ in range(2)]
    symbols, links, stats = tiles.merge_tiles(boxes, spark.createDataFrame(shown, "sheet string, a long, b long"))
    by = {}
    for r in rows:
        by.setdefault(want[r[2]], []).append(r)
    for s in symbols.collect():
        own = by.pop(s.id)
        best = max(own, key=lambda r: (r[5], -r[2]))
        whole = [r for r in own if not r[10]]
        box = max(whole, key=lambda r: (r[5], -r[2]))[6:10] if whole else (min(r[6] for r in own), min(r[7] for r in own), max(r[8] for r in own), max(r[9] for r in own))
        assert (s["class"], s.tag, (s.x0, s.y0, s.x1, s.y1), s.tiles, s.parts) == (best[3], best[4] or next((r[4] for r in own if r[4]), None), box, sorted({r[1] for r in own}), [r[2] for r in own])
    assert not by
    renamed = {(sheet, *sorted((want[a], want[b]))) for sheet, a, b in shown if b in want and want[a] != want[b]}
    assert {tuple(r) for r in links.collect()} == renamed
    for r in stats.collect():
        assert r.tile_links == 2 * 60 and r.links == sum(x[0] == r.sheet for x in renamed)
        assert r.tile_symbols == 60 and r.links_dropped == sum(x[0] == r.sheet and not (x[2] in want and want[x[1]] != want[x[2]]) for x in shown)


def test_tiles_and_their_edges(spark):
    sheets = spark.createDataFrame([("a", 1000, 600, 2, 1, 0.2), ("b", 500, 500, 1, 1, 0.0)], "sheet string, width int, height int, cols int, rows int, overlap double")
    boxes = tiles.tile_boxes(sheets)
    assert {(r.sheet, r.tile): (r.px0, r.py0, r.px1, r.py1) for r in boxes.collect()} == {("a", 0): (0, 0, 556, 600), ("a", 1): (444, 0, 1000, 600), ("b", 0): (0, 0, 500, 500)}
    seen = [("a", 0, 1, "pump", "P-1", 0.9, 900.0, 100.0, 1000.0, 200.0), ("a", 1, 2, "pump", None, None, 0.0, 100.0, 150.0, 200.0), ("b", 0, 3, "tank", "T", 0.5, 0.0, 0.0, 1000.0, 1000.0)]
    on = tiles.on_sheet(spark.createDataFrame(seen, "sheet string, tile int, id long, class string, tag string, confidence double, x0 double, y0 double, x1 double, y1 double"), boxes)
    assert {r.id: r.edges for r in on.collect()} == {1: ["right"], 2: ["left"], 3: []}
    symbols, links, stats = tiles.merge_tiles(on, spark.createDataFrame([("a", 1, 2), ("b", 3, 3)], "sheet string, a long, b long"))
    got = {r.id: r for r in symbols.collect()}
    assert set(got) == {1, 3} and got[1].parts == [1, 2] and got[1].tag == "P-1" and links.count() == 0
    assert {r.sheet: (r.merged_groups, r.seam_unions, r.links_dropped) for r in stats.collect()} == {"a": (1, 1, 1), "b": (0, 0, 1)}
