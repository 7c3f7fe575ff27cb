"""Streams of lines against enumerating every simple path."""

import random
import time

import pytest

from millrace.sources import streams as S


def enumerated(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    into = {b for bs in after.values() for b in bs}
    best = {}
    stack = [(x,) for x in (set(after) - into or {min(after)})]
    while stack:
        path = stack.pop()
        ahead = after[path[-1]] - set(path)
        if not ahead:
            key = (path[0], path[-1])
            best[key] = min(path, best.get(key, path))
        stack += [(*path, x) for x in ahead]
    return [(a, b, list(p)) for (a, b), p in sorted(best.items())]


@pytest.mark.parametrize("seed", range(200))
def test_small_lines(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 9)
    forward = rng.random() < 0.4
    edges = []
    for _ in range(rng.randint(1, 14)):
        a, b = rng.randrange(n), rng.randrange(n)
        edges.append((min(a, b), max(a, b)) if forward and a != b else (a, b))
    assert S.line_paths(edges) == enumerated(edges)


def diamonds(n):
    out = []
    for i in range(n):
        out += [(3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3)]
    return out


def test_many_diamonds_end(spark):
    began = time.time()
    edges = [("f", 1, a, b) for a, b in diamonds(200)] + [("f", 2, a + 10_000, b + 10_000) for a, b in diamonds(3)]
    got = {r.line: r for r in S.streams(spark.createDataFrame(edges, "file string, line int, a int, b int")).collect()}
    assert (got[1].start, got[1].end, len(got[1].path)) == (0, 600, 401) and got[1].path[:4] == [0, 1, 3, 4]
    assert (got[2].from_kind, got[2].to_kind, got[2].stream, got[2].same_line_as) == ("closed", "closed", 1, None)
    assert time.time() - began < 120


def test_ends_of_streams(spark):
    """Line 1 goes from unit U1 to an open end and, over line 2, to unit U2; line 3 has a closed end."""
    edges = [("f", 1, 1, 2), ("f", 1, 2, 3), ("f", 1, 2, 4), ("f", 2, 4, 5), ("f", 2, 5, 6), ("f", 3, 7, 8), ("f", 3, 7, 6), ("f", 4, 20, 21), ("f", 4, 21, 22), ("f", 4, 22, 21), ("g", 1, 1, 2)]
    ends = [("f", 1, "unit", "U1"), ("f", 3, "battery limit", None), ("f", 6, "unit", "U2"), ("f", 7, "broken", "FromID:x")]
    got = S.streams(spark.createDataFrame(edges, "file string, line int, a int, b int"), spark.createDataFrame(ends, "file string, id int, kind string, of string"))
    rows = {(r.file, r.line, r.stream): (r.start, r.end, r.from_kind, r.from_of, r.to_kind, r.to_of, r.same_line_as) for r in got.collect()}
    assert rows == {
        ("f", 1, 1): (1, 3, "unit", "U1", "battery limit", None, None),
        ("f", 1, 2): (1, 4, "unit", "U1", "unit", "U2", 1),
        ("f", 2, 1): (4, 6, "unit", "U1", "unit", "U2", None),
        ("f", 3, 1): (7, 6, "broken", "FromID:x", "unit", "U2", None),
        ("f", 4, 1): (20, 22, "closed", None, "closed", None, None),
        ("g", 1, 1): (1, 2, "closed", None, "closed", None, None),
    }
    assert S.streams(spark.createDataFrame([], "file string, line int, a int, b int")).count() == 0
