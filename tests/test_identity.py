"""Containment against all pairs; sheet numbers against one choice after the other."""

import random
from collections import Counter

import pytest

from millrace.operators import identity


def test_identifiers_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda lo, hi: "".join(rng.choices("ab1-", k=rng.randint(lo, hi)))
    tags = [(rng.randint(0, 3), rng.choice([word(0, 9), None, "aaaaaaaa"]), rng.choice(["pump", "valve", None])) for _ in range(300)]
    listed = [(rng.randint(0, 4), rng.choice([word(0, 5), None]), rng.choice(["pump", "valve"])) for _ in range(200)]
    got = identity.contained(spark.createDataFrame(listed, "sheet int, identifier string, class string"), spark.createDataFrame(tags, "sheet int, tag string, class string"), ["sheet"])
    want = []
    for sheet, ident, kind in listed:
        hits = [c for s, t, c in tags if s == sheet and t and ident and ident in t]
        want.append((sheet, ident, kind, len(hits), bool(hits), kind in hits))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "sheet int, identifier string, class string")
    assert identity.contained(none, spark.createDataFrame(tags, "sheet int, tag string, class string"), ["sheet"]).count() == 0


def choice(tags, refs, register):
    codes = {s: Counter(c for t, c in tags if t == s and c) for s in {t for t, _ in tags}}
    own = {s: {n for t, _, n in refs if t == s and n} for s in codes}
    pairs = {(c, n) for _, c, n in refs if c and n}
    numbers = {s: n for s, _, n in register if n}
    cands = {}
    for s, seen in codes.items():
        if s in numbers:
            continue
        top = max(seen.values(), default=0)
        votes = Counter()
        for c, n in pairs:
            if seen.get(c) == top and n not in own[s]:
                votes[n] += top
        cands[s] = {n: (-v, -len({t for t, _, m in refs if m == n} - {s})) for n, v in votes.items()}
    taken, given, unsure = set(numbers.values()), {}, set()
    for key, s, n in sorted((k, s, n) for s, own in cands.items() for n, k in own.items()):
        free = sorted((k, m) for m, k in cands[s].items() if m not in taken)
        if s in given or n in taken:
            continue
        if len(free) > 1 and free[0][0] == free[1][0]:
            unsure.add(s)
        elif free[0] == (key, n):
            given[s] = n
            taken.add(n)
    return numbers, given, unsure, cands


@pytest.mark.parametrize("seed", range(3))
def test_sheet_numbers(spark, seed):
    rng = random.Random(seed)
    tags, refs, register = [], [], []
    for k in range(25):
        sheet = f"s{k:02}"
        tags += [(sheet, rng.choice([f"C{rng.randint(0, 7)}", f"C{k % 8}", None])) for _ in range(rng.randint(1, 6))]
        refs += [(sheet, rng.choice([f"C{rng.randint(0, 8)}", None]), rng.choice([f"D{rng.randint(0, 20)}", None])) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.2:
            register.append((sheet, rng.choice(["REG", None]), rng.choice([f"D{k}", None])))
    got = identity.sheet_identity(spark.createDataFrame(tags, "sheet string, code string"), spark.createDataFrame(refs, "sheet string, code string, number string"), spark.createDataFrame(register, "sheet string, system_code string, drawing_number string"))
    numbers, given, unsure, cands = choice(tags, refs, register)
    rows = {r.sheet: r for r in got.collect()}
    assert len(rows) == 25 and given
    for s, r in rows.items():
        how = "register" if s in numbers else "references" if s in given else "ambiguous" if s in unsure else "unknown"
        assert (r.drawing_number, r.drawing_number_method) == (numbers.get(s, given.get(s)), how)
        assert r.candidates == sorted(cands.get(s, {}))
        seen = Counter(c for t, c in tags if t == s and c)
        best = sorted(c for c, n in seen.items() if n == max(seen.values()))
        reg = next((c for t, c, _ in register if t == s and c), None)
        if reg:
            assert (r.system_code, r.system_code_method) == (reg, "register")
        elif not best:
            assert (r.system_code, r.system_code_method) == (None, "none")
        elif s in given and len(best) > 1:
            assert r.system_code in best and r.system_code_method == "tag prefix and references"
        else:
            assert (r.system_code, r.system_code_method) == (best[0], "tag prefix" if len(best) == 1 else "tag prefix, tie")


def test_equal_numbers_stay_ambiguous_until_one_is_taken(spark):
    tags = spark.createDataFrame([("a", "C1"), ("b", "C2"), ("b", "C2"), ("z", None)], "sheet string, code string")
    tie = [("z", "C1", "D1"), ("z", "C1", "D2")]
    of = lambda refs: {r.sheet: (r.drawing_number, r.drawing_number_method) for r in identity.sheet_identity(tags, spark.createDataFrame(refs, "sheet string, code string, number string"), tags.limit(0).selectExpr("sheet", "code AS system_code", "code AS drawing_number")).collect()}
    assert of(tie) == {"a": (None, "ambiguous"), "b": (None, "unknown"), "z": (None, "unknown")}
    assert of([*tie, ("z", "C2", "D1")]) == {"a": ("D2", "references"), "b": ("D1", "references"), "z": (None, "unknown")}


def test_few_numbers_for_many_sheets(spark):
    """Sheets that all want the same numbers hang together one after the other; before, each such step was a round."""
    rng = random.Random(8)
    tags = [(s, "C1") for s in range(150) for _ in range(rng.randint(1, 4))]
    refs = [(s, "C1", f"D{n:02}") for n in range(60) for s in rng.sample(range(150), n + (1 if n % 5 else 2))]
    numbers, given, unsure, _ = choice(tags, refs, [])
    assert len(given) > 40
    frames = spark.createDataFrame(tags, "sheet long, code string"), spark.createDataFrame(refs, "sheet long, code string, number string")
    none = frames[0].limit(0).selectExpr("sheet", "code AS system_code", "code AS drawing_number")
    how = lambda s: "references" if s in given else "ambiguous" if s in unsure else "unknown"
    for rounds, block in ((2, identity.BLOCK), (16, 800)):
        rows = identity.sheet_identity(*frames, none, most_rounds=rounds, block=block).collect()
        assert {r.sheet: (r.drawing_number, r.drawing_number_method) for r in rows} == {s: (given.get(s), how(s)) for s in range(150)}


def test_sheets_that_get_no_number_take_no_rounds(spark):
    """all pairs of sheets whose best numbers are equal were gone through block by block, though none is ever taken."""
    tags = spark.createDataFrame([(s, "C1") for s in range(60)], "sheet long, code string")
    refs = spark.createDataFrame([(-1 - (k % 3), "C1", f"D{n}") for n in range(40) for k in range(3)], "sheet long, code string, number string")
    none = tags.limit(0).selectExpr("sheet", "code AS system_code", "code AS drawing_number")
    rows = identity.sheet_identity(tags, refs, none, most_rounds=3, block=100).collect()
    assert {r.sheet: (r.drawing_number_method, len(r.candidates)) for r in rows} == {s: ("ambiguous", 40) for s in range(60)}


@pytest.mark.parametrize("most", [2, 3, 64])
def test_numbers_that_may_be_taken(spark, most):
    """However few pairs a sheet shows at first, the same numbers may be taken and the same pairs stay."""
    rng = random.Random(most)
    pairs = {(s, n): (1 + s % 2, 50 - n if n < 6 else 40 - n // w) for s in range(80) for w in [4 + s % 3] for n in rng.sample(range(40), 38 - s % 2)}
    may, grew = set(), True
    while grew:
        grew = False
        for s in range(80):
            left = sorted(((level, n) for (t, n), level in pairs.items() if t == s and n not in may), reverse=True)
            if left and (len(left) == 1 or left[1][0] != left[0][0]):
                may.add(left[0][1])
                grew = True
    want = {s: max(level for (t, n), level in pairs.items() if t == s and n not in may) for s in range(80) if any(t == s and n not in may for t, n in pairs)}
    frame = spark.createDataFrame([(s, f"D{n}", v, o) for (s, n), (v, o) in pairs.items()], "sheet long, number string, v long, o long")
    numbers, stays = identity.contested(frame, most)
    assert len(may) > 6 and 40 < len(want) <= 80
    assert {r.number for r in numbers.collect()} == {f"D{n}" for n in may}
    assert {r.sheet: (r.v, r.o) for r in stays.collect()} == want
