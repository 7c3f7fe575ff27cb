import pytest

from millrace.operators import impact as I

STEAM = [(100.0, 1187.0), (150.0, 1194.0), (200.0, 1198.0)]


def changes(spark, *given):
    rows = [(i, "site", {k: (float(v), float(v)) if not isinstance(v, tuple) else tuple(map(float, v)) for k, v in own.items()}) for i, own in enumerate(given)]
    return spark.createDataFrame(rows, "id int, site string, given map<string, struct<lo: double, hi: double>>")


def test_ranges_follow_the_derivations(spark):
    df = changes(spark, {"hp": (10, 20), "hours": (1000, 2000), "price_per_kwh": 0.1}, {"psia": (100, 175), "feedwater_btu_per_lb": 100, "lb_per_h": 1000, "hours": 1000, "boiler_efficiency": (0.75, 0.8), "price_per_mmbtu": 4}, {"kw_before": (50, 60), "kw_after": (40, 55), "hours": 10})
    got = {r.id: r for r in I.resolved(df, tables={"steam_btu_per_lb": ("psia", STEAM)}).collect()}
    assert all(r.refused == [] for r in got.values())
    assert tuple(got[0].known["kwh"]) == pytest.approx((7457, 29828)) and tuple(got[0].known["cost_electricity"]) == pytest.approx((745.7, 2982.8))
    assert tuple(got[1].known["steam_btu_per_lb"]) == pytest.approx((1187, 1196)) and tuple(got[1].known["fuel_mmbtu"]) == pytest.approx((1087 / 0.8, 1096 / 0.75))
    assert tuple(got[2].known["kwh"]) == pytest.approx((-50, 200))


def test_refusals_are_rows(spark):
    df = changes(spark, {"hp": 10, "kw": 5, "hours": 1}, {"hp": 10, "kw": 7.457, "hours": 1}, {"heat_mmbtu": 5, "boiler_efficiency": (-0.1, 0.8)}, {"psia": (50, 120)}, {"kw": (3, 2)}, {"hp": 1, "kw_before": 3, "kw_after": 2}, {"kw": float("nan"), "hours": 1}, {})
    out = I.resolved(df, tables={"steam_btu_per_lb": ("psia", STEAM)})
    assert {r.id: r.refused for r in out.collect()} == {
        0: ["derived in two ways: kw"], 1: [], 2: ["division by zero: fuel_mmbtu"], 3: ["outside the table: steam_btu_per_lb"], 4: ["not a range: kw"], 5: ["derived in two ways: kw"], 6: ["not a range: kw"], 7: [],
    }
    total = {r.measure: r for r in I.totals(out, ["site"]).collect()}
    assert (total["kwh"].changes, total["kwh"].refused, total["kwh"].lo, total["kwh"].hi) == (1, 6, 7.457, 7.457) and total["cost_fuel"].lo is None


def test_rules_in_a_circle_and_bad_tables():
    with pytest.raises(ValueError, match="need each other"):
        I.in_order([I.Rule("a", "b", "*", 2.0), I.Rule("b", "a", "*", 0.5)])
    with pytest.raises(ValueError, match="points that rise"):
        I.interpolated(None, [(1.0, 2.0)])
