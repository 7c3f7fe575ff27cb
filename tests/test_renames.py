import json

from millrace.operators import renames


def model():
    return {
        "name": "TI-1",
        "instruments": [{"id": "i1", "tag": "TI-1", "note": "TI-1"}, {"tag": "ti-2"}, {"tag": "PI-3"}],
        "final_elements": [{"tag": "FV-1"}, {"tag": "FV-2"}],
        "controllers": [{"tag": "TIC-1", "measurement": "TI-1", "output": {"final_element": "FV-1", "split_range": ["FV-2", "FV-1"]}}, {"tag": "TIC-2", "measurement_unplaced": ["TI-1", "x"], "measurement": "FV-1"}],
        "limits": [{"tag": "TI-1"}, {"tag": "TI-10"}],
        "line_layers": {"networks": [{"id": "n", "members": ["TI-1", "FV-1"]}], "segments": [{"from": "FV-1", "to": "TI-1"}], "deep": {"segments": [{"from": "TI-1"}]}},
        "history": [{"tag": "TI-1"}],
    }


def test_a_tag_changes_in_every_place_that_refers_to_it(spark):
    models = spark.createDataFrame([("m", json.dumps(model())), ("n", json.dumps({"instruments": [{"tag": "TI-1"}]})), ("empty", None)], "model string, record string")
    mapping = spark.createDataFrame([("m", "instruments", "TI-1", "TÏ-9"), ("m", "final_elements", "FV-1", "FV-2"), ("m", "final_elements", "FV-2", "FV-1")], "model string, section string, old string, new string")
    changes, refused = renames.planned(models, mapping)
    assert refused.count() == 0
    got = {r.path: (r.old, r.new) for r in changes.collect()}
    assert set(got) == {
        "instruments[0].tag", "controllers[0].measurement", "controllers[1].measurement_unplaced[0]", "limits[0].tag", "line_layers.networks[0].members[0]", "line_layers.segments[0].to",
        "final_elements[0].tag", "final_elements[1].tag", "controllers[0].output.final_element", "controllers[0].output.split_range[0]", "controllers[0].output.split_range[1]", "line_layers.networks[0].members[1]", "line_layers.segments[0].from",
    }
    out = {r.model: r.record for r in renames.applied(models, changes).collect()}
    new = json.loads(out["m"])
    assert new["instruments"][0] == {"id": "i1", "tag": "TÏ-9", "note": "TI-1"} and new["name"] == "TI-1" and new["history"] == [{"tag": "TI-1"}]
    assert new["controllers"][0]["output"] == {"final_element": "FV-2", "split_range": ["FV-1", "FV-2"]} and new["controllers"][1]["measurement"] == "FV-1"
    assert json.loads(out["n"]) == {"instruments": [{"tag": "TI-1"}]} and out["empty"] is None


def test_unclear_renames_are_refused(spark):
    record = {"instruments": [{"tag": "A"}, {"tag": "a"}, {"tag": "B"}, {"tag": "C"}, {"tag": "D"}], "units": [{"id": "U"}]}
    models = spark.createDataFrame([("m", json.dumps(record))], "model string, record string")
    rows = [("instruments", "A", "X"), ("instruments", "B", "u"), ("instruments", "C", "Y"), ("instruments", "D", "y"), ("instruments", "Z", "W"), ("units", "U", "V")]
    changes, refused = renames.planned(models, spark.createDataFrame([("m", *r) for r in rows], "model string, section string, old string, new string"))
    assert changes.count() == 0
    assert {r.old: r.why for r in refused.collect()} == {"A": "ambiguous name", "B": "held by another item", "C": "given twice", "D": "given twice", "Z": "no such tag", "U": "no such section"}
