"""Each stage against a plain version of its decision, on all documents of the smallest size."""

from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import mixing, registry
from millrace.scratch import new_path
from tests.llm.test_secrets import plain as plain_spans
from tests.llm.test_simhash import plain_fp, union

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    predicted = {r.doc_id: r.predicted for r in registry.op7(spark, SF).collect()}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == {i for i, p in predicted.items() if not p}

    single = corpus_pipeline.near_dedup(spark, clean, SF)
    assert single.columns == docs.columns
    fps = {i: plain_fp(t) for i, t in kept.items()}
    groups = union(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    ones = {r.doc_id: r.text for r in single.collect()}
    assert set(ones) == {i for i, g in groups.items() if i == g}

    safe = corpus_pipeline.redact_secrets(spark, single, SF)
    assert safe.columns == docs.columns
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert set(texts) == set(ones)
    for i, t in ones.items():
        spans = plain_spans(t)
        assert (texts[i] == t) or "[SECRET]" in texts[i]
        if spans:
            assert not any(t[s:e] in texts[i] for s, _, e in spans)

    mixed = corpus_pipeline.mix_sources(spark, safe, SF)
    assert mixed.columns == docs.columns
    plan = mixing.mix(safe).collect()
    want = {r.doc_id: len(r.passes) for r in plan if r.passes}
    path = new_path(spark, "mixed")
    mixed.write.parquet(path)
    mixed = spark.read.parquet(path)
    placed = sorted((r.place, r.doc_id) for r in corpus_pipeline.in_file_order(mixed, "place").collect())
    assert [p for p, _ in placed] == list(range(len(placed)))
    assert [i for _, i in placed] == [i for *_, i in sorted((p.position, r.doc_id) for r in plan for p in r.passes)]

    packed = corpus_pipeline.pack(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_run_has_the_rows_of_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


CLASHES = ("score", "found", "__text", "key", "passes", "one", "place", "doc_id_", "component_id", "fp", "size", "group", "_metadata_", "length")
ROWS = [
    (1, "plain words that say nothing of note at all", "a"),
    (1, "plain words that say nothing of note at all", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "long " * 60_000 + "secret=Zk4Lq8Xp2Rt9Vm7N", "b"),
    (None, "secret=Zk4Lq8Xp2Rt9Vm7N in a text without an id", None),
    (5, "you worthless pathetic scum, you stupid idiot", "b"),
    (None, None, None),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_takes_nulls_long_texts_repeats_and_clashing_names(spark, name, stage):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in CLASHES:
        docs = docs.withColumn(c, docs["doc_id"])
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
        return
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in rows)
    want = {
        "toxicity": {1: 2, 2: 1, 3: 1, 4: 1, None: 2},
        "near_dedup": {1: 1, 2: 1, 4: 1, None: 2, 5: 1},
        "secrets": {1: 2, 2: 1, 3: 1, 4: 1, None: 2, 5: 1},
    }
    if name == "mixing":
        assert {2, 3}.isdisjoint(ids) and {4} <= set(ids)
    elif name == "toxicity":
        assert {i: n for i, n in ids.items() if i != 5} == want[name]
    else:
        assert ids == want[name]
    texts = [r.text for r in rows if r.text]
    if name == "secrets":
        assert not any("Zk4Lq8Xp2Rt9Vm7N" in t for t in texts) and sum("[SECRET]" in t for t in texts) == 2
    else:
        assert any(len(t) > 300_000 for t in texts)
