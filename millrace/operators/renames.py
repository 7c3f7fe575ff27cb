"""A renamed tag followed through nested records of any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

#: Where live names stand, by section (fixed values); lists on the way have no part in a field's name.
IDENTITIES = ("units.id", "instruments.tag", "final_elements.tag", "controllers.tag", "manual_valves.tag", "relief_devices.tag", "interlocks.id", "unplaced.tag")
#: The fields that refer to the tags of a section (fixed values).
LINES = ("limits.tag", "line_layers.networks.members", *(f"line_layers.{g}.{end}" for g in ("segments", "instrument_lines", "actuator_stems", "nozzle_stubs") for end in ("from", "to")))
REFERENCES = {
    "instruments": ("controllers.measurement", "controllers.measurement_unplaced", "interlocks.measurement", *LINES),
    "final_elements": ("controllers.output.final_element", "controllers.output.split_range", "controllers.output_unplaced", "interlocks.final_element", *LINES),
}


def _texts(node: object, path: str = "", field: str = "") -> Iterator[tuple[str, str, str]]:
    """Path, field and value of every text in a record."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield from _texts(value, f"{path}.{key}" if path else key, f"{field}.{key}" if field else key)
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from _texts(value, f"{path}[{i}]", field)
    elif isinstance(node, str):
        yield path, field, node


def _with(node: object, changes: dict[str, str], path: str = "") -> object:
    """The record with the texts at some paths replaced."""
    if isinstance(node, dict):
        return {key: _with(value, changes, f"{path}.{key}" if path else key) for key, value in node.items()}
    if isinstance(node, list):
        return [_with(value, changes, f"{path}[{i}]") for i, value in enumerate(node)]
    return changes.get(path, node) if isinstance(node, str) else node


def index(models: DataFrame) -> DataFrame:
    """``(model, path, field, value)``: every text of ``models(model, record)``, a JSON object each; a null record has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, record in enumerate(batch.column(1).to_pylist()):
                for found in _texts(json.loads(record) if record else {}):
                    at.append(i)
                    rows.append(found)
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["model", "path", "field", "value"])

    own = models.select("model", F.col("record").cast("string").alias("record"))
    return own.mapInArrow(run, f"model {own.schema['model'].dataType.simpleString()}, path string, field string, value string")


def planned(models: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes ``(model, path, old, new)`` and refusals ``(model, old, new, why)`` for ``mapping(model, section, old, new)``.

    The tag itself changes in its section, and every field that may refer to
    it. A rename is refused if the section does not hold the old tag just
    once, if the model gives that name (in any case) to more than one item, if
    the new name is held by an item that is not renamed away, or if two
    renames give it. Source texts, histories and other fields stay.
    """
    texts = written(index(models), "texts")
    names = texts.where(F.col("field").isin(*IDENTITIES)).select("model", "field", "value", F.lower("value").alias("name"))
    asked = written(mapping.select("model", "section", "old", "new").distinct().withColumns({"name": F.lower("old"), "to": F.lower("new")}), "asked")
    held = names.groupBy("model", "name").agg(F.count("*").alias("holders"))
    exact = names.select("model", F.substring_index("field", ".", 1).alias("section"), F.col("value").alias("old")).groupBy("model", "section", "old").agg(F.count("*").alias("own"))
    twice = asked.groupBy("model", "to").agg(F.count_distinct("name").alias("givers"))
    rated = asked.join(exact, ["model", "section", "old"], "left").join(held, ["model", "name"], "left").join(held.select("model", F.col("name").alias("to"), F.col("holders").alias("there")), ["model", "to"], "left").join(twice, ["model", "to"])
    why = (
        F.when(F.col("section").isNull() | ~F.col("section").isin(*REFERENCES), "no such section")
        .when(F.coalesce("own", F.lit(0)) == 0, "no such tag")
        .when((F.col("own") > 1) | (F.col("holders") > 1), "ambiguous name")
        .when(F.coalesce(F.trim("new"), F.lit("")) == "", "no new name")
        .when(F.col("givers") > 1, "given twice")
    )
    rated = written(rated.withColumn("why", why), "rated")
    # A name is free once its holder is renamed away; a refused rename frees none, so refusals are looked for until none is new.
    while True:
        away = rated.where("why is null").select("model", F.col("name").alias("to"), F.lit(True).alias("away")).distinct()
        held_on = rated.join(away, ["model", "to"], "left").where("why is null and there is not null and away is null").select("model", "old", F.lit("held by another item").alias("now"))
        held_on = written(held_on, "held")
        if held_on.isEmpty():
            break
        rated = written(rated.join(held_on, ["model", "old"], "left").withColumn("why", F.coalesce("why", "now")).drop("now"), "rated")
    good = rated.where("why is null").select("model", "section", "old", "new")
    fields = [(s, f) for s, own in REFERENCES.items() for f in (f"{s}.tag", *own)]
    allowed = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field")) for s, f in fields])
    places = good.select("model", F.col("old").alias("value"), "new", F.explode(F.filter(allowed, lambda x: x["section"] == F.col("section"))).alias("x")).select("model", "value", "new", "x.field")
    changes = texts.join(places, ["model", "field", "value"]).select("model", "path", F.col("value").alias("old"), "new").distinct()
    return changes, rated.where("why is not null").select("model", "old", "new", "why")


def applied(models: DataFrame, changes: DataFrame) -> DataFrame:
    """``models`` with the changes of ``planned`` put back at their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(_with(json.loads(record), dict(own)), ensure_ascii=False) if own else record for record, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["model", "record"])

    own = changes.groupBy(F.col("model").alias("_model")).agg(F.map_from_entries(F.collect_list(F.struct("path", "new"))).alias("changes"))
    joined = models.join(own, F.col("model") == F.col("_model"), "left").select("model", F.col("record").cast("string").alias("record"), "changes")
    return joined.mapInArrow(run, f"model {models.schema['model'].dataType.simpleString()}, record string")
