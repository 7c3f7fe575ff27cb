"""Prediction records, answer keys, lists, registers and structured drawings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import written

CLASSES = ("pump", "tank", "valve", "instrumentation", "inlet/outlet", "general")
SYMBOL = "array<struct<id:string,class:string,box:array<double>,bbox:struct<x_min:double,y_min:double,x_max:double,y_max:double>,tag:string,confidence:double>>"
LINK = "array<struct<`from`:string,`to`:string>>"
RUN = f"schema string, tool string, drawing string, label string, model string, seconds double, cost_usd double, error string, parse_error string, prediction struct<symbols:{SYMBOL},connections:{LINK}>, symbols {SYMBOL}, connections {LINK}"


def graph_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML files as ``nodes(sheet, node_id, data)`` and ``edges(sheet, source, target)``; data maps key to text."""
    datum = "array<struct<_key:string,_VALUE:string>>"

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("_metadata.file_path").alias("sheet"), "*")

    nodes = rows("node", f"_id string, data {datum}")
    edges = rows("edge", f"_source string, _target string, data {datum}")
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(datum)), lambda d: F.struct(d["_key"].alias("k"), d["_VALUE"].alias("v"))))
    return nodes.select("sheet", F.col("_id").alias("node_id"), as_map.alias("data")), edges.select("sheet", F.col("_source").alias("source"), F.col("_target").alias("target"))


def scaled_boxes(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes brought to 0-1000 by a table of image sizes ``(sheet, width, height)``."""
    return nodes.join(sizes, "sheet").withColumns({c: F.col(c) * 1000.0 / F.col("width" if c[0] == "x" else "height") for c in ("x0", "y0", "x1", "y1")}).drop("width", "height")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files and run records; a bare prediction is a record without a tool."""
    raw = spark.read.schema(RUN).option("multiLine", True).json(path)
    return raw.withColumn("file", F.col("_metadata.file_path")).withColumns({"symbols": F.coalesce("prediction.symbols", "symbols"), "connections": F.coalesce("prediction.connections", "connections")}).drop("prediction")


def symbols(records: DataFrame, classes: tuple[str, ...] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """Valid symbols with their box, and the number of malformed ones of each file."""
    s = records.select("file", "tool", "drawing", F.explode_outer("symbols").alias("s"))
    named = F.array("s.bbox.x_min", "s.bbox.y_min", "s.bbox.x_max", "s.bbox.y_max")
    box = F.coalesce(F.when(F.size("s.box") == 4, F.col("s.box")), F.when(F.col("s.bbox").isNotNull(), named))
    rows = s.withColumn("box", box)
    whole = F.coalesce(F.col("s.id").isNotNull() & F.col("s.class").isin(*classes) & F.col("box").isNotNull() & F.forall("box", lambda x: x.isNotNull()), F.lit(False))
    good = rows.where(whole).select("file", "tool", "drawing", F.col("s.id").alias("id"), F.col("s.class").alias("class"), *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("s.tag").alias("tag"), F.col("s.confidence").alias("confidence"))
    bad = rows.where(F.col("s").isNotNull() & ~whole).groupBy("file").agg(F.count("*").alias("malformed"))
    return good, bad


def flat_items(models: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Sections (arrays of records as JSON columns) as one item relation: section, pos, id, tag, attrs (variant)."""
    out: DataFrame | None = None
    for name, kind in sections.items():
        if name not in models.columns:
            continue
        own = models.select("file", F.posexplode(F.from_json(F.col(name), "array<string>")).alias("pos", "j")).select("file", F.lit(kind).alias("kind"), "pos", F.get_json_object("j", "$.id").alias("id"), F.get_json_object("j", "$.tag").alias("tag"), F.parse_json("j").alias("attrs"))
        out = own if out is None else out.unionByName(own)
    return out


def control_loops(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Loop lists with physical line numbers, and what is refused: empty fields, repeated controllers, own outputs."""
    from millrace.functions.text import tag_compact

    # Files stay splittable: lines are counted by split, and the splits of a file add up to where each begins.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.regexp_replace("value", r"\r\z", "").alias("text")).withColumn("full", ~F.col("text").rlike(r"^\s*(#|$)"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("rows"), F.min(F.when(F.col("full"), F.col("at"))).alias("head"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    begun = splits.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    headed = written(begun.withColumn("head", F.min(F.col("start") + F.col("head") - F.col("first")).over(Window.partitionBy("file"))), "splits")
    rows = lines.where("full").join(headed, ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).cast("int").alias("line"), "head", "text")
    body = rows.where("line > head").select("file", (F.col("line") + 1).alias("line"), F.from_csv("text", "controller string, measurement string, output string, description string").alias("r")).select("file", "line", "r.*")
    blank = F.lit(False)
    for c in ("controller", "measurement", "output"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    same = F.count("*").over(Window.partitionBy("file", tag_compact(F.col("controller"))))
    marked = body.withColumn("refusal", F.when(blank, "empty field").when(same > 1, "repeated controller").when(tag_compact(F.col("output")) == tag_compact(F.col("controller")), "output is its controller"))
    return marked.where("refusal is null").drop("refusal"), marked.where("refusal is not null")


def list_with_lineage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """List rows with their line and the digest and size of the file they came from."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), F.split(F.decode("content", "UTF-8"), r"\r?\n").alias("lines"))
    rows = files.select("path", "sha256", "bytes", F.posexplode("lines").alias("pos", "text")).where("pos > 0 and trim(text) <> ''")
    return rows.select("path", "sha256", "bytes", (F.col("pos") + 1).alias("line_start"), F.from_csv("text", schema).alias("r")).select("path", "sha256", "bytes", "line_start", "r.*")


def merged_schedule(rows: DataFrame, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One value per (sheet, tag, field) over several files, and the conflicts no resolution settles."""
    per = rows.groupBy("sheet", "tag", F.lower("field").alias("field")).agg(F.array_sort(F.collect_set("value")).alias("values"))
    clash = per.where(F.size("values") > 1)
    good = per.where(F.size("values") == 1).select("sheet", "tag", "field", F.col("values")[0].alias("value"))
    if resolved is None:
        return good, clash
    settled = clash.join(resolved, ["sheet", "tag", "field"]).where(F.array_contains("values", F.col("value"))).select("sheet", "tag", "field", "value")
    return good.unionByName(settled), clash.join(settled.select("sheet", "tag", "field"), ["sheet", "tag", "field"], "left_anti")


def checked_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Registers, review sheets and logs by schema, and rows that do not fit it."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").csv(path).select(F.col("_metadata.file_path").alias("file"), "*")
    raw = written(raw, "checked")  # whether a row is bad shows only where all its columns are parsed
    return raw.where("_bad is null").drop("_bad"), raw.where("_bad is not null").select("file", "_bad")


ELEMENT = "_ID string, _TagName string, _ComponentClass string, GenericAttributes array<struct<GenericAttribute:array<struct<_Name:string,_Value:string,_Units:string>>>>"


def generic_attributes(spark: SparkSession, path: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Attributes of structured drawings as claims, and the number of empty ones by file.

    A name that an element gives again gets ``#2``, ``#3`` in file order.
    """
    raw = spark.read.format("xml").option("rowTag", tag).schema(ELEMENT).load(path).select(F.col("_metadata.file_path").alias("file"), "*")
    rows = raw.select("file", F.col("_ID").alias("id"), F.coalesce("_TagName", "_ID").alias("tag"), F.col("_ComponentClass").alias("class"), F.posexplode(F.flatten(F.transform("GenericAttributes", lambda g: g["GenericAttribute"]))).alias("pos", "a"))
    empty = F.coalesce(F.trim("a._Value"), F.lit("")) == ""
    n = F.row_number().over(Window.partitionBy("file", "id", "a._Name").orderBy("pos"))
    claims = rows.where(~empty).withColumn("n", n).select("file", "id", "tag", "class", F.when(F.col("n") > 1, F.concat("a._Name", F.lit("#"), "n")).otherwise(F.col("a._Name")).alias("name"), F.col("a._Value").alias("value"), F.col("a._Units").alias("uom"))
    return claims, rows.where(empty).groupBy("file").agg(F.count("*").alias("empty"))


def chain_edges(segments: DataFrame) -> DataFrame:
    """``segments(file, segment, from, items, to)`` as directed edges between neighbours of each chain; an end that is missing is kept as null."""
    chain = segments.select("file", "segment", F.posexplode(F.concat(F.array("from"), F.coalesce("items", F.array().cast("array<string>")), F.array("to"))).alias("pos", "a"))
    order = Window.partitionBy("file", "segment").orderBy("pos")
    return chain.withColumn("b", F.lead("a").over(order)).withColumn("_n", F.lead("pos").over(order)).where("_n is not null").drop("_n", "pos")


def broken_references(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Ends that name no element of their file."""
    ends = edges.select("file", F.col("a").alias("id")).unionByName(edges.select("file", F.col("b").alias("id"))).where("id is not null").distinct()
    return ends.join(elements.select("file", "id"), ["file", "id"], "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest of each file; line ends of text are made one, members of an archive are hashed in name order."""
    raw = spark.read.format("binaryFile").load(path)

    def archive(batches):
        import hashlib
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for content in b["content"]:
                total = hashlib.sha256()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        total.update(name.encode() + b"\0" + hashlib.sha256(z.read(name)).digest())
                out.append(total.hexdigest())
            yield pd.DataFrame({"path": b["path"], "sha256": out})

    zips = raw.where(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(archive, "path string, sha256 string")
    plain = raw.where(~F.lower("path").endswith(".zip")).select("path", F.sha2(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n").cast("binary"), 256).alias("sha256"))
    return plain.unionByName(zips)


def flowsheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flowsheet JSON ``{"model": {"unit_models": {name: {"type"}}, "arcs": {name: {"source", "dest"}}}}`` as units and streams.

    A feed or product unit is the battery limit.
    """
    schema = "model struct<unit_models:map<string,struct<type:string>>,arcs:map<string,struct<source:string,dest:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    units = raw.select("file", F.explode_outer("model.unit_models").alias("unit", "u")).select("file", "unit", F.col("u.type").alias("type"), F.lower("u.type").rlike("feed|product").alias("limit")).where("unit is not null")
    arcs = raw.select("file", F.explode_outer("model.arcs").alias("stream", "s")).select("file", "stream", F.col("s.source").alias("source"), F.col("s.dest").alias("dest")).where("stream is not null")
    ends = units.where("limit").select("file", F.col("unit").alias("_u"), F.lit("battery limit").alias("_l"))
    one = arcs.join(ends, (arcs["file"] == ends["file"]) & (arcs["source"] == ends["_u"]), "left").select(arcs["file"], "stream", F.coalesce("_l", "source").alias("source"), "dest")
    two = one.join(ends, (one["file"] == ends["file"]) & (one["dest"] == ends["_u"]), "left").select(one["file"], "stream", "source", F.coalesce("_l", "dest").alias("dest"))
    return units, two


def loop_list(functions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete and incomplete loops from ``functions(file, loop)`` and ``members(file, loop, id, role, tag)``; the first tag of a role by id."""
    pick = lambda role: F.min_by(F.when(F.col("role") == role, F.col("tag")), F.when(F.col("role") == role, F.col("id")))
    per = functions.join(members, ["file", "loop"], "left").groupBy("file", "loop").agg(*[pick(r).alias(r) for r in ("controller", "measurement", "output")])
    whole: Column = F.col("controller").isNotNull() & F.col("measurement").isNotNull() & F.col("output").isNotNull()
    return per.where(whole), per.where(~whole)
