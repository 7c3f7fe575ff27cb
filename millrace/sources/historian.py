"""Historian exports and record files as DataFrames.

Every scan takes a folder or a pattern, so one job reads a corpus of files.
What a strict reader would refuse becomes rows of a findings table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import written


def number(raw: Column) -> Column:
    """A finite number, or null for blank, text, nan and inf: a bad sample."""
    v = F.try_cast(raw, "double") if hasattr(F, "try_cast") else raw.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(v)


def clock(raw: Column) -> Column:
    """A timestamp from ISO text; null for anything else."""
    return raw.try_cast("timestamp")


def _lines(spark: SparkSession, path: str, heads: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines of all files, and a written table with a row for each split that has lines: where its first is in its file, and how many that are not blank its file has.

    With ``heads`` also its first line that is not blank; a text among counts has Spark sort the lines of a split.
    """
    order = [F.col("_metadata.file_path").alias("run"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(*order, F.regexp_replace("value", "^\ufeff|\r$", "").alias("line")).withColumn("full", F.col("line").rlike(r"[^\s,;\"]"))
    counts = lines.groupBy("run", "block").agg(F.min("at").alias("first"), F.count_if("full").alias("rows"), F.count_if(~F.col("full")).alias("blanks"), *([F.min_by("line", F.when(F.col("full"), F.col("at"))).alias("head")] if heads else []))
    before = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    whole = F.sum("rows").over(Window.partitionBy("run"))
    return lines, written(counts.withColumns({"start": F.coalesce(F.sum("rows").over(before), F.lit(0)), "of": whole}), "splits")


def _placed(lines: DataFrame, starts: DataFrame) -> DataFrame:
    placed = lines.join(starts.drop("head"), ["run", "block"])
    plain = placed.where("blanks = 0").select("run", (F.col("start") + F.col("at") - F.col("first")).alias("position"), "line", "of")
    inside = F.row_number().over(Window.partitionBy("run", "block").orderBy("at"))
    gaps = placed.where((F.col("blanks") > 0) & F.col("full")).select("run", (F.col("start") + inside - 1).alias("position"), "line", "of")
    return plain.unionByName(gaps)


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """``run, position, line``: the lines of each file that are not blank, numbered from 0.

    Files stay splittable: lines are counted by (file, split), the splits of a
    file add up to where each begins, and a line's number follows from its
    place in its split. Only splits with blank lines are numbered by a window.
    """
    return _placed(*_lines(spark, path)).drop("of")


def cells(line: Column, sep: str = ",") -> Column:
    """The trimmed cells of a CSV line; quotes may hold the separator, and twice a quote is one."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{s}("(?:[^"]|"")*"[^{s}]*|[^{s}]*)'), F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.regexp_extract(x, r'^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).otherwise(x)))


def wide_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``run, row_no, header, cells, open``: each data row of each file with the header of its own file; row_no is -1 for a header without rows.

    Headers are kept when the splits are counted and written with a row a
    split, so Spark sees how small they are and sends them to the lines; the
    lines stay where they were read.
    """
    lines, starts = _lines(spark, path, heads=True)
    heads = starts.where("start = 0 and rows > 0").select("run", cells(F.col("head"), sep).alias("header"))
    data = _placed(lines, starts).where("position > 0").select("run", (F.col("position") - 1).alias("row_no"), cells(F.col("line"), sep).alias("cells"), (F.regexp_count("line", F.lit('"')) % 2 == 1).alias("open"))
    bare = starts.groupBy("run").agg(F.sum("rows").alias("rows")).where("rows = 1").join(heads, "run")
    alone = bare.select("run", F.lit(-1).cast("long").alias("row_no"), "header", F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("boolean").alias("open"))
    return data.join(heads, "run").select("run", F.col("row_no").cast("long").alias("row_no"), "header", "cells", "open").unionByName(alone)


def wide_csv(spark: SparkSession, path: str, sep: str = ",", skip: tuple[str, ...] = ()) -> DataFrame:
    """Wide files (time, tag...) as ``run, row_no, idx, ts, tag, tag_pos, raw, value``; a run is a file.

    Each file is read by its own header, so files may name their tags in
    different orders. The first column is a number (idx) or a timestamp (ts).
    Rows that do not have a cell for each name are left out here; they and all
    else that a strict reader refuses are rows of ``wide_findings``.
    """
    fit = wide_rows(spark, path, sep).where((F.col("row_no") >= 0) & (F.size("cells") == F.size("header")))
    long = fit.select("run", "row_no", F.col("cells")[0].alias("_t"), F.posexplode(F.arrays_zip(F.slice("header", 2, F.size("header")).alias("tag"), F.slice("cells", 2, F.size("cells")).alias("raw"))).alias("tag_pos", "x"))
    own = long.where(~F.col("x.tag").isin(*skip)) if skip else long
    stamp = F.when(number(F.col("_t")).isNull(), clock(F.col("_t")))
    return own.select("run", "row_no", number(F.col("_t")).alias("idx"), stamp.alias("ts"), F.col("x.tag").alias("tag"), "tag_pos", F.col("x.raw").alias("raw"), number(F.col("x.raw")).alias("value"))


def header_problems(header: Column) -> Column:
    """What is wrong with a header: fewer than two columns, empty, numeric and repeated tag names."""
    tags = F.slice(header, 2, F.greatest(F.size(header), F.lit(1)))
    named = F.filter(tags, lambda t: t != "")
    found = F.array(
        F.when(F.size(header) < 2, F.lit("fewer than two columns")),
        F.when(F.exists(tags, lambda t: t == ""), F.lit("empty tag name")),
        F.when(F.exists(named, lambda t: t.try_cast("double").isNotNull()), F.lit("tag name is a number")),
        F.when(F.size(F.array_distinct(named)) < F.size(named), F.lit("repeated tag name")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def time_kind(raw: Column) -> Column:
    """The kind of a time: number, instant (with a zone), local (without one), or null."""
    stamp = F.when(raw.rlike(r"[T ].*(Z|[+-]\d\d:?\d\d)$"), "instant").otherwise("local")
    return F.when(number(raw).isNotNull(), "number").when(raw.rlike(r"^\d{4}-\d\d-\d\d") & clock(raw).isNotNull(), stamp)


def wide_findings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``run, row_no, finding``: what a strict reader refuses; row_no is null for what concerns a whole file."""
    rows = wide_rows(spark, path, sep)
    heads = rows.groupBy("run").agg(F.first("header").alias("header"), F.max("row_no").alias("last"))
    by_file = heads.select("run", F.explode(F.concat(header_problems(F.col("header")), F.when(F.col("last") < 0, F.array(F.lit("no data rows"))).otherwise(F.array().cast("array<string>")))).alias("finding"))
    data = rows.where("row_no >= 0").select("run", "row_no", "open", (F.size("cells") != F.size("header")).alias("ragged"), F.col("cells")[0].alias("t"))
    timed = data.withColumn("kind", time_kind(F.col("t"))).withColumn("at", F.coalesce(number(F.col("t")), F.unix_micros(clock(F.col("t"))) / 1e6))
    mixed = timed.where("kind is not null").groupBy("run").agg(F.count_distinct("kind").alias("n")).where("n > 1").select("run", F.lit("kinds or zones of time are mixed").alias("finding"))
    each = timed.select("run", "row_no", F.explode(F.filter(F.array(F.when(F.col("open"), F.lit("line break inside quotes")), F.when(F.col("ragged"), F.lit("cells do not fit the header")), F.when(F.col("kind").isNull(), F.lit("no time"))), lambda x: x.isNotNull())).alias("finding"))
    late = order_findings(timed.where("kind is not null").select("run", "row_no", F.col("at").alias("idx"), F.lit(None).cast("timestamp").alias("ts"))).where("finding = 'time does not rise'").select("run", "row_no", "finding")
    whole = by_file.unionByName(mixed).select("run", F.lit(None).cast("long").alias("row_no"), "finding")
    return whole.unionByName(each).unionByName(late)


def order_findings(readings: DataFrame) -> DataFrame:
    """Rows whose time is missing or not after the one before, a row each.

    A row meets the one before it by number, so a long run is not walked in one task.
    """
    key = F.coalesce(F.col("idx"), F.unix_micros("ts") / 1e6)
    rows = readings.select("run", "row_no", key.alias("at")).dropDuplicates(["run", "row_no"])
    last = rows.select("run", (F.col("row_no") + 1).alias("row_no"), F.col("at").alias("before"))
    marked = rows.join(last, ["run", "row_no"], "left")
    return marked.where(F.col("at").isNull() | (F.col("at") <= F.col("before"))).withColumn("finding", F.when(F.col("at").isNull(), "no time").otherwise("time does not rise"))


def matrix(spark: SparkSession, path: str, flipped_rows: int = 52) -> DataFrame:
    """Whitespace matrices as ``run, row_no, channel, value``; a file with ``flipped_rows`` rows is stored transposed.

    How many rows a file has is kept when its splits are counted, so cells are
    not shuffled to meet it.
    """
    rows = _placed(*_lines(spark, path))
    cell = rows.select("run", F.col("position").alias("r"), "of", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "raw"))
    flipped = F.col("of") == flipped_rows
    return cell.select("run", F.when(flipped, F.col("c")).otherwise(F.col("r")).alias("row_no"), F.when(flipped, F.col("r")).otherwise(F.col("c")).alias("channel"), number(F.col("raw")).alias("value"))


def _named(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``run, row_no, of``: each data row as a map from the names of its own file's header to its cells."""
    fit = wide_rows(spark, path, sep).where((F.col("row_no") >= 0) & (F.size("cells") == F.size("header")))
    return fit.select("run", "row_no", F.map_from_arrays("header", "cells").alias("of"))


def labelled_runs(spark: SparkSession, path: str, labels: tuple[str, ...] = ("anomaly", "changepoint"), sep: str = ";") -> DataFrame:
    """Per labelled run its rows and the first row of each label, null where a file has no such column."""
    first = [F.min(F.when(number(F.col("of")[c]) == 1, F.col("row_no"))).alias(f"first_{c}") for c in labels]
    return _named(spark, path, sep).groupBy("run").agg(F.count("*").alias("rows"), *first)


def label_events(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Unbroken spells of label 1 in (gzip) CSV files."""
    from millrace.operators.series import alarm_runs

    return alarm_runs(_named(spark, path, ",").withColumn("flag", F.coalesce(number(F.col("of")[label]) == 1, F.lit(False))), 1, ["run"])


def cycle_means(spark: SparkSession, path: str) -> DataFrame:
    """The mean of each line (cycle) of each sensor file."""
    values = F.filter(F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return file_rows(spark, path).select(F.col("run").alias("sensor"), F.col("position").alias("cycle"), (F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).alias("mean"))


def windows(readings: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of each window ``spans(name, a, b, fault)``, and whether they are at or after its fault.

    A row may be in several windows. The table of windows is a list of
    labelled failures; Spark broadcasts it while it is small.
    """
    joined = readings.join(spans, (F.col("ts") >= F.col("a")) & (F.col("ts") <= F.col("b")))
    return joined.withColumn("after_fault", F.col("ts") >= F.col("fault"))


def decimal_comma(raw: Column) -> Column:
    """A number written with a decimal comma."""
    return number(F.regexp_replace(raw, ",", "."))


def joined_on_time(tables: list[DataFrame], key: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Tables joined row by row on time, and the times that some table lacks."""
    out = tables[0].withColumn("_0", F.lit(1))
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumn(f"_{i}", F.lit(1)), key, "full")
    marks = [f"_{i}" for i in range(len(tables))]
    whole = F.lit(True)
    for m in marks:
        whole = whole & F.col(m).isNotNull()
    return out.where(whole).drop(*marks), out.where(~whole).select(key)


def row_offset(merged: DataFrame, raw: DataFrame, on: list[str]) -> DataFrame:
    """``merged, offset``: the only offset at which all rows of ``merged(merged, row_no, ...)`` equal rows of ``raw(row_no, ...)`` as text.

    ``merged`` names the merged file of a row. Each file proposes offsets by
    that row of its which is rarest in ``raw``; only rows at those offsets are
    compared. A file with rows that ``raw`` lacks, or with several fitting
    offsets, has none.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in on]).alias("h")
    a, b = written(merged.select("merged", F.col("row_no").alias("m"), key), "merged"), written(raw.select(F.col("row_no").alias("r"), key), "raw")
    rare = a.join(b.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("merged").agg(F.min(F.struct("n", "m", "h")).alias("x")).select("merged", "x.m", "x.h")
    tried = rare.join(b, "h").select("merged", (F.col("r") - F.col("m")).alias("offset"))
    sizes = a.groupBy("merged").agg(F.count("*").alias("n"))
    wanted = a.join(tried, "merged").select("merged", "offset", (F.col("m") + F.col("offset")).alias("r"), "h")
    fits = wanted.join(b, ["r", "h"]).groupBy("merged", "offset").agg(F.count("*").alias("n")).join(sizes, ["merged", "n"])
    return fits.groupBy("merged").agg(F.count("*").alias("k"), F.min("offset").alias("offset")).where("k = 1").select("merged", "offset")
