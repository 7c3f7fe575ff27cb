"""Normal bands and alarm rules over long readings.

Readings have the columns run, tag, row_no, ts, value; a null value is a bad
sample. A run and tag make one series: windows and groups use both, so series
spread over the cluster. Bands, K tables and profiles have a row per series or
slot and stay DataFrames; Spark broadcasts them while they are small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scans
from millrace.operators.scans import AT, CHUNK, OWN, SPELL
from millrace.scratch import written

SERIES = ["run", "tag"]
KS = (3, 4, 5, 6)
DRIFT_KS = (10, 12, 15, 20)
TARGET = 0.005  # largest false-flag rate of the worst tag on held-out rows
RUN = 3  # flags in a row that make an alarm
FAST, SLOW = 10, 600  # samples of the two averages
FLOOR = 0.01  # least half-width of a gap band as a share of the mean
SCALE_MIN = 0.5
SLOTS = 48
SLOT_LEAST = 3
MIN_ROWS = 30


def micros(ts: Column | str) -> Column:
    """Microseconds of a time with or without a zone; one without is read in the session's."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def numbered(readings: DataFrame, *by: str) -> DataFrame:
    """Row numbers from 0 within a series, in the order of ``by``, whose first is a time or a number."""
    return scans.numbered(readings, SERIES, list(by), "row_no")


def split(readings: DataFrame) -> DataFrame:
    """``part``: fit for the first half of each series, held for the rest."""
    n = readings.groupBy(*SERIES).agg(F.count("*").alias("_n"))
    return scans.beside(readings, n, SERIES).withColumn("part", F.when(F.col("row_no") < F.floor(F.col("_n") / 2), "fit").otherwise("held")).drop("_n")


# ---- level bands


def band_stats(readings: DataFrame) -> DataFrame:
    """Mean, population sd, and numbers of good and bad samples of each series; none without a good value."""
    return readings.groupBy(*SERIES).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        F.count("value").alias("fit_good"),
        F.count_if(F.col("value").isNull()).alias("fit_bad"),
    ).where("fit_good > 0")


def bands(stats: DataFrame, k: Column | float) -> DataFrame:
    """Lo and hi at K; a constant series gets the least width, so any change flags it."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    sd = F.when(F.col("sd") == 0, F.lit(1e-9)).otherwise(F.col("sd"))
    return stats.withColumn("k", k).withColumns({"lo": F.col("mean") - F.col("k") * sd, "hi": F.col("mean") + F.col("k") * sd, "constant_in_fit": F.col("sd") == 0})


def band_flags(readings: DataFrame, band: DataFrame) -> DataFrame:
    """Flag where a value is strictly outside its band; bad samples and series without a band never flag."""
    own = band.select(*SERIES, "lo", "hi")
    return readings.join(own, SERIES, "left").withColumn("flag", F.coalesce((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.lit(False)))


def k_table(fit: DataFrame, held: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per run and K the worst, mean and any-tag flag rates on held-out rows.

    A reading is compared with all K at once: the K columns are counted in one pass.
    Rows of a run line up by row_no.
    """
    sd = F.when(F.col("sd") == 0, F.lit(1e-9)).otherwise(F.col("sd"))
    away = F.abs(F.col("value") - F.col("mean")) / sd
    own = held.join(band_stats(fit).select(*SERIES, "mean", "sd"), SERIES, "left").select("run", "tag", "row_no", F.explode(F.array(*map(F.lit, ks))).alias("k"), F.coalesce(away > F.col("k"), F.lit(False)).alias("flag"))
    return _rates(own)


def _rates(own: DataFrame) -> DataFrame:
    """Per run and K of ``own(run, tag, row_no, k, flag)`` the worst, mean and any-tag rates; the first tag wins a tie."""
    tags = own.groupBy("run", "k", "tag").agg(F.avg(F.col("flag").cast("int")).alias("rate"))
    rows = own.groupBy("run", "k", "row_no").agg(F.max("flag").alias("any")).groupBy("run", "k").agg(F.avg(F.col("any").cast("int")).alias("any_tag_rate"))
    worst = tags.groupBy("run", "k").agg(F.max("rate").alias("worst_tag_rate"), F.avg("rate").alias("mean_tag_rate"))
    first = tags.join(worst, ["run", "k"]).where("rate = worst_tag_rate").groupBy("run", "k").agg(F.min("tag").alias("worst_tag"))
    return worst.join(first, ["run", "k"]).join(rows, ["run", "k"])


def chosen_k(table: DataFrame, target: float = TARGET) -> DataFrame:
    """The smallest K whose worst-tag rate is under the target, else the largest."""
    return table.groupBy("run").agg(
        F.coalesce(F.min(F.when(F.col("worst_tag_rate") < target, F.col("k"))), F.max("k")).alias("k"),
        F.coalesce(F.max(F.col("worst_tag_rate") < target), F.lit(False)).alias("target_met"),
    )


# ---- runs of flags


def alarm_runs(flags: DataFrame, least: int = RUN, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per unbroken run of at least ``least`` flagged rows: first_row, last_row, samples.

    Flagged rows form a run until a row_no is left out.
    """
    keys = keys or SERIES
    flagged = flags.where("flag").select(*keys, "row_no")
    before = F.lag("row_no").over(scans.inside(keys, ["row_no"]))
    begins = before.isNull() | (F.col("row_no") != before + 1)
    sums = [F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.count("*").alias("samples")]
    again = [F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("samples").alias("samples")]
    return scans.runs(flagged, keys, "row_no", begins, scans.by_rows(chunk=chunk), sums, again).where(F.col("samples") >= least).drop("_run")


def states(readings: DataFrame, state: str, chunk: int = CHUNK) -> DataFrame:
    """Unbroken spells of one state, missing readings inside a spell ignored."""
    seen = readings.where(F.col(state).isNotNull()).select(*SERIES, "row_no", "ts", F.col(state).alias("state"))
    begins = F.coalesce(F.lag("state").over(scans.inside(SERIES, ["row_no"])) != F.col("state"), F.lit(True))
    sums = [F.first("state").alias("state"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("samples")]
    again = [F.first("state").alias("state"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"), F.sum("samples").alias("samples")]
    return scans.runs(seen, SERIES, "row_no", begins, scans.by_rows(chunk=chunk), sums, again).withColumnRenamed("_run", "spell")


def onsets(flags: DataFrame, start: int, chunk: int = CHUNK) -> DataFrame:
    """The state at row ``start`` and the first change from 0 to 1 after it, per series."""
    near = scans.with_neighbours(flags.select(*SERIES, "row_no", "flag"), SERIES, ["row_no"], scans.by_rows(chunk=chunk), 1)
    before = F.lag("flag").over(scans.inside(SERIES, ["row_no"]))
    marked = near.withColumn("rises", F.coalesce(~before & F.col("flag") & (F.col("row_no") > start), F.lit(False))).where(OWN)
    return marked.groupBy(*SERIES).agg(F.max(F.when(F.col("row_no") == start, F.col("flag"))).alias("at_start"), F.min(F.when(F.col("rises"), F.col("row_no"))).alias("onset_row"))


def first_flags(flags: DataFrame, fault_row: int) -> DataFrame:
    """First flag at or after the fault row, its delay in seconds, and flagged shares before and after."""
    after, before = F.col("row_no") >= fault_row, F.col("row_no") < fault_row
    hit = flags.groupBy(*SERIES).agg(
        F.min(F.when(after & F.col("flag"), F.col("row_no"))).alias("first_row"),
        F.min(F.when(F.col("row_no") == fault_row, F.col("ts"))).alias("fault_ts"),
        F.min(F.when(after & F.col("flag"), F.col("ts"))).alias("first_ts"),
        F.count_if(before & F.col("flag")).alias("flagged_before"),
        F.avg(F.when(after, F.col("flag").cast("int"))).alias("rate_after"),
    )
    return hit.select(*SERIES, "first_row", (micros("first_ts") - micros("fault_ts")).alias("delay_us"), "flagged_before", "rate_after")


def first_tags(flags: DataFrame, fault_row: int, most: int = 3) -> DataFrame:
    """The first tags of a run to flag, by row and tag."""
    hit = first_flags(flags, fault_row).where("first_row is not null")
    place = F.row_number().over(Window.partitionBy("run").orderBy("first_row", "tag"))
    return hit.withColumn("place", place).where(F.col("place") <= most).select("run", "place", "tag", "first_row")


def out_of_order(readings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows whose time is not after the one before, with both times."""
    near = scans.with_neighbours(readings.select(*SERIES, "row_no", "ts"), SERIES, ["row_no"], scans.by_rows(chunk=chunk), 1)
    before = F.lag("ts").over(scans.inside(SERIES, ["row_no"]))
    return near.withColumn("before_ts", before).where(OWN).where(F.col("ts") <= F.col("before_ts")).select(*SERIES, "row_no", "before_ts", "ts")


def at_or_after(readings: DataFrame, moment: Column) -> DataFrame:
    """The first row of each series at or after a moment."""
    return readings.groupBy(*SERIES).agg(F.min(F.when(F.col("ts") >= moment, F.col("row_no"))).alias("fault_row"))


def nearest(readings: DataFrame, moments: DataFrame, spell: int = SPELL) -> DataFrame:
    """For each of ``moments(run, tag, at)`` the nearest good reading, the earlier one on a tie.

    Both tables are merged in time order in chunks of ``spell`` microseconds;
    the good readings around a moment are carried to it, those of other chunks
    by a table with a row a chunk, so no moment is paired with all readings.
    """
    good = readings.where("value is not null").select(*SERIES, F.col("ts").alias("t"), F.struct("ts", "value").alias("reading"), F.lit(None).cast(readings.schema["ts"].dataType).alias("at"))
    asked = moments.select(*SERIES, F.col("at").alias("t"), F.lit(None).cast(good.schema["reading"].dataType).alias("reading"), "at")
    merged = good.unionByName(asked).withColumn(AT, F.floor(micros("t") / spell))
    chunks = merged.groupBy(*SERIES, AT).agg(F.min("reading").alias("_low"), F.max("reading").alias("_high"))
    around = Window.partitionBy(*SERIES).orderBy(AT)
    edges = chunks.select(*SERIES, AT, F.last("_high", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"), F.first("_low", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"))
    order = Window.partitionBy(*SERIES, AT).orderBy("t", F.col("at").isNotNull())
    back = F.last("reading", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("reading", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = merged.withColumns({"back": back, "ahead": ahead}).where("at is not null")
    both = scans.beside(both, edges, [*SERIES, AT])
    both = both.withColumns({"back": F.coalesce("back", "_back"), "ahead": F.coalesce("ahead", "_ahead")})
    gap = lambda c: F.abs(micros("at") - micros(f"{c}.ts"))
    pick = F.when(F.col("ahead").isNull() | (gap("back") <= gap("ahead")), F.col("back")).otherwise(F.col("ahead"))
    return both.select(*SERIES, "at", pick["ts"].alias("ts"), pick["value"].alias("value"))


def statement_checks(rows: DataFrame, statements: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Whether timeline statements hold; ``(run, statement, got_ts, value, minutes_off, ok)``.

    ``rows(run, tag, row_no, ts, value, state)`` and ``statements(statement,
    tag, test, state, after, expect, tolerance_min, drop)``. A test is ``leave``
    (the first row after a row of ``state`` that has another one), ``enter`` (the
    first row of the state), ``peak`` (the first value above the one before it
    that is followed by one lower by ``drop`` or more) or ``never`` (no row of
    the state; the value is then the greatest). Rows from ``after`` on count
    (all rows if null), and so does the row before. Missing states and values
    are passed over. A statement without a hit fails, but for ``never``; with
    ``expect`` the hit must lie within the tolerance. Every run with a row of
    the statement's tag gets a row.
    """
    own = rows.select(*SERIES, "row_no", "ts", F.col("value").cast("double").alias("value"), "state")
    order = scans.inside(SERIES, ["row_no"])
    around = lambda column, after: scans.with_neighbours(own.where(F.col(column).isNotNull()), SERIES, ["row_no"], scans.by_rows(chunk=chunk), 1, after)
    stated = around("state", 0).withColumns({"was": F.lag("state").over(order), "was_ts": F.lag("ts").over(order)}).where(OWN)
    valued = around("value", 1).withColumns({"prev": F.lag("value").over(order), "was_ts": F.lag("ts").over(order), "next": F.lead("value").over(order)}).where(OWN)
    s = statements.select("statement", F.col("tag").alias("of_tag"), "test", F.col("state").alias("asked"), "after", "expect", "tolerance_min", F.col("drop").alias("fall"))
    since = lambda ts: F.coalesce(F.col(ts) >= F.col("after"), F.col("after").isNull())
    changes = stated.join(s, F.col("tag") == F.col("of_tag")).where(
        ((F.col("test") == "leave") & (F.col("was") == F.col("asked")) & (F.col("state") != F.col("asked")) & since("was_ts"))
        | ((F.col("test") == "enter") & (F.col("state") == F.col("asked")) & since("ts"))
        | ((F.col("test") == "never") & (F.col("state") == F.col("asked")))
    )
    peaks = valued.join(s, F.col("tag") == F.col("of_tag")).where((F.col("test") == "peak") & (F.col("value") > F.col("prev")) & (F.col("value") >= F.col("next") + F.col("fall")) & since("was_ts"))
    hits = changes.select("run", "statement", "ts", "value").unionByName(peaks.select("run", "statement", "ts", "value"))
    first = hits.groupBy("run", "statement").agg(F.min(F.struct("ts", "value")).alias("hit"))
    tops = own.groupBy(F.col("run").alias("of_run"), "tag").agg(F.max("value").alias("top"))
    every = tops.join(s, F.col("tag") == F.col("of_tag")).join(first.withColumnRenamed("statement", "hit_of"), (F.col("of_run") == F.col("run")) & (F.col("statement") == F.col("hit_of")), "left")
    off = (micros("hit.ts") - micros("expect")) / 60e6
    never = F.col("test") == "never"
    ok = F.when(never, F.col("hit").isNull()).otherwise(F.coalesce(F.col("hit").isNotNull() & F.coalesce(F.abs(off) <= F.col("tolerance_min"), F.col("expect").isNull()), F.lit(False)))
    value = F.when(never, F.col("top")).when(F.col("test") == "peak", F.col("hit.value"))
    return every.select(F.col("of_run").alias("run"), "statement", F.col("hit.ts").alias("got_ts"), value.alias("value"), F.round(off, 1).alias("minutes_off"), ok.alias("ok"))


# ---- false alarms


def false_alarms(flags: DataFrame, sample_seconds: float) -> DataFrame:
    """Flag rate, events a day, the rule-of-three bound where nothing flagged, and chance events in 40 hours, per run."""
    events = alarm_runs(flags).groupBy("run").agg(F.count("*").alias("events"))
    runs = flags.groupBy("run").agg(F.count("*").alias("samples"), F.count_if("flag").alias("flagged"))
    hours = F.col("samples") * sample_seconds / 3600
    out = runs.join(events, "run", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return out.select(
        "run", "samples", "flagged", "events",
        (F.col("flagged") / F.col("samples")).alias("flag_rate"),
        (F.col("events") / (hours / 24)).alias("events_per_day"),
        F.when(F.col("flagged") == 0, F.lit(3.0) / F.col("samples")).otherwise(F.col("flagged") / F.col("samples")).alias("rate_bound"),
        (F.col("events") / hours * 40).alias("events_40h"),
    )


def sample_warnings(readings: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Series with few good fit or held-out samples, or a constant fit."""
    parts = split(readings).groupBy(*SERIES).agg(
        F.count(F.when(F.col("part") == "fit", F.col("value"))).alias("n_fit"),
        F.count(F.when(F.col("part") == "held", F.col("value"))).alias("n_held"),
        F.coalesce(F.stddev_pop(F.when(F.col("part") == "fit", F.col("value"))), F.lit(0.0)).alias("sd"),
    )
    said = F.array_compact(F.array(F.when(F.col("n_fit") < least, "few fit samples"), F.when(F.col("n_held") < least, "few held-out samples"), F.when(F.col("sd") == 0, "constant in fit")))
    return parts.withColumn("warnings", F.array_join(said, "; ")).where("warnings <> ''").drop("sd")


# ---- time of day


def day_slot(ts: Column, slots: int = SLOTS) -> Column:
    """the slot of the day, from 0."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor(second * slots / 86400).cast("int")


def slot_profile(readings: DataFrame, least: int = SLOT_LEAST) -> DataFrame:
    """Mean of each series and slot with at least ``least`` good values, with the series mean."""
    good = readings.where("value is not null")
    slots = good.groupBy(*SERIES, day_slot(F.col("ts")).alias("slot")).agg(F.avg("value").alias("slot_mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    means = good.groupBy(*SERIES).agg(F.avg("value").alias("mean"))
    return means.join(slots, SERIES, "left")


def residuals(readings: DataFrame, profile: DataFrame) -> DataFrame:
    """Each value minus its slot's mean, or the series mean where the slot has none."""
    means = profile.select(*SERIES, "mean").distinct()
    slots = profile.where("slot is not null").select(*SERIES, "slot", "slot_mean")
    joined = readings.withColumn("slot", day_slot(F.col("ts"))).join(means, SERIES, "left").join(slots, [*SERIES, "slot"], "left")
    return joined.withColumn("residual", F.col("value") - F.coalesce("slot_mean", "mean"))


def daily_cycle(fit: DataFrame, held: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Per series the share of held-out variation a time-of-day profile explains, both levels removed.

    All rows are used; sums of centred squares come from moments.
    """
    joined = residuals(held, slot_profile(fit)).where("residual is not null")
    p = F.col("value") - F.col("residual")
    moments = joined.groupBy(*SERIES).agg(F.count("*").alias("n"), F.var_pop("value").alias("vv"), F.var_pop(F.col("value") - p).alias("rr"))
    return moments.where((F.col("n") >= least) & (F.col("vv") > 0)).select(*SERIES, "n", (1 - F.col("rr") / F.col("vv")).alias("r2"))


def method_choice(readings: DataFrame, least_days: float = 2.0, least_r2: float = 0.1, least: int = MIN_ROWS) -> DataFrame:
    """Cyclic where the fit rows span enough days and the median series shows a daily cycle, else drift; per run."""
    parts = split(readings)
    fit, held = parts.where("part = 'fit'"), parts.where("part = 'held'")
    span = fit.groupBy("run").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / 86400e6).alias("fit_days"))
    r2 = daily_cycle(fit, held, least).groupBy("run").agg(F.median("r2").alias("r2"))
    cyclic = (F.col("fit_days") >= least_days) & (F.coalesce("r2", F.lit(-1.0)) >= least_r2)
    return span.join(r2, "run", "left").withColumn("method", F.when(cyclic, "cyclic").otherwise("drift"))


# ---- drift


def median3(readings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Median of a good value and the two good ones before it; the first two pass through."""
    good = scans.with_neighbours(readings.where("value is not null"), SERIES, ["row_no"], scans.by_rows(chunk=chunk), 2)
    last = F.array_sort(F.collect_list("value").over(scans.inside(SERIES, ["row_no"]).rowsBetween(-2, 0)))
    out = good.withColumn("median3", F.when(F.size(last) == 3, F.element_at(last, 2)).otherwise(F.col("value"))).where(OWN).select(*readings.columns, "median3")
    bad = readings.where("value is null").withColumn("median3", F.lit(None).cast("double"))
    return out.unionByName(bad)


EARLY = 1024


def averages(x: np.ndarray, n: np.ndarray, span: int, start: float) -> tuple[np.ndarray, np.ndarray]:
    """The average before and after each sample: the n-th has weight max(1/span, 1/n).

    The first samples, whose weights fall, are walked; the others, of one
    weight, are summed a short stretch at a time.
    """
    after, early = np.empty(len(x)), int(np.searchsorted(n, max(EARLY, span), side="right"))
    at = float(start)
    for i, (v, m) in enumerate(zip(x[:early].tolist(), n[:early].tolist(), strict=True)):
        at += max(1.0 / span, 1.0 / m) * (v - at)
        after[i] = at
    if span == 1:
        after[early:] = x[early:]
    else:
        kept = (1 - 1.0 / span) ** np.arange(1, 65)
        for i in range(early, len(x), 64):
            own = kept[: len(x) - i]
            after[i : i + 64] = own * (at + np.cumsum(x[i : i + 64] / own) / span)
            at = after[min(i + 64, len(x)) - 1]
    return np.concatenate([[start], after[:-1]]), after


def drift_gaps(readings: DataFrame, fast: int = FAST, slow: int = SLOW, chunk: int = CHUNK, of: str = "value") -> DataFrame:
    """Fast average of ``of`` minus the slow baseline one sample earlier (``gap``), and that baseline (``level``).

    Both averages start as running averages: the n-th good sample has weight
    max(1/T, 1/n). Bad samples keep their row, with neither gap nor level, and
    so does the first good one. A step is an affine map of the average, and
    maps compose, so a long series is cut into chunks of row numbers: the good
    samples before each chunk are counted, each chunk's map is made, the
    averages at its start follow from the maps before it, and it is replayed.
    Only tables with a row per chunk are walked in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in readings.schema.fields}
    head = f"run {kinds['run']}, tag {kinds['tag']}, chunk long"
    cut = readings.select(*SERIES, "row_no", "value", F.col(of).cast("double").alias("of"), F.floor(F.col("row_no") / chunk).cast("long").alias("chunk"))
    whole = Window.partitionBy(*SERIES)
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*SERIES, "chunk").agg(F.count("of").alias("goods")).withColumns({"before": F.coalesce(F.sum("goods").over(earlier), F.lit(0)), "chunks": F.count("*").over(whole)}).drop("goods")
    good = cut.where("of is not null").join(counts, [*SERIES, "chunk"])

    def maps(rows: pa.Table) -> pa.RecordBatch:
        n = rows["before"][0].as_py() + 1.0 + np.arange(len(rows))
        out = {name: rows[name].combine_chunks().slice(0, 1) for name in ("run", "tag", "chunk")}
        for name, span in (("f", fast), ("s", slow)):
            # The map of the whole chunk: what it makes of nought, and how much of a start it keeps.
            made = float(np.prod(1 - np.maximum(1.0 / span, 1.0 / n))), float(averages(rows["of"].to_numpy(), n, span, 0.0)[1][-1])
            out |= {f"a_{name}": pa.array([made[0]]), f"b_{name}": pa.array([made[1]])}
        return pa.RecordBatch.from_pydict(out)

    # A series of one chunk begins at nought and needs no map.
    mapped = scans.by_chunks(good.where("chunks > 1").drop("chunks"), [*SERIES, "chunk"], "row_no", maps, f"{head}, a_f double, b_f double, a_s double, b_s double")

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        out = {}
        for name in "fs":
            at, kept = 0.0, []
            for a, b in zip(rows[f"a_{name}"].tolist(), rows[f"b_{name}"].tolist(), strict=True):
                kept.append(at)
                at = a * at + b
            out[f"start_{name}"] = kept
        return rows[["run", "tag", "chunk"]].assign(**out)

    begun = mapped.groupBy(*SERIES).applyInPandas(starts, f"{head}, start_f double, start_s double")

    def replay(rows: pa.Table) -> pa.RecordBatch:
        x, n = rows["of"].to_numpy(), rows["before"][0].as_py() + 1.0 + np.arange(len(rows))
        level = averages(x, n, slow, rows["start_s"][0].as_py())[0]
        gap = averages(x, n, fast, rows["start_f"][0].as_py())[1] - level
        first = n <= 1
        out = {name: rows[name].combine_chunks() for name in ("run", "tag", "row_no", "value")}
        return pa.RecordBatch.from_pydict(out | {"gap": pa.array(gap, mask=first), "level": pa.array(level, mask=first)})

    nought = {name: F.coalesce(name, F.lit(0.0)) for name in ("start_f", "start_s")}
    joined = good.join(begun, [*SERIES, "chunk"], "left").withColumns(nought).withColumn("value", F.col("value").cast("double")).drop("chunks")
    out = scans.by_chunks(joined, [*SERIES, "chunk"], "row_no", replay, f"run {kinds['run']}, tag {kinds['tag']}, row_no {kinds['row_no']}, value double, gap double, level double")
    none = F.lit(None).cast("double")
    return out.unionByName(cut.where("of is null").select(*SERIES, "row_no", F.col("value").cast("double").alias("value"), none.alias("gap"), none.alias("level")))


def cyclic_gaps(readings: DataFrame, profile: DataFrame, fast: int = FAST, slow: int = SLOW, chunk: int = CHUNK) -> DataFrame:
    """The drift gaps of what a time-of-day ``profile`` leaves of the readings, after a median of three.

    ``value`` stays the reading, from which a band's floor is taken.
    """
    left = residuals(readings, profile).select(*SERIES, "row_no", F.col("value").alias("reading"), F.col("residual").alias("value"))
    return drift_gaps(median3(left).select(*SERIES, "row_no", F.col("reading").alias("value"), "median3"), fast, slow, chunk, of="median3")


def drift_stats(gaps: DataFrame) -> DataFrame:
    """Level and gap statistics of each series; none without a gap."""
    return gaps.groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("resid_sd"), F.count("gap").alias("n_gaps")).where("n_gaps > 0").withColumn("floor", FLOOR * F.abs("mean"))


def drift_bands(stats: DataFrame, k: Column | float) -> DataFrame:
    """Half-width of a gap band, the wider of K sd and the floor."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    half = F.greatest(k * F.col("resid_sd"), F.col("floor"))
    return stats.withColumn("half_width", F.when(half == 0, k * 1e-9).otherwise(half)).withColumn("limited_by", F.when(F.col("floor") >= k * F.col("resid_sd"), "floor").otherwise("spread"))


def level_scale(level: Column, mean: Column, least: float = SCALE_MIN) -> Column:
    """The share of its normal width that a band keeps at a level."""
    return F.when(mean == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(least), F.abs(level) / F.abs(mean))))


def drift_flags(gaps: DataFrame, band: DataFrame, follow_level: bool = True, k: Column | None = None) -> DataFrame:
    """Flag where a gap leaves its band, the band scaled by the level it was taken at; with ``k``, bands are made of the statistics ``band`` at each row's K."""
    own = band.select(*SERIES, "mean", "gap_mean", "half_width") if k is None else band.select(*SERIES, "mean", "gap_mean", "resid_sd", "floor")
    joined = gaps.join(own, SERIES, "left")
    joined = joined if k is None else drift_bands(joined, k)
    r = level_scale(F.col("level"), F.col("mean")) if follow_level else F.lit(1.0)
    return joined.withColumn("flag", F.coalesce(F.abs(F.col("gap") - F.col("gap_mean") * r) > F.col("half_width") * r, F.lit(False)))


def drift_k_table(stats: DataFrame, held: DataFrame, ks: tuple[int, ...] = DRIFT_KS, follow_level: bool = True) -> DataFrame:
    """Per run and K the worst, mean and any-tag flag rates of the held-out gaps ``held``; all K in one pass."""
    flagged = drift_flags(held.select(*SERIES, "row_no", "gap", "level", F.explode(F.array(*map(F.lit, ks))).alias("k")), stats, follow_level, k=F.col("k"))
    return _rates(flagged)


def chosen_drift_k(table: DataFrame, target: float = TARGET) -> DataFrame:
    """The smallest K at which the share of rows with any tag flagged is under the target, else the largest."""
    met = F.col("any_tag_rate") < target
    return table.groupBy("run").agg(F.coalesce(F.min(F.when(met, F.col("k"))), F.max("k")).alias("k"), F.coalesce(F.max(met), F.lit(False)).alias("target_met"))


def fitted_gaps(readings: DataFrame, method: str, ks: tuple[int, ...] = DRIFT_KS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit ``method`` (drift or cyclic) on the first half of each series and choose K on the rest.

    The result: the held-out gaps with their flags, the choice of K per run,
    and the bands. The averages of the held-out part start anew, as those of
    an export of its own.
    """
    parts = split(readings)
    fit, held = parts.where("part = 'fit'"), parts.where("part = 'held'")
    profile = written(slot_profile(fit), "profile") if method == "cyclic" else None
    gaps = (lambda x: drift_gaps(x)) if profile is None else (lambda x: cyclic_gaps(x, profile))
    stats, later = written(drift_stats(gaps(fit)), "gap-stats"), written(gaps(held), "gaps")
    choice = written(chosen_drift_k(drift_k_table(stats, later, ks, profile is None)), "choice")
    band = drift_bands(stats.join(choice, "run"), F.col("k"))
    return drift_flags(later, band, profile is None), choice, band
