"""Recorded readings as streams, and alarm rules over them.

The batch operators refuse readings out of order. A stream cannot: rows are put
in order inside a step, and rows that are not after the last one of their
series are left out and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.series import FAST, RUN, SCALE_MIN, SLOW, averages, residuals
from millrace.scratch import drop_path, new_path


STORE = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a step at most, about: a step's cost is mostly its state store, so a few large ones are read.
STEP_ROWS = 8_000_000


def replay(spark: SparkSession, path: str, schema: Any, files_per_step: int = 1) -> DataFrame:
    """A folder of row slices as a stream, a few files a step; bad cells are carried."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)


def sliced(readings: DataFrame, slices: int, order: str = "ts", keys: tuple[str, ...] = ("run", "tag"), slice_rows: int = STEP_ROWS) -> str:
    """Write readings as at least ``slices`` slices of time, one after the other, and return their folder.

    A stream takes files by age, so slices are written in order of time; there
    are as many as keep one near ``slice_rows`` rows. Readings are dealt to
    slices in one pass and each slice then reads only its own part; its files
    hold whole series, in order.
    """
    path, staged = new_path(readings.sparkSession, "slices"), new_path(readings.sparkSession, "staged")
    slices = max(slices, -(-readings.count() // slice_rows))
    at, by = F.unix_micros(order), [k for k in keys if k in readings.columns]
    cuts = readings.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10 * slices).alias("c")).first()["c"] or []
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c < at))
    readings.withColumn("_slice", number).write.partitionBy("_slice").parquet(staged)
    for i in range(len(cuts) + 1):
        own = readings.sparkSession.read.parquet(staged).where(F.col("_slice") == i).drop("_slice")
        own.repartition(*[F.col(k) for k in by]).sortWithinPartitions(order).write.mode("append").parquet(path)
    drop_path(readings.sparkSession, staged)
    return path


def step_files(spark: SparkSession, path: str, least: int, step_rows: int = STEP_ROWS) -> int:
    """Files a step for ``replay``, so that the slices of ``sliced`` take ``least`` steps, or more only by their rows.

    A slice is as many files as it had tasks, and a step a file would grow
    with them. Slices are in order of age and a series is one file in each, so
    a step may end inside a slice.
    """
    steps = max(least, -(-spark.read.parquet(path).count() // step_rows))
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // steps))


def with_quality(readings: DataFrame, value: str = "value") -> DataFrame:
    """Good, or bad for a null sample."""
    return readings.withColumn("quality", F.when(F.col(value).isNull(), "bad").otherwise("good"))


def drained(stream: DataFrame, mode: str, tag: str, spark: SparkSession, idle_steps: bool = True) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, the last state of each row for ``complete``.

    Steps without data close what a watermark has passed. A state with a time
    to live asks for them without end, so such a stream needs ``idle_steps`` off.
    """
    path, marks = new_path(spark, tag), new_path(spark, f"{tag}-marks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    # Queries with named states need RocksDB; both settings hold for those started here.
    asked = {STORE: ROCKS, IDLE: str(idle_steps).lower()}
    kept = {name: spark.conf.get(name, None) for name in asked}
    try:
        for name, value in asked.items():
            spark.conf.set(name, value)
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.parquet(path)
    if mode == "complete":
        last = out.agg(F.max("_batch").alias("_batch"))
        out = out.join(F.broadcast(last), "_batch")  # one row
    return out.drop("_batch")


# ---- T02: drift and runs of flags by state

STATE = "n long, fast double, slow double, run long, last_us long, late long, before array<double>"
ALARM = "run long, tag string, kind string, n long, ts_us long, gap double, late long"
BAND = ("mean", "gap_mean", "half_width")
NO_TIME = -(2**63)


@dataclass(frozen=True)
class Rule:
    """How a series is judged: spans of both averages, flags that make an alarm, and what is done to samples first."""

    least: int = RUN
    fast: int = FAST
    slow: int = SLOW
    median: bool = False
    follow_level: bool = False
    bad_breaks: bool = False
    ttl_ms: int | None = None


class DriftAlarms(StatefulProcessor):
    """The state of a series: seven numbers and its last two good samples, forgotten after ``ttl_ms`` without a sample."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", STATE, self.rule.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rule = self.rule
        n, fast, slow, run, last, late, before = self.series.get() if self.series.exists() else (0, 0.0, 0.0, 0, NO_TIME, 0, [])
        got = pd.concat(list(rows)).sort_values("us", kind="stable")
        us = got["us"].to_numpy(np.int64)
        follows, out = (us > last) & np.r_[True, us[1:] != us[:-1]], []
        new, missed = np.flatnonzero(follows), int((~follows).sum())
        if missed:
            late += missed
            out.append((key[0], key[1], "late", n, int(us[~follows][0]), None, missed))
        if len(new):
            us, x = us[new], got["value"].to_numpy(np.float64, na_value=np.nan)[new]
            good = np.flatnonzero(~np.isnan(x))
            flags, gaps, number = np.zeros(len(x), bool), np.full(len(x), np.nan), n + np.cumsum(~np.isnan(x))
            if len(good):
                raw = np.concatenate([np.asarray(before, np.float64), x[good]])
                own = x[good]
                if rule.median and len(raw) > 2:
                    mid = np.median(np.stack([raw[:-2], raw[1:-1], raw[2:]]), axis=0)
                    own = np.concatenate([raw[len(before) : 2], mid])
                level, slow_after = averages(own, number[good].astype(np.float64), rule.slow, slow)
                fast_after = averages(own, number[good].astype(np.float64), rule.fast, fast)[1]
                gaps[good] = np.where(number[good] > 1, fast_after - level, np.nan)
                flags[good] = self.outside(gaps[good], level, *(got[c].iloc[0] for c in BAND))
                n, fast, slow, before = int(number[-1]), float(fast_after[-1]), float(slow_after[-1]), raw[-2:].tolist()
            seen = np.arange(len(x)) if rule.bad_breaks else good
            # Each flag's place in its run; one that begins the batch goes on from the state.
            at = np.arange(1, len(seen) + 1)
            broken = np.maximum.accumulate(np.where(flags[seen], 0, at))
            place = at - broken + np.where(broken == 0, run, 0)
            for i in seen[flags[seen] & (place == rule.least)]:
                out.append((key[0], key[1], "alarm", int(number[i]), int(us[i]), float(gaps[i]), late))
            run, last = int(place[-1]) if len(place) else run, int(us[-1])
        self.series.update((n, fast, slow, run, last, late, before))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALARM.split(", ")]).astype({"gap": "float64"})

    def outside(self, gap: np.ndarray, level: np.ndarray, mean: float, centre: float, half: float) -> np.ndarray:
        if pd.isna(half):
            return np.zeros(len(gap), bool)
        share = np.ones(len(gap))
        if self.rule.follow_level and mean != 0:
            share = np.minimum(1.0, np.maximum(SCALE_MIN, np.abs(level) / abs(mean)))
        return np.abs(gap - centre * share) > half * share

    def close(self) -> None:
        pass


def drift_events(stream: DataFrame, band: DataFrame | float, rule: Rule = Rule(), profile: DataFrame | None = None) -> DataFrame:
    """Events of each series of ``stream(run, tag, ts, value)``; run is a long.

    An ``alarm`` is a row each time a series has been outside its band for
    ``rule.least`` samples in a row: the good samples so far, the time and gap,
    and the late rows so far. A ``late`` row says how many rows of a step were
    not after the last one of their series (repeated or missing times included); they
    change nothing else, and none is dropped unseen.

    ``band`` is a half-width for all series, or a table of ``mean``,
    ``gap_mean`` and ``half_width`` by run and tag, as ``drift_bands`` makes it;
    a series without a band never flags. With a time-of-day ``profile`` the
    samples are first lessened by their slot's mean (cyclic method), with
    ``rule.median`` each becomes the median of it and the two good ones before.
    Null samples do not move the averages; with ``rule.bad_breaks`` they end a
    run, as they do in ``alarm_runs``.

    The rows of a series within one step are one task's; state is kept in
    RocksDB (``drained`` sets it) and has a fixed size. With ``rule.ttl_ms`` a
    series silent for so long, by the clock of the cluster, begins anew
    (``drained`` then needs ``idle_steps`` off).
    """
    own = stream if profile is None else residuals(stream, profile).withColumn("value", F.col("residual"))
    own = own.select(F.col("run").cast("long").alias("run"), "tag", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us"), F.col("value").cast("double").alias("value"))
    if isinstance(band, DataFrame):
        own = own.join(band.select(F.col("run").cast("long").alias("run"), "tag", *BAND), ["run", "tag"], "left")
    else:
        own = own.withColumns({"mean": F.lit(0.0), "gap_mean": F.lit(0.0), "half_width": F.lit(float(band))})
    mode = "None" if rule.ttl_ms is None else "ProcessingTime"
    return own.groupBy("run", "tag").transformWithStateInPandas(DriftAlarms(rule), ALARM, "Append", mode)


def drift_alarms(stream: DataFrame, half_width: float, least: int = RUN, fast: int = FAST, slow: int = SLOW) -> DataFrame:
    """The alarms of one half-width for all series, the level not followed."""
    return drift_events(stream, half_width, Rule(least, fast, slow)).where("kind = 'alarm'").drop("kind")


# ---- T03: running counts


def active_counts(stream: DataFrame, outside: Column) -> DataFrame:
    """Samples, bad samples and values out of band per tag so far."""
    return stream.groupBy("tag").agg(F.count("*").alias("samples"), F.count_if(F.col("value").isNull()).alias("bad"), F.count_if(F.coalesce(outside, F.lit(False))).alias("out_of_band"))


def tumbling_counts(stream: DataFrame, width: str, watermark: str) -> DataFrame:
    """Good samples per tag and tumbling window of event time; windows close behind the watermark."""
    own = stream.withWatermark("ts", watermark)
    return own.groupBy(F.window("ts", width), "tag").agg(F.count("value").alias("good")).select(F.col("window.start").alias("start"), "tag", "good")
