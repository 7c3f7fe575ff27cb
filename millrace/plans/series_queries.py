"""Queries over readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import checks as C
from millrace.operators import channels
from millrace.operators import series as S
from millrace.plans.standins import READINGS, readings, table


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as the SQL does it: half away from zero once the number is scaled, not by the digits it prints."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return S.split(readings(spark, d))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return S.band_flags(parts, S.bands(S.band_stats(parts.where("part = 'fit'")), 3))


def _low(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return S.band_flags(parts, S.bands(S.band_stats(parts.where("part = 'fit'")), 0.3))


def p14(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("run", "tag", "row_no", "value", "flag")


def a23(spark: SparkSession, d: str) -> DataFrame:
    return S.bands(S.band_stats(_parts(spark, d).where("part = 'fit'")), 3).select("run", "tag", "mean", "sd", "lo", "hi", "fit_good", "fit_bad")


def a24(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return S.k_table(parts.where("part = 'fit'"), parts.where("part = 'held'"))


def a24_choice(spark: SparkSession, d: str) -> DataFrame:
    return S.chosen_k(a24(spark, d))


def a24_drift(spark: SparkSession, d: str) -> DataFrame:
    """The K table of the drift method on held-out halves, at the K values of gap bands and at small ones."""
    parts = _parts(spark, d)
    stats, held = S.drift_stats(S.drift_gaps(parts.where("part = 'fit'"))), S.drift_gaps(parts.where("part = 'held'"))
    return S.drift_k_table(stats, held, (1, 2, 10, 15)).select("run", "k", "worst_tag", *[F.round(c, 6).alias(c) for c in ("worst_tag_rate", "mean_tag_rate", "any_tag_rate")])


def a24_drift_choice(spark: SparkSession, d: str) -> DataFrame:
    return S.fitted_gaps(readings(spark, d), "drift", (2, 3, 4, 5))[1]


def w03_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """The cyclic method end to end: profile, residuals, median of three, gaps, K and flags."""
    flags, choice, _ = S.fitted_gaps(readings(spark, d), "cyclic", (2, 3, 4, 5))
    return flags.groupBy("run", "tag").agg(F.count("*").alias("samples"), F.count_if("flag").alias("flagged"), F.round(F.avg("gap"), 6).alias("mean_gap")).join(choice, "run")


def w04(spark: SparkSession, d: str) -> DataFrame:
    return S.alarm_runs(_low(spark, d))


def w05(spark: SparkSession, d: str) -> DataFrame:
    own = readings(spark, d).withColumn("level", F.when(F.col("value") >= 50, "high").when(F.col("value").isNotNull(), "low"))
    return S.states(own, "level").select("run", "tag", "state", "first_row", "last_row", "samples")


def w06(spark: SparkSession, d: str) -> DataFrame:
    return S.onsets(_low(spark, d), 20)


def w08(spark: SparkSession, d: str) -> DataFrame:
    return S.first_flags(_low(spark, d), 20)


def o05(spark: SparkSession, d: str) -> DataFrame:
    return S.first_tags(_low(spark, d), 20)


def w11(spark: SparkSession, d: str) -> DataFrame:
    coarse = table(spark, d, "events").select(F.floor(F.col("user_id") / 15).cast("long").alias("run"), F.col("event_type").alias("tag"), F.date_trunc("hour", "ts").alias("ts"), "event_id")
    return S.out_of_order(S.numbered(coarse, "event_id"))


def w12(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("event_id", F.format_string("R%d-%s%d", "run", "tag", "row_no").alias("label"))


def w14(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_warnings(readings(spark, d), 90)


def j11(spark: SparkSession, d: str) -> DataFrame:
    asked = readings(spark, d).where("value is null").select("run", "tag", F.col("ts").alias("at"))
    return S.nearest(readings(spark, d), asked)


def j12(spark: SparkSession, d: str) -> DataFrame:
    return S.at_or_after(readings(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"))


def a25(spark: SparkSession, d: str) -> DataFrame:
    return S.slot_profile(readings(spark, d), 3).select("run", "tag", "slot", "slot_mean", "mean")


def a25_residuals(spark: SparkSession, d: str) -> DataFrame:
    own = readings(spark, d)
    return S.residuals(own, S.slot_profile(own)).select("run", "tag", "row_no", "slot", "residual")


def a26(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return S.daily_cycle(parts.where("part = 'fit'"), parts.where("part = 'held'"), 5)


def a26_choice(spark: SparkSession, d: str) -> DataFrame:
    return S.method_choice(readings(spark, d), least=5)


def a27(spark: SparkSession, d: str) -> DataFrame:
    return S.false_alarms(_low(spark, d), 180.0)


def w01(spark: SparkSession, d: str) -> DataFrame:
    return S.drift_gaps(readings(spark, d)).select("run", "tag", "row_no", rounded("gap").alias("gap"), rounded("level").alias("level"))


def w02(spark: SparkSession, d: str) -> DataFrame:
    return S.median3(readings(spark, d)).select("run", "tag", "row_no", "median3")


def w03(spark: SparkSession, d: str) -> DataFrame:
    gaps = S.drift_gaps(readings(spark, d))
    return S.drift_flags(gaps, S.drift_bands(S.drift_stats(gaps), 3.0)).groupBy("run", "tag").agg(F.count_if("flag").alias("flagged"), F.count("*").alias("samples"))


def a23_drift(spark: SparkSession, d: str) -> DataFrame:
    band = S.drift_bands(S.drift_stats(S.drift_gaps(readings(spark, d))), 3.0)
    return band.select("run", "tag", F.round("gap_mean", 6).alias("gap_mean"), F.round("resid_sd", 6).alias("resid_sd"), F.round("half_width", 6).alias("half_width"), "limited_by")


TAGS = ["click", "error", "purchase", "signup", "view"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("run", "row_no").pivot("tag", TAGS).agg(F.first("value", ignorenulls=True))


def a28(spark: SparkSession, d: str) -> DataFrame:
    """T2 of five tags; components and limit are learned from the even runs, the odd ones are judged."""
    wide = _wide(spark, d)
    model = channels.principal_model(wide.where("run % 2 = 0"), TAGS)
    return channels.hotelling(wide.where("run % 2 = 1"), TAGS, model).select("run", "row_no", F.round("t2", 6).alias("t2"), "flag")


def a28_moments(spark: SparkSession, d: str) -> DataFrame:
    """Means and covariances of the tags, from mergeable matrices."""
    n, mean, cross = channels.moments(_wide(spark, d), TAGS)
    rows = [(a, b, n, float(mean[i]), float(cross[i, j] / n)) for i, a in enumerate(TAGS) for j, b in enumerate(TAGS)]
    return spark.createDataFrame(rows, "a string, b string, n long, mean double, covariance double").select("a", "b", "n", F.round("mean", 6).alias("mean"), F.round("covariance", 4).alias("covariance"))


def w07(spark: SparkSession, d: str) -> DataFrame:
    """Timeline statements about each tag: it leaves and enters the low band, has a peak that falls by 5, and is never high."""
    value = F.col("value")
    rows = readings(spark, d).withColumn("state", F.when(value < 10, "low").when(value < 95, "normal").when(value.isNotNull(), "high"))
    after = F.lit("2024-01-03").cast("timestamp")
    tests = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(state).alias("state"), (after if late else F.lit(None).cast("timestamp")).alias("after"), F.lit(fall).cast("double").alias("drop")) for t, state, late, fall in (("leave", "low", False, None), ("enter", "low", True, None), ("peak", None, True, 5.0), ("never", "high", False, None))])
    tags = rows.select("tag").distinct().select("tag", F.inline(tests))
    asked = tags.select(F.concat_ws(" ", "tag", "test").alias("statement"), "tag", "test", "state", "after", F.when(F.col("test") == "enter", F.lit("2024-01-05").cast("timestamp")).alias("expect"), F.lit(1440.0).alias("tolerance_min"), "drop")
    return S.statement_checks(rows, asked)


def w10(spark: SparkSession, d: str) -> DataFrame:
    """Active minutes: from each click (start) to the next event of the user, no more than 30 minutes each."""
    return C.active_spans(table(spark, d, "events"), "user_id", F.col("event_type") == "click", ["ts", "event_id"], 30)


def k05(spark: SparkSession, d: str) -> DataFrame:
    """Wide historian rows: one column per tag."""
    tags = ["click", "error", "purchase", "signup", "view"]
    return readings(spark, d).groupBy("run", "row_no").pivot("tag", tags).agg(F.first("value"))


WITH = "WITH RECURSIVE " + READINGS
DRIFT = WITH + """, good AS (SELECT run, tag, row_no, value, row_number() OVER (PARTITION BY run, tag ORDER BY row_no) AS n FROM readings WHERE value IS NOT NULL),
walk AS (
  SELECT run, tag, row_no, value, n, value AS f, value AS s, NULL::DOUBLE AS gap, NULL::DOUBLE AS level FROM good WHERE n = 1
  UNION ALL
  SELECT g.run, g.tag, g.row_no, g.value, g.n, w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.value - w.f), w.s + greatest(1.0 / 600, 1.0 / g.n::DOUBLE) * (g.value - w.s),
    w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.value - w.f) - w.s, w.s
  FROM walk w JOIN good g ON g.run = w.run AND g.tag = w.tag AND g.n = w.n + 1),
dstats AS (SELECT run, tag, avg(value) AS mean, avg(gap) AS gap_mean, stddev_pop(gap) AS resid_sd, 0.01 * abs(avg(value)) AS floor FROM walk GROUP BY run, tag HAVING count(gap) > 0),
dbands AS (SELECT *, CASE WHEN greatest(3 * resid_sd, floor) = 0 THEN 3e-9 ELSE greatest(3 * resid_sd, floor) END AS half_width, CASE WHEN floor >= 3 * resid_sd THEN 'floor' ELSE 'spread' END AS limited_by FROM dstats)
"""
SLOT = "floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) * 48 / 86400)::INTEGER"

#: The gaps of each half of a series, each started anew: of readings (drift), or of residuals after a median of three (cyclic).
HALVES = WITH + """, {source},
good AS (SELECT *, row_number() OVER (PARTITION BY run, tag, part ORDER BY row_no) AS n FROM src WHERE x IS NOT NULL),
walk AS (
  SELECT run, tag, part, row_no, n, x AS f, x AS s, NULL::DOUBLE AS gap, NULL::DOUBLE AS level FROM good WHERE n = 1
  UNION ALL
  SELECT g.run, g.tag, g.part, g.row_no, g.n, w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.x - w.f), w.s + greatest(1.0 / 600, 1.0 / g.n::DOUBLE) * (g.x - w.s),
    w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.x - w.f) - w.s, w.s
  FROM walk w JOIN good g ON g.run = w.run AND g.tag = w.tag AND g.part = w.part AND g.n = w.n + 1),
gaps AS (SELECT p.run, p.tag, p.part, p.row_no, p.value, w.gap, w.level FROM parts p LEFT JOIN walk w USING (run, tag, part, row_no)),
st AS (SELECT run, tag, avg(value) AS mean, avg(gap) AS gap_mean, stddev_pop(gap) AS resid_sd, 0.01 * abs(avg(value)) AS floor FROM gaps WHERE part = 'fit' GROUP BY run, tag HAVING count(gap) > 0),
own AS (
  SELECT g.run, g.tag, g.row_no, k, g.gap, coalesce(abs(g.gap - st.gap_mean * r) > r * CASE WHEN greatest(k * resid_sd, floor) = 0 THEN k * 1e-9 ELSE greatest(k * resid_sd, floor) END, false) AS flag
  FROM (SELECT gaps.*, k FROM gaps, (VALUES {ks}) AS t(k) WHERE part = 'held') g LEFT JOIN (SELECT * FROM st) st USING (run, tag), LATERAL (SELECT {r} AS r)),
tags AS (SELECT run, k, tag, avg(flag::INT) AS rate FROM own GROUP BY run, k, tag),
rws AS (SELECT run, k, avg(f::INT) AS any_tag_rate FROM (SELECT run, k, row_no, bool_or(flag) AS f FROM own GROUP BY run, k, row_no) GROUP BY run, k),
choice AS (SELECT run, coalesce(min(k) FILTER (any_tag_rate < 0.005), max(k)) AS k, bool_or(any_tag_rate < 0.005) AS target_met FROM rws GROUP BY run)
"""
BY_LEVEL = "CASE WHEN st.mean = 0 THEN 1.0 ELSE least(1.0, greatest(0.5, abs(g.level) / abs(st.mean))) END"
READING_HALVES = "src AS (SELECT run, tag, part, row_no, value AS x FROM parts)"


def _halves(source: str, ks: str, r: str) -> str:
    return HALVES.replace("{source}", source).replace("{ks}", ks).replace("{r}", r)


RESIDUAL_HALVES = """fitted AS (SELECT * FROM parts WHERE part = 'fit' AND value IS NOT NULL),
prof AS (SELECT run, tag, avg(value) AS m FROM fitted GROUP BY run, tag),
slots AS (SELECT run, tag, """ + SLOT + """ AS slot, avg(value) AS sm FROM fitted GROUP BY ALL HAVING count(*) >= 3),
res AS (SELECT p.run, p.tag, p.part, p.row_no, p.value - coalesce(s.sm, f.m) AS v FROM (SELECT *, """ + SLOT + """ AS slot FROM parts) p LEFT JOIN prof f USING (run, tag) LEFT JOIN slots s ON s.run = p.run AND s.tag = p.tag AND s.slot = p.slot),
src AS (SELECT run, tag, part, row_no, CASE WHEN b IS NULL THEN v ELSE list_sort([v, a, b])[2] END AS x
  FROM (SELECT *, lag(v) OVER w AS a, lag(v, 2) OVER w AS b FROM res WHERE v IS NOT NULL WINDOW w AS (PARTITION BY run, tag, part ORDER BY row_no)))"""

QUERIES = {
    "p14_band_predicate": (p14, WITH + "SELECT run, tag, row_no, value, flag FROM flags"),
    "a23_band_fit": (a23, WITH + "SELECT run, tag, mean, sd, lo, hi, fit_good, fit_bad FROM bands"),
    "a24_k_selection": (a24, WITH + """, own AS (SELECT p.run, p.tag, p.row_no, k, coalesce(abs(p.value - s.mean) / CASE WHEN s.sd = 0 THEN 1e-9 ELSE s.sd END > k, false) AS flag
        FROM parts p LEFT JOIN stats s USING (run, tag), (VALUES (3), (4), (5), (6)) AS ks(k) WHERE p.part = 'held'),
      tags AS (SELECT run, k, tag, avg(flag::INT) AS rate FROM own GROUP BY run, k, tag),
      rws AS (SELECT run, k, avg(f::INT) AS any_tag_rate FROM (SELECT run, k, row_no, bool_or(flag) AS f FROM own GROUP BY run, k, row_no) GROUP BY run, k)
      SELECT run, k, max(rate) AS worst_tag_rate, avg(rate) AS mean_tag_rate, min(tag) FILTER (rate = m) AS worst_tag, any_value(any_tag_rate) AS any_tag_rate
      FROM (SELECT *, max(rate) OVER (PARTITION BY run, k) AS m FROM tags) JOIN rws USING (run, k) GROUP BY run, k"""),
    "a24_k_choice": (a24_choice, WITH + """, own AS (SELECT p.run, p.tag, k, avg(coalesce(abs(p.value - s.mean) / CASE WHEN s.sd = 0 THEN 1e-9 ELSE s.sd END > k, false)::INT) AS rate
        FROM parts p LEFT JOIN stats s USING (run, tag), (VALUES (3), (4), (5), (6)) AS ks(k) WHERE p.part = 'held' GROUP BY p.run, p.tag, k),
      w AS (SELECT run, k, max(rate) AS worst FROM own GROUP BY run, k)
      SELECT run, coalesce(min(k) FILTER (worst < 0.005), max(k)) AS k, bool_or(worst < 0.005) AS target_met FROM w GROUP BY run"""),
    "a24_drift_k_table": (a24_drift, _halves(READING_HALVES, "(1), (2), (10), (15)", BY_LEVEL) + """SELECT run, k, min(tag) FILTER (rate = m) AS worst_tag, round(max(rate), 6) AS worst_tag_rate, round(avg(rate), 6) AS mean_tag_rate, round(any_value(any_tag_rate), 6) AS any_tag_rate
      FROM (SELECT *, max(rate) OVER (PARTITION BY run, k) AS m FROM tags) JOIN rws USING (run, k) GROUP BY run, k"""),
    "a24_drift_choice": (a24_drift_choice, _halves(READING_HALVES, "(2), (3), (4), (5)", BY_LEVEL) + "SELECT run, k, target_met FROM choice"),
    "w03_cyclic_flags": (w03_cyclic, _halves(RESIDUAL_HALVES, "(2), (3), (4), (5)", "1.0") + """SELECT run, tag, any_value(c.k) AS k, any_value(c.target_met) AS target_met, count(*) AS samples, count(*) FILTER (flag) AS flagged, round(avg(gap), 6) AS mean_gap
      FROM own JOIN choice c USING (run, k) GROUP BY run, tag"""),
    "w04_alarm_runs": (w04, WITH + """SELECT run, tag, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS samples
      FROM (SELECT *, row_no - row_number() OVER (PARTITION BY run, tag ORDER BY row_no) AS island FROM low WHERE flag) GROUP BY run, tag, island HAVING count(*) >= 3"""),
    "w05_state_spells": (w05, WITH + """, s AS (SELECT run, tag, row_no, CASE WHEN value >= 50 THEN 'high' WHEN value IS NOT NULL THEN 'low' END AS state FROM readings),
      c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run, tag ORDER BY row_no) <> state, true)::INT AS changed FROM s WHERE state IS NOT NULL),
      p AS (SELECT *, sum(changed) OVER (PARTITION BY run, tag ORDER BY row_no) AS spell FROM c)
      SELECT run, tag, state, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS samples FROM p GROUP BY run, tag, spell, state"""),
    "w06_onsets": (w06, WITH + """, m AS (SELECT *, lag(flag) OVER (PARTITION BY run, tag ORDER BY row_no) AS was FROM low)
      SELECT run, tag, bool_or(flag) FILTER (row_no = 20) AS at_start, min(row_no) FILTER (flag AND NOT was AND row_no > 20) AS onset_row FROM m GROUP BY run, tag"""),
    "w07_timeline_checks": (w07, WITH + """, r AS (SELECT run, tag, row_no, ts, value, CASE WHEN value < 10 THEN 'low' WHEN value < 95 THEN 'normal' ELSE 'high' END AS state FROM readings WHERE value IS NOT NULL),
      o AS (SELECT *, lag(state) OVER w AS was, lag(ts) OVER w AS was_ts, lag(value) OVER w AS prev, lead(value) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY run, tag ORDER BY row_no)),
      m AS (SELECT run, tag, max(value) AS top,
        min({'t': ts, 'v': value}) FILTER (was = 'low' AND state <> 'low') AS leave, min({'t': ts, 'v': value}) FILTER (state = 'low' AND ts >= TIMESTAMP '2024-01-03') AS enter,
        min({'t': ts, 'v': value}) FILTER (value > prev AND value >= nxt + 5 AND was_ts >= TIMESTAMP '2024-01-03') AS peak, min({'t': ts, 'v': value}) FILTER (state = 'high') AS never
        FROM o GROUP BY run, tag),
      s AS (SELECT run, tag, top, t.test, CASE t.test WHEN 'leave' THEN leave WHEN 'enter' THEN enter WHEN 'peak' THEN peak ELSE never END AS hit
        FROM (SELECT run, tag FROM readings GROUP BY run, tag) LEFT JOIN m USING (run, tag), (VALUES ('leave'), ('enter'), ('peak'), ('never')) t(test)),
      q AS (SELECT *, CASE WHEN test = 'enter' THEN round((epoch_us(hit.t) - epoch_us(TIMESTAMP '2024-01-05')) / 60e6, 1) END AS minutes_off FROM s)
      SELECT run, tag || ' ' || test AS statement, hit.t AS got_ts, CASE test WHEN 'never' THEN top WHEN 'peak' THEN hit.v END AS value, minutes_off,
        CASE WHEN test = 'never' THEN hit IS NULL WHEN hit IS NULL THEN false WHEN test = 'enter' THEN abs((epoch_us(hit.t) - epoch_us(TIMESTAMP '2024-01-05')) / 60e6) <= 1440 ELSE true END AS ok FROM q"""),
    "w08_first_flags": (w08, WITH + """SELECT run, tag, min(row_no) FILTER (row_no >= 20 AND flag) AS first_row,
        epoch_us(min(ts) FILTER (row_no >= 20 AND flag)) - epoch_us(min(ts) FILTER (row_no = 20)) AS delay_us,
        count(*) FILTER (row_no < 20 AND flag) AS flagged_before, avg(flag::INT) FILTER (row_no >= 20) AS rate_after FROM low GROUP BY run, tag"""),
    "o05_first_tags": (o05, WITH + """, f AS (SELECT run, tag, min(row_no) AS first_row FROM low WHERE flag AND row_no >= 20 GROUP BY run, tag)
      SELECT * FROM (SELECT run, row_number() OVER (PARTITION BY run ORDER BY first_row, tag) AS place, tag, first_row FROM f) WHERE place <= 3"""),
    "w10_active_minutes": (w10, """SELECT user_id, sum(least(30.0, (epoch_us(next_ts) - epoch_us(ts)) / 60e6)) AS active_minutes, count(*) AS spans
      FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) WHERE event_type = 'click' AND next_ts IS NOT NULL GROUP BY user_id"""),
    "w11_strict_order": (w11, """WITH c AS (SELECT floor(user_id / 15)::BIGINT AS run, event_type AS tag, date_trunc('hour', ts) AS ts, event_id FROM events),
      n AS (SELECT *, row_number() OVER w - 1 AS row_no, lag(ts) OVER w AS before_ts FROM c WINDOW w AS (PARTITION BY run, tag ORDER BY event_id))
      SELECT run, tag, row_no, before_ts, ts FROM n WHERE ts <= before_ts"""),
    "w12_numbering": (w12, WITH + "SELECT event_id, 'R' || run || '-' || tag || row_no AS label FROM readings"),
    "w14_sample_warnings": (w14, WITH + """, s AS (SELECT run, tag, count(value) FILTER (part = 'fit') AS n_fit, count(value) FILTER (part = 'held') AS n_held, coalesce(stddev_pop(value) FILTER (part = 'fit'), 0) AS sd FROM parts GROUP BY run, tag)
      SELECT run, tag, n_fit, n_held, warnings FROM (SELECT *, concat_ws('; ', CASE WHEN n_fit < 90 THEN 'few fit samples' END, CASE WHEN n_held < 90 THEN 'few held-out samples' END, CASE WHEN sd = 0 THEN 'constant in fit' END) AS warnings FROM s) WHERE warnings <> ''"""),
    "j11_nearest_in_time": (j11, WITH + """, asked AS (SELECT run, tag, ts AS asked_at FROM readings WHERE value IS NULL),
      c AS (SELECT a.run, a.tag, a.asked_at, r.ts, r.value, row_number() OVER (PARTITION BY a.run, a.tag, a.asked_at ORDER BY abs(epoch_us(a.asked_at) - epoch_us(r.ts)), r.ts) AS k
        FROM asked a JOIN readings r ON r.run = a.run AND r.tag = a.tag AND r.value IS NOT NULL)
      SELECT run, tag, asked_at AS "at", ts, value FROM c WHERE k = 1"""),
    "j12_at_or_after": (j12, WITH + "SELECT run, tag, min(row_no) FILTER (ts >= TIMESTAMP '2024-01-15 00:00:00') AS fault_row FROM readings GROUP BY run, tag"),
    "a25_slot_profile": (a25, WITH + f""", g AS (SELECT run, tag, {SLOT} AS slot, value FROM readings WHERE value IS NOT NULL),
      s AS (SELECT run, tag, slot, avg(value) AS slot_mean FROM g GROUP BY run, tag, slot HAVING count(*) >= 3)
      SELECT m.run, m.tag, slot, slot_mean, mean FROM (SELECT run, tag, avg(value) AS mean FROM g GROUP BY run, tag) m LEFT JOIN s USING (run, tag)"""),
    "a25_slot_residuals": (a25_residuals, WITH + f""", g AS (SELECT run, tag, row_no, {SLOT} AS slot, value FROM readings),
      s AS (SELECT run, tag, slot, avg(value) AS slot_mean FROM g WHERE value IS NOT NULL GROUP BY run, tag, slot HAVING count(*) >= 3),
      m AS (SELECT run, tag, avg(value) AS mean FROM g GROUP BY run, tag)
      SELECT g.run, g.tag, row_no, g.slot, value - coalesce(slot_mean, mean) AS residual FROM g LEFT JOIN m USING (run, tag) LEFT JOIN s ON s.run = g.run AND s.tag = g.tag AND s.slot = g.slot"""),
    "a26_daily_cycle": (a26, WITH + f""", g AS (SELECT run, tag, part, {SLOT} AS slot, value FROM parts WHERE value IS NOT NULL),
      s AS (SELECT run, tag, slot, avg(value) AS slot_mean FROM g WHERE part = 'fit' GROUP BY run, tag, slot HAVING count(*) >= 3),
      m AS (SELECT run, tag, avg(value) AS mean FROM g WHERE part = 'fit' GROUP BY run, tag),
      r AS (SELECT g.run, g.tag, g.value, coalesce(slot_mean, mean) AS p FROM g JOIN m USING (run, tag) LEFT JOIN s ON s.run = g.run AND s.tag = g.tag AND s.slot = g.slot WHERE g.part = 'held')
      SELECT run, tag, count(*) AS n, 1 - var_pop(value - p) / var_pop(value) AS r2 FROM r GROUP BY run, tag HAVING count(*) >= 5 AND var_pop(value) > 0"""),
    "a26_method_choice": (a26_choice, WITH + f""", g AS (SELECT run, tag, part, {SLOT} AS slot, value FROM parts WHERE value IS NOT NULL),
      s AS (SELECT run, tag, slot, avg(value) AS slot_mean FROM g WHERE part = 'fit' GROUP BY run, tag, slot HAVING count(*) >= 3),
      m AS (SELECT run, tag, avg(value) AS mean FROM g WHERE part = 'fit' GROUP BY run, tag),
      r AS (SELECT g.run, g.tag, g.value, coalesce(slot_mean, mean) AS p FROM g JOIN m USING (run, tag) LEFT JOIN s ON s.run = g.run AND s.tag = g.tag AND s.slot = g.slot WHERE g.part = 'held'),
      c AS (SELECT run, median(r2) AS r2 FROM (SELECT run, tag, 1 - var_pop(value - p) / var_pop(value) AS r2 FROM r GROUP BY run, tag HAVING count(*) >= 5 AND var_pop(value) > 0) GROUP BY run),
      d AS (SELECT run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS fit_days FROM parts WHERE part = 'fit' GROUP BY run)
      SELECT run, fit_days, r2, CASE WHEN fit_days >= 2 AND coalesce(r2, -1) >= 0.1 THEN 'cyclic' ELSE 'drift' END AS method FROM d LEFT JOIN c USING (run)"""),
    "a27_false_alarms": (a27, WITH + """, i AS (SELECT run, tag, row_no - row_number() OVER (PARTITION BY run, tag ORDER BY row_no) AS island FROM low WHERE flag),
      e AS (SELECT run, count(*) AS events FROM (SELECT run, tag, island FROM i GROUP BY run, tag, island HAVING count(*) >= 3) GROUP BY run),
      r AS (SELECT run, count(*) AS samples, count(*) FILTER (flag) AS flagged FROM low GROUP BY run),
      j AS (SELECT run, samples, flagged, coalesce(events, 0) AS events, samples * 180.0 / 3600 AS hours FROM r LEFT JOIN e USING (run))
      SELECT run, samples, flagged, events, flagged / samples AS flag_rate, events / (hours / 24) AS events_per_day,
        CASE WHEN flagged = 0 THEN 3.0 / samples ELSE flagged / samples END::DOUBLE AS rate_bound, events / hours * 40 AS events_40h FROM j"""),
    "w01_drift_gaps": (w01, DRIFT + "SELECT run, tag, row_no, round(gap, 6) AS gap, round(level, 6) AS level FROM walk UNION ALL SELECT run, tag, row_no, NULL, NULL FROM readings WHERE value IS NULL"),
    "w02_median3": (w02, WITH + """, g AS (SELECT run, tag, row_no, value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM readings WHERE value IS NOT NULL WINDOW w AS (PARTITION BY run, tag ORDER BY row_no))
      SELECT run, tag, row_no, CASE WHEN b IS NULL THEN value ELSE list_sort([value, a, b])[2] END AS median3 FROM g
      UNION ALL SELECT run, tag, row_no, NULL FROM readings WHERE value IS NULL"""),
    "w03_level_bands": (w03, DRIFT + """SELECT run, tag, count(*) FILTER (abs(gap - gap_mean * r) > half_width * r) AS flagged, count(*) + (SELECT count(*) FROM readings x WHERE x.run = y.run AND x.tag = y.tag AND value IS NULL) AS samples
      FROM (SELECT w.*, b.gap_mean, b.half_width, CASE WHEN b.mean = 0 THEN 1.0 ELSE least(1.0, greatest(0.5, abs(level) / abs(b.mean))) END AS r FROM walk w LEFT JOIN dbands b USING (run, tag)) y GROUP BY run, tag"""),
    "a23_drift_bands": (a23_drift, DRIFT + "SELECT run, tag, round(gap_mean, 6) AS gap_mean, round(resid_sd, 6) AS resid_sd, round(half_width, 6) AS half_width, limited_by FROM dbands"),
    "a28_hotelling": (a28, None),
    "a28_moments": (a28_moments, WITH + """, w AS (SELECT run, row_no, """ + ", ".join(f"max(value) FILTER (tag = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + """ FROM readings GROUP BY run, row_no),
      v AS (SELECT * FROM w WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL)
      """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg({a}), 6) AS mean, round(covar_pop({a}, {b}), 4) AS covariance FROM v" for a in ("click", "error", "purchase", "signup", "view") for b in ("click", "error", "purchase", "signup", "view"))),
    "k05_wide_rows": (k05, WITH + """SELECT run, row_no, any_value(value) FILTER (tag = 'click') AS click, any_value(value) FILTER (tag = 'error') AS error, any_value(value) FILTER (tag = 'purchase') AS purchase,
      any_value(value) FILTER (tag = 'signup') AS signup, any_value(value) FILTER (tag = 'view') AS "view" FROM readings GROUP BY run, row_no"""),
}
