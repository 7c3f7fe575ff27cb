"""Joins are broadcast by measured sizes, not by those of well compressed files."""

import pytest

from millrace import scratch


@pytest.fixture
def measured(spark):
    before = spark.conf.get(scratch.STATIC)
    scratch.joins_by_measured_size(spark)
    yield spark
    scratch.joins_as_given(spark)
    assert spark.conf.get(scratch.STATIC) == before and spark.conf.get(scratch.MEASURED, None) is None


@pytest.fixture
def compact(spark, tmp_path):
    """A million rows in a file of a few megabytes."""
    path = str(tmp_path / "rows")
    spark.range(1_000_000).selectExpr("id", "id div 40 as sheet", "'pump' as class", "cast(id % 2 as int) as tool").write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compact_files_are_not_broadcast(measured, compact):
    t = measured.read.parquet(compact)
    joined = t.join(t.select("id", "class").withColumnRenamed("class", "other"), "id")
    assert "BroadcastHashJoin" not in plan(joined)
    assert joined.where("other = 'pump'").count() == 1_000_000


def test_tables_that_measure_small_are_still_broadcast(measured, compact):
    t = measured.read.parquet(compact)
    few = t.where("id % 100000 = 3").select("id", "sheet").withColumnRenamed("sheet", "of")
    joined = t.join(few, "id")
    assert joined.count() == 10
    joined.collect()
    assert "BroadcastHashJoin" in plan(joined)


def test_tables_of_some_megabytes_are_not_sent_to_the_driver(measured, compact):
    """sizes after a shuffle were trusted up to the session's 10 MB, in each join of each round."""
    t = measured.read.parquet(compact)
    some = t.where("id % 4 = 3").select("id", "sheet").withColumnRenamed("sheet", "of")
    joined = t.join(some, "id")
    assert len(joined.collect()) == 250_000
    assert "BroadcastHashJoin" not in plan(joined)


@pytest.mark.parametrize("given, static, sent", [("10MB", 256 << 10, 1 << 20), ("10485760b", 256 << 10, 1 << 20), ("-1", -1, -1), ("1000", 1000, 1000), ("512k", 256 << 10, 512 << 10)])
def test_bounds_stay_below_what_the_session_allows(spark, given, static, sent):
    before = spark.conf.get(scratch.STATIC)
    spark.conf.set(scratch.STATIC, given)
    try:
        scratch.joins_by_measured_size(spark)
        assert (int(spark.conf.get(scratch.STATIC)), int(spark.conf.get(scratch.MEASURED))) == (static, sent)
        scratch.joins_as_given(spark)
        assert spark.conf.get(scratch.STATIC) == given and spark.conf.get(scratch.MEASURED, None) is None
    finally:
        scratch.joins_as_given(spark)
        spark.conf.set(scratch.STATIC, before)


def test_registered_queries_measure_and_training_operators_do_not(spark, sf):
    import __spark_entry__ as entry

    before = spark.conf.get(scratch.STATIC)
    queries = entry.queries()
    queries["l02_tag_references"](spark, sf)
    assert int(spark.conf.get(scratch.STATIC)) == scratch.ESTIMATED
    queries["op13_url_filter"](spark, sf)
    assert spark.conf.get(scratch.STATIC) == before


def test_agreement_builds_no_table_of_boxes_on_the_driver(measured, compact):
    """boxes of compact files meet by shuffles."""
    from millrace.operators import matching as M

    t = measured.read.parquet(compact)
    x, y = "cast(id % 8 * 100 as double)", "cast(id div 8 % 5 * 100 as double)"
    boxes = t.selectExpr("tool", "sheet", "id", "class", f"{x} as x0", f"{y} as y0", f"{x} + 40 as x1", f"{y} + 40 as y1")
    assert "BroadcastHashJoin" not in plan(M.agreement(boxes))


def test_agreement_does_so_whatever_the_session_broadcasts(spark, compact):
    """the plan is made when the rows are asked for, and the session's own bounds may be back by then."""
    from millrace.operators import matching as M

    t = spark.read.parquet(compact)
    x, y = "cast(id % 8 * 100 as double)", "cast(id div 8 % 5 * 100 as double)"
    boxes = t.selectExpr("tool", "sheet", "id", "class", f"{x} as x0", f"{y} as y0", f"{x} + 40 as x1", f"{y} + 40 as y1")
    assert spark.conf.get(scratch.MEASURED, None) is None and scratch._bytes(spark.conf.get(scratch.STATIC)) == 10 << 20
    assert "BroadcastHashJoin" not in plan(M.agreement(boxes))
