"""Stored panels, wide files in blocks, and streams that are started again."""

from __future__ import annotations

import datetime as dt
import functools
import operator

import pytest
from pyspark.sql import functions as F

from tidepanel import streaming
from tidepanel.sources import panel_store as store
from tidepanel.streaming.runs import drain, in_starts

DAY = dt.date(2024, 1, 1)
PANEL = "availability_mode string, canonical_field string, reported_basis string, session date, security_id long, value double"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def rows_of(n=40):
    return [(store.MODES[i % 2], f"field_{i % 3}", "ANNUAL" if i % 5 else "INSTANT", DAY + dt.timedelta(i), i, float(i)) for i in range(n)]


def test_scan_prunes_partitions_and_pushes_filters(spark, tmp_path):
    path = f"{tmp_path}/p"
    seen = store.write_panel(panel(spark, rows_of()), path)
    assert (seen["n_rows"], seen["first"], seen["last"]) == (40, DAY, DAY + dt.timedelta(39))
    found = store.scan_panel(spark, path, store.MODES[0], ["field_0", "field_2"], ["ANNUAL"], DAY, DAY + dt.timedelta(20))
    want = [r for r in rows_of() if r[0] == store.MODES[0] and r[1] != "field_1" and r[2] == "ANNUAL" and r[3] <= DAY + dt.timedelta(20)]
    assert sorted(r["security_id"] for r in found.collect()) == sorted(r[4] for r in want)
    plan = found.select("security_id", "value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "availability_mode" in plan.split("PartitionFilters: [")[1].split("]")[0] and "canonical_field" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "reported_basis" in pushed and "session" in pushed


def test_panel_refusals(spark, tmp_path):
    path = f"{tmp_path}/p"
    store.write_panel(panel(spark, rows_of()), path)
    with pytest.raises(Exception, match="exists"):
        store.write_panel(panel(spark, rows_of()), path)
    with pytest.raises(Exception, match="PARTITION_INVALID: OTHER:f"):
        store.write_panel(panel(spark, [("OTHER", "f", "ANNUAL", DAY, 1, 1.0)]), f"{tmp_path}/q")
    with pytest.raises(Exception, match="PARTITION_INVALID"):
        store.write_panel(panel(spark, [(store.MODES[0], "a/b", "ANNUAL", DAY, 1, 1.0)]), f"{tmp_path}/r")
    with pytest.raises(ValueError, match="DATE_RANGE"):
        store.scan_panel(spark, path, store.MODES[0], ["field_0"], ["ANNUAL"], DAY, DAY - dt.timedelta(1))
    with pytest.raises(ValueError, match="REQUEST"):
        store.scan_panel(spark, path, store.MODES[0], [], ["ANNUAL"], DAY, DAY)
    store.write_panel(panel(spark, [(store.MODES[0], "f", "ANNUAL", DAY, 1, None)]), f"{tmp_path}/s")
    with pytest.raises(Exception, match="REQUIRED_VALUE_MISSING"):
        store.scan_panel(spark, f"{tmp_path}/s", store.MODES[0], ["f"], ["ANNUAL"], DAY, DAY).collect()


def test_window(spark, tmp_path):
    rows = spark.createDataFrame([(DAY + dt.timedelta(i), s, f, 1.0) for i in range(10) for s in (1, 2) for f in ("open", "close")], "session date, security_id long, field string, value double")
    said = {r["field"]: tuple(r)[1:] for r in store.materialize_window(rows, f"{tmp_path}/w", DAY + dt.timedelta(2), DAY + dt.timedelta(4)).collect()}
    assert said == {f: (6, DAY + dt.timedelta(2), DAY + dt.timedelta(4), 0) for f in ("open", "close")}
    with pytest.raises(ValueError, match="INVALID_MARKET_WINDOW"):
        store.materialize_window(rows, f"{tmp_path}/x", DAY, DAY - dt.timedelta(1))
    with pytest.raises(ValueError, match="INDEX_INVALID"):
        store.materialize_window(rows.unionByName(rows), f"{tmp_path}/y", DAY, DAY + dt.timedelta(4))


def test_wide_panels_of_many_securities(spark, tmp_path):
    n = 10_500
    rows = spark.range(n).select(F.explode(F.sequence(F.lit(DAY), F.lit(DAY + dt.timedelta(1)))).alias("session"), F.col("id").alias("security_id"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("open"))
    blocks = store.write_wide(rows, f"{tmp_path}/w", ["open"], block=2_000)
    assert len(blocks) > 1
    found = store.read_wide(spark, f"{tmp_path}/w")
    assert found.agg(F.count("*"), F.count_distinct("security_id"), F.sum("open")).first()[:] == (2 * (n - n // 7), n - n // 7, 2.0 * sum(i for i in range(n) if i % 7))


def test_wide_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, 1, 1.0), (DAY + dt.timedelta(1), 1, 2.0)], "session date, security_id long, close double")
    store.write_wide(rows, f"{tmp_path}/w", ["close"])
    with pytest.raises(ValueError, match="OPEN_PANEL_REQUIRED"):
        store.read_wide(spark, f"{tmp_path}/w")
    wide = spark.createDataFrame([(DAY + dt.timedelta(1), 1.0), (DAY, 2.0)], "session date, `1` double")
    wide.coalesce(1).write.parquet(f"{tmp_path}/v/open/block-00000")
    with pytest.raises(ValueError, match="INDEX_INVALID"):
        store.read_wide(spark, f"{tmp_path}/v")
    wide.limit(1).union(wide.limit(1)).coalesce(1).write.parquet(f"{tmp_path}/u/open/block-00000")
    with pytest.raises(ValueError, match="INDEX_INVALID"):
        store.read_wide(spark, f"{tmp_path}/u")


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """State outlives the query: a fill of the first start is known to the second, and nothing is given twice."""
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, at(1), 0), (2, at(2), 0), (2, at(2), 1), (3, at(3), 1), (3, at(3), 1), (4, at(1), 1)]
    sent = spark.createDataFrame(rows, "fill_id long, ts timestamp, part int")
    fills = in_starts(sent, lambda s: streaming.stream_fills(s, "10 days"), 2, "test-fills")
    assert sorted(r["fill_id"] for r in fills.collect()) == [1, 2, 3, 4]
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    sent.drop("part").write.parquet(source)
    for _ in range(2):  # the second start finds nothing new
        drain(streaming.stream_fills(spark.readStream.schema("fill_id long, ts timestamp").parquet(source), "10 days"), out, state)
    assert spark.read.parquet(out).count() == 4


def test_routing_calendar(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 8),)], "session date")
    said = {r["day"].day: (r["close_at"] and r["close_at"].hour, r["next_session"] and r["next_session"].day) for r in streaming.routing_calendar(days).collect()}
    assert said == {5: (16, 8), 6: (None, 8), 7: (None, 8), 8: (16, None)}
    seen = streaming.first_seen(spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "available_at timestamp, first_seen_at timestamp"))
    assert seen.first()["available_at"] == dt.datetime(2024, 1, 2)


def test_wide_panels_take_one_job_a_field_however_many_blocks(spark, tmp_path):
    rows = spark.range(60).select(F.lit(DAY).alias("session"), F.when(F.col("id") > 0, F.col("id")).alias("security_id"), F.col("id").cast("double").alias("open"))
    spark.sparkContext.setJobGroup("wide", "wide")
    blocks = store.write_wide(rows, f"{tmp_path}/w", ["open"], block=4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("wide"))
    spark.sparkContext.setJobGroup("other", "other")
    assert len(blocks) > 15 and jobs < 2 * len(blocks)
    want = {(None if i == 0 else str(i), float(i)) for i in range(60)}
    assert {(r["security_id"], r["open"]) for r in store.read_wide(spark, f"{tmp_path}/w").collect()} == want


SMALL = "/root/testdata/sf0.001"


def test_wide_panel_of_more_securities_than_a_pivot_takes(spark):
    from tidepanel.plans.all import QUERIES

    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        assert QUERIES["src_01_wide_panel"](spark, SMALL).select("security_id").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_equal_sums_in_another_order_are_ties(spark, tmp_path):
    from tidepanel.plans.all import QUERIES

    prices = [0.1, 0.2, 0.3] * 8
    added = lambda ps: functools.reduce(operator.add, ps)  # noqa: E731, sum() makes up for lost digits
    less, more = sorted((prices, prices[::-1]), key=added)
    assert added(less) < added(more)
    spark.createDataFrame([(i, 1.0) for i in (1, 2)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, p) for i, ps in ((1, less), (2, more)) for p in ps], "l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["security_id"]: r["place"] for r in QUERIES["tk_04_05_universe"](spark, str(tmp_path)).collect()} == {1: 1, 2: 2}


def test_bar_files_hold_many_securities(spark, tmp_path, monkeypatch):
    from tidepanel.plans import observable_queries

    monkeypatch.setattr(observable_queries, "scratch", lambda spark, label: f"{tmp_path}/bars")
    found = observable_queries.src_05(spark, SMALL)
    assert not [p for p in (tmp_path / "bars").iterdir() if p.is_dir()]
    assert found.select("security_id").distinct().count() > 5
