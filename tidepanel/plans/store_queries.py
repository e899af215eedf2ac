"""Panels that a query writes to the shared folder and reads back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.plans.registry import query, rounded
from tidepanel.sources import panel_store as store
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_EVENTS, SQL_SUPPLIERS, SQL_VERSIONS
from tidepanel.sources.shared import scratch

_FROM, _TO = dt.date(1996, 1, 1), dt.date(1997, 6, 30)


def stored_panel(spark, sf_dir):
    """Supplier facts as a panel: known from shipping on, on two bases; the forward mode knows every other one."""
    v = panels.versions(spark, sf_dir).select(F.concat(F.lit("field_"), "field").alias("canonical_field"), F.when(F.col("accession") % 3 == 0, "ANNUAL").otherwise("INSTANT").alias("reported_basis"), F.col("available_at").alias("session"), "security_id", "accession", "period_end", "value")
    return v.withColumn("availability_mode", F.explode(F.when(F.col("accession") % 2 == 0, F.array(*map(F.lit, store.MODES))).otherwise(F.array(F.lit(store.MODES[0])))))


@query("src_03_partitioned_scan", f"""WITH {SQL_VERSIONS} SELECT 'field_' || field AS canonical_field, CASE WHEN accession % 3 = 0 THEN 'ANNUAL' ELSE 'INSTANT' END AS reported_basis, available_at AS session, security_id, accession, round(value, 4) + 0.0 AS value FROM versions_l
WHERE accession % 2 = 0 AND field IN ('A', 'R') AND accession % 3 = 0 AND available_at BETWEEN DATE '{_FROM}' AND DATE '{_TO}'""")
def src_03(spark, sf_dir):
    """One mode, two fields, one basis and a window of a panel in partitions."""
    path = scratch(spark, "panel")
    store.write_panel(stored_panel(spark, sf_dir), path)
    columns = (*store.REQUIRED, "accession")
    found = store.scan_panel(spark, path, "FORWARD_ASOF", ["field_A", "field_R"], ["ANNUAL"], _FROM, _TO, columns)
    return found.select("canonical_field", "reported_basis", "session", "security_id", "accession", rounded(F.col("value"), 4).alias("value"))


@query("snk_01_written_panel", f"""WITH {SQL_VERSIONS}, p AS (SELECT 'HISTORICAL_ASOF' AS availability_mode, * FROM versions_l UNION ALL SELECT 'FORWARD_ASOF', * FROM versions_l WHERE accession % 2 = 0)
SELECT availability_mode, 'field_' || field AS canonical_field, count(*) AS n_rows, min(available_at) AS first_session, max(available_at) AS last_session, (SELECT count(*) FROM p) AS n_observed FROM p GROUP BY 1, 2""")
def snk_01(spark, sf_dir):
    """What each partition of a written panel has, and the rows that the write itself counted."""
    path = scratch(spark, "panel")
    seen = store.write_panel(stored_panel(spark, sf_dir), path)
    out = spark.read.parquet(path).groupBy(*store.PARTITIONS).agg(F.count("*").alias("n_rows"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    return out.withColumn("n_observed", F.lit(seen["n_rows"]).cast("long"))


@query("src_04_market_window", f"""WITH {SQL_SUPPLIERS}, l AS (SELECT session, security_id, 'close' AS field, close AS value FROM bars_l UNION ALL SELECT session, security_id, 'open', open FROM bars_l UNION ALL SELECT session, security_id, 'volume', volume FROM bars_l)
SELECT field, count(*) AS n_rows, min(session) AS first_session, max(session) AS last_session, CAST(0 AS BIGINT) AS escaped FROM l WHERE session BETWEEN DATE '{_FROM}' AND DATE '{_TO}' GROUP BY 1""")
def src_04(spark, sf_dir):
    """The manifest of a window of weekly bars, written field by field."""
    bars = panels.supplier_bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    rows = bars.unpivot(["session", "security_id"], ["open", "close", "volume"], "field", "value")
    return store.materialize_window(rows, scratch(spark, "window"), _FROM, _TO)


@query("src_01_wide_blocks", f"WITH {SQL_EVENTS} SELECT session, CAST(security_id AS VARCHAR) AS security_id, open, close, CAST(volume AS DOUBLE) AS volume FROM bars_e")
def src_01(spark, sf_dir):
    """Field panels of all securities, in blocks of wide files, read back to rows."""
    path = scratch(spark, "wide")
    bars = panels.event_bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    store.write_wide(bars.select("session", "security_id", "open", "close", "volume"), path, ["open", "close", "volume"], block=400)
    return store.read_wide(spark, path).select("session", "security_id", "open", "close", "volume")
