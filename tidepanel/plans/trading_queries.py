"""Orders against bars, dated events of positions, and quotes, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import accounts as ac
from tidepanel.operators import events as ev
from tidepanel.operators import fills
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_SUPPLIERS, read

#: Customer orders as limit orders of a hundred securities: several for each, some of them no orders at all.
_ORDERS = """SELECT o_orderkey AS order_id, 1 + o_custkey % 100 AS security_id, CASE WHEN o_orderkey % 41 = 0 THEN 'HOLD' WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, o_orderkey % 60 AS quantity,
  CAST(CASE WHEN o_orderkey % 43 = 0 THEN 0 ELSE 900 + o_orderkey % 1200 END AS DOUBLE) AS lim, CAST(o_orderdate AS DATE) AS submitted FROM orders"""
_BAD = "side = 'HOLD' OR lim <= 0"
_TOUCH = "((side = 'BUY' AND low < lim) OR (side = 'SELL' AND high > lim))"


def limit_orders(spark, sf_dir):
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    side = F.when(key % 41 == 0, "HOLD").when(key % 2 == 0, "BUY").otherwise("SELL")
    limit = F.when(key % 43 == 0, 0.0).otherwise((900 + key % 1200).cast("double"))
    return o.select(key.alias("order_id"), (1 + F.col("o_custkey") % 100).alias("security_id"), side.alias("side"), (key % 60).alias("quantity"), limit.alias("limit"), F.to_date("o_orderdate").alias("submitted"))


def weekly_bars(spark, sf_dir):
    return panels.supplier_bars(spark, sf_dir).select("security_id", "session", F.date_add("session", 7).alias("end"), "low", "high", "volume")


@query("join_10_first_touch", f"""WITH {SQL_SUPPLIERS}, o AS ({_ORDERS}), j AS (SELECT o.*, (SELECT min(session) FROM bars_l b WHERE b.security_id = o.security_id AND b.session >= submitted AND {_TOUCH} AND NOT ({_BAD})) AS session, (SELECT max(session) FROM bars_l b WHERE b.security_id = o.security_id) AS last FROM o),
k AS (SELECT j.*, CASE WHEN b.session IS NULL THEN 0 ELSE least(quantity, CAST(floor(b.volume * 0.1) AS BIGINT)) END AS filled FROM j LEFT JOIN bars_l b ON b.security_id = j.security_id AND b.session = j.session)
SELECT order_id, security_id, side, session, filled, CASE WHEN filled > 0 THEN lim END AS price, CASE WHEN filled > 0 THEN session + 7 END AS available_at,
  CASE WHEN {_BAD} THEN 'INVALID_FILL_INPUT' WHEN last IS NULL OR last < submitted THEN 'PRE_SUBMISSION_BAR_EXCLUDED' WHEN session IS NULL THEN 'NO_TOUCH' WHEN filled < quantity THEN 'PARTIAL' ELSE 'APPROXIMATED_FILL' END AS status FROM k""")
def join_10(spark, sf_dir):
    """Each order's first bar that trades through its limit, buyers and sellers, and what it fills."""
    out = fills.first_touch(limit_orders(spark, sf_dir), weekly_bars(spark, sf_dir))
    return out.select("order_id", "security_id", "side", "session", "filled", "price", "available_at", "status")


@query("sc_27_bar_fill", f"""WITH {SQL_SUPPLIERS}, b AS (SELECT *, CASE WHEN security_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 15 AS quantity, CAST(1100 + security_id % 400 AS DOUBLE) AS lim, DATE '1995-01-02' AS submitted FROM bars_l),
f AS (SELECT *, CASE WHEN session >= submitted AND {_TOUCH} THEN least(quantity, CAST(floor(volume * 0.1) AS BIGINT)) ELSE 0 END AS filled FROM b)
SELECT security_id, session, filled, CASE WHEN filled > 0 THEN lim END AS price, CASE WHEN session < submitted THEN 'PRE_SUBMISSION_BAR_EXCLUDED' WHEN NOT {_TOUCH} THEN 'NO_TOUCH' WHEN filled < quantity THEN 'PARTIAL' ELSE 'APPROXIMATED_FILL' END AS status FROM f""")
def sc_27(spark, sf_dir):
    """One order of each security against every one of its bars."""
    side, limit = F.when(F.col("security_id") % 2 == 0, "BUY").otherwise("SELL"), (1100 + F.col("security_id") % 400).cast("double")
    fill = fills.bar_fill(side, F.lit(15), limit, F.lit("1995-01-02").cast("date"), F.col("session"), F.col("end"), F.col("low"), F.col("high"), F.col("volume"), 0.1)
    return weekly_bars(spark, sf_dir).select("security_id", "session", fill.alias("f")).select("security_id", "session", "f.filled", "f.price", "f.status")


#: Line items as trades; splits of two for one and three for two, a dividend each July of which some are never paid, some twice.
_SQL_EVENTS = """tr AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS at_, CAST(l_quantity AS DOUBLE) AS amount, l_orderkey * 10 + l_linenumber AS event_id FROM lineitem),
sp AS (SELECT s_suppkey AS security_id, DATE '1995-06-01' AS at_, CASE s_suppkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.5 ELSE 0.0 END AS amount, -1 AS event_id FROM supplier UNION ALL SELECT s_suppkey, DATE '1997-03-03', 3.0, -2 FROM supplier WHERE s_suppkey % 3 = 0),
ok AS (SELECT * FROM sp WHERE amount > 0),
ex AS (SELECT s_suppkey AS security_id, make_date(y, 7, 1) AS at_, CASE WHEN s_suppkey % 9 = 0 THEN -1.0 ELSE 0.25 * (1 + s_suppkey % 4) END AS amount, -100 - y AS event_id FROM supplier, range(1993, 1999) r(y)),
pay AS (SELECT security_id, CASE WHEN event_id = -2095 THEN at_ - 10 ELSE at_ + 45 END AS at_, event_id AS claim, event_id - 1000 AS event_id FROM ex WHERE security_id % 5 <> 0 UNION ALL SELECT security_id, at_ + 90, event_id, event_id - 2000 FROM ex WHERE security_id % 7 = 0)"""
_SQL_HOLDING = "(SELECT coalesce(sum(t.amount * (SELECT coalesce(product(k.amount), 1) FROM ok k WHERE k.security_id = t.security_id AND k.at_ > t.at_ AND {until})), 0) FROM tr t WHERE t.security_id = {of}.security_id AND t.at_ < {of}.at_)"


def dated_events(spark, sf_dir):
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    key = F.col("security_id")
    trades = li.select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("at"), F.lit("trade").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("event_id"), F.col("l_quantity").cast("double").alias("amount"))
    ratio = F.element_at(F.array(*map(F.lit, (2.0, 1.5, 0.5, 0.0))), (key % 4 + 1).cast("int"))
    date = lambda text: F.lit(text).cast("date")
    splits = s.select(key, date("1995-06-01").alias("at"), F.lit("split").alias("kind"), F.lit(-1).cast("long").alias("event_id"), ratio.alias("amount"))
    splits = splits.unionByName(s.where("security_id % 3 = 0").select(key, date("1997-03-03").alias("at"), F.lit("split").alias("kind"), F.lit(-2).cast("long").alias("event_id"), F.lit(3.0).alias("amount")))
    year = s.withColumn("y", F.explode(F.sequence(F.lit(1993), F.lit(1998))))
    ex = year.select(key, F.make_date("y", F.lit(7), F.lit(1)).alias("at"), F.lit("dividend_ex").alias("kind"), (-100 - F.col("y")).cast("long").alias("event_id"), F.when(key % 9 == 0, -1.0).otherwise(0.25 * (1 + key % 4)).alias("amount"))
    first = ex.where("security_id % 5 != 0").select(key, F.when(F.col("event_id") == -2095, F.date_sub("at", 10)).otherwise(F.date_add("at", 45)).alias("at"), (F.col("event_id") - 1000).alias("event_id"), F.col("event_id").alias("entitlement"))
    again = ex.where("security_id % 7 = 0").select(key, F.date_add("at", 90).alias("at"), (F.col("event_id") - 2000).alias("event_id"), F.col("event_id").alias("entitlement"))
    pays = first.unionByName(again).withColumn("kind", F.lit("dividend_pay"))
    return trades.unionByName(splits).unionByName(ex).unionByName(pays, allowMissingColumns=True)


def positions(spark, sf_dir):
    return ev.held(dated_events(spark, sf_dir), panels.tasks(read(spark, sf_dir, "lineitem")))


@query("ca_02_dated_splits", f"""WITH {_SQL_EVENTS}, h AS (SELECT sp.*, {_SQL_HOLDING.format(of="sp", until="k.at_ < sp.at_")} AS before FROM sp),
a AS (SELECT *, CASE WHEN amount > 0 THEN before * amount ELSE before END AS shares FROM h)
SELECT security_id, at_ AS effective_at, round(before, 6) + 0.0 AS before, round(shares, 6) + 0.0 AS shares, CASE WHEN amount <= 0 THEN 'INVALID_SPLIT' WHEN abs(shares - round(shares)) > 1e-9 THEN 'FRACTIONAL_SPLIT_CASH_IN_LIEU_REQUIRED' ELSE 'OK' END AS status FROM a""")
def ca_02(spark, sf_dir):
    """Each split with the shares before and after it: only what was held by then is split."""
    out = positions(spark, sf_dir).where("kind = 'split'")
    return out.select("security_id", F.col("at").alias("effective_at"), rounded(F.col("before")).alias("before"), rounded(F.col("shares")).alias("shares"), "status")


_SQL_CLAIMS = f"""{_SQL_EVENTS}, e AS (SELECT ex.*, {_SQL_HOLDING.format(of="ex", until="k.at_ <= ex.at_")} AS holding FROM ex),
c AS (SELECT security_id, event_id, at_ AS ex_at, holding, CASE WHEN amount >= 0 THEN holding * amount END AS entitlement FROM e),
p AS (SELECT pay.*, c.ex_at, c.holding, c.entitlement, row_number() OVER (PARTITION BY pay.security_id, claim, pay.at_ >= c.ex_at AND c.entitlement IS NOT NULL ORDER BY pay.at_, pay.event_id) AS k, coalesce(pay.at_ >= c.ex_at AND c.entitlement IS NOT NULL, false) AS may FROM pay JOIN c ON c.security_id = pay.security_id AND c.event_id = claim),
d AS (SELECT c.security_id, c.event_id, c.ex_at, c.holding, c.entitlement, p.at_ AS pay_at, CASE WHEN c.entitlement IS NULL THEN 'INVALID_DIVIDEND' WHEN p.at_ IS NULL THEN 'RECEIVABLE' ELSE 'PAID' END AS status FROM c LEFT JOIN p ON p.security_id = c.security_id AND p.claim = c.event_id AND may AND k = 1
UNION ALL SELECT security_id, event_id, CASE WHEN at_ >= ex_at THEN ex_at END, CASE WHEN at_ >= ex_at THEN holding END, CASE WHEN at_ >= ex_at THEN entitlement END, at_, CASE WHEN may AND k = 1 THEN 'PAYMENT' ELSE 'UNKNOWN_OR_PAID_ENTITLEMENT' END FROM p)"""


@query("ca_03_dividend_claims", f"WITH {_SQL_CLAIMS} SELECT security_id, event_id, ex_at, round(holding, 6) + 0.0 AS holding, round(entitlement, 6) + 0.0 AS entitlement, pay_at, status FROM d")
def ca_03(spark, sf_dir):
    """Entitlements on the holdings of ex dates, and what became of each payment."""
    out = ev.dividends(positions(spark, sf_dir))
    return out.select("security_id", "event_id", "ex_at", rounded(F.col("holding")).alias("holding"), rounded(F.col("entitlement")).alias("entitlement"), "pay_at", "status")


@query("ca_03_receivables", f"""WITH {_SQL_CLAIMS}, t AS (SELECT DISTINCT at_ FROM (SELECT ex_at AS at_ FROM d WHERE status IN ('PAID', 'RECEIVABLE') UNION ALL SELECT pay_at FROM d WHERE status = 'PAID'))
SELECT at_ AS session, round((SELECT sum(entitlement) FROM d WHERE status IN ('PAID', 'RECEIVABLE') AND ex_at <= at_ AND (pay_at IS NULL OR at_ < pay_at)), 4) + 0.0 AS receivable FROM t""")
def ca_03_receivables(spark, sf_dir):
    """What is due between ex dates and payments, on each date that changes it."""
    out = ev.receivables(ev.dividends(positions(spark, sf_dir)))
    return out.select(F.col("at").alias("session"), rounded(F.coalesce("receivable", F.lit(0.0)), 4).alias("receivable"))


#: Events as quotes at one time; each fault occurs by rule.
_NOW, _AGE, _SKEW = "2024-01-31 00:00:00", 10 * 86_400, 20 * 86_400
_SQL_QUOTES = f"""q AS (SELECT user_id AS security_id, event_id, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 0.0 ELSE value END AS bid, CASE WHEN event_id % 29 = 0 THEN value - 1 ELSE value + 0.5 END AS ask, CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts END AS quote_time,
  CASE WHEN event_id % 37 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 1 MINUTE END AS received_at, CASE WHEN event_id % 11 = 0 THEN 'OTHER' ELSE 'SIP' END AS feed, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 47 = 0 END AS delayed,
  CASE WHEN event_id % 17 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN event_id % 53 = 0 THEN 'PRE' ELSE 'REGULAR' END AS session, CASE WHEN event_id % 59 = 0 THEN NULL ELSE event_id % 61 = 0 END AS halted FROM events)"""


@query("ca_07_quote_reasons", f"""WITH {_SQL_QUOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY event_id) AS k, TIMESTAMP '{_NOW}' AS now FROM q),
f AS (SELECT security_id, unnest(list_filter([CASE WHEN k > 1 THEN '01 DUPLICATE_QUOTE' END, CASE WHEN bid IS NULL OR ask IS NULL THEN '03 INVALID_QUOTE' WHEN NOT (0 < bid AND bid <= ask) THEN '02 CROSSED_OR_INVALID_QUOTE' END,
  CASE WHEN quote_time IS NULL OR received_at IS NULL THEN '06 UNKNOWN_QUOTE_TIME' WHEN NOT (quote_time <= received_at AND received_at <= now) THEN '04 QUOTE_TIME_ORDER' END, CASE WHEN quote_time IS NOT NULL AND received_at IS NOT NULL AND epoch(now) - epoch(quote_time) > {_AGE} THEN '05 STALE_QUOTE' END,
  CASE WHEN feed <> 'SIP' THEN '07 FEED_MISMATCH' END, CASE WHEN delayed IS NULL OR delayed THEN '08 DELAYED_OR_UNKNOWN_FEED' END, CASE WHEN currency <> 'USD' OR session <> 'REGULAR' THEN '09 INVALID_CURRENCY_OR_SESSION' END, CASE WHEN halted IS NULL OR halted THEN '10 HALTED_OR_UNKNOWN' END,
  CASE WHEN (SELECT epoch(max(quote_time)) - epoch(min(quote_time)) FROM q WHERE received_at IS NOT NULL) > {_SKEW} THEN '11 QUOTE_SKEW' END], lambda x: x IS NOT NULL)) AS reason FROM r)
SELECT security_id, coalesce(string_agg(substr(reason, 4), '|' ORDER BY reason), '') AS reasons FROM (SELECT DISTINCT security_id FROM q) LEFT JOIN (SELECT DISTINCT * FROM f) USING (security_id) GROUP BY 1""")
def ca_07(spark, sf_dir):
    """All reasons against the quotes of each security."""
    e, key = read(spark, sf_dir, "events"), F.col("event_id")
    minute = F.expr("interval 1 minute")
    quotes = e.select(
        F.col("user_id").alias("security_id"), key.alias("seq"), F.when(key % 19 == 0, F.lit(None)).when(key % 23 == 0, 0.0).otherwise(F.col("value")).alias("bid"), F.when(key % 29 == 0, F.col("value") - 1).otherwise(F.col("value") + 0.5).alias("ask"),
        F.when(key % 31 != 0, F.col("ts")).alias("quote_time"), F.when(key % 37 == 0, F.col("ts") - minute).otherwise(F.col("ts") + minute).alias("received_at"), F.when(key % 11 == 0, "OTHER").otherwise("SIP").alias("feed"),
        F.when(key % 13 != 0, key % 47 == 0).alias("delayed"), F.when(key % 17 == 0, "EUR").otherwise("USD").alias("currency"), F.when(key % 53 == 0, "PRE").otherwise("REGULAR").alias("session"), F.when(key % 59 != 0, key % 61 == 0).alias("halted"))
    out = ac.quote_reasons(quotes, F.lit(_NOW).cast(e.schema["ts"].dataType), "SIP", _AGE, _SKEW)
    return out.select("security_id", F.concat_ws("|", "reasons").alias("reasons"))
