"""Limit orders against bars: the test of one bar, and the first bar that reaches an order's limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.shared import written

#: Bars of one block, and blocks of one block of blocks.
WIDTH = 64


def valid_order(side: Column, quantity: Column, limit: Column) -> Column:
    """Whether an order is one: a side, whole shares, a price above zero."""
    whole = (quantity >= 0) & (quantity == F.floor(quantity))
    return F.coalesce(side.isin("BUY", "SELL") & whole & (limit > 0), F.lit(False))


def touched(side: Column, limit: Column, low: Column, high: Column) -> Column:
    """A bar trades through the limit: strictly below a buyer's, strictly above a seller's."""
    return ((side == "BUY") & (low < limit)) | ((side == "SELL") & (high > limit))


def filled(quantity: Column, volume: Column, participation: float) -> Column:
    """What a bar's volume gives at most."""
    if not 0 < participation <= 1:
        raise ValueError("INVALID_FILL_INPUT")
    return F.least(quantity.cast("long"), F.floor(volume * participation).cast("long"))


def bar_fill(side: Column, quantity: Column, limit: Column, submitted: Column, start: Column, end: Column, low: Column, high: Column, volume: Column, participation: float) -> Column:
    """Struct (filled, price, available_at, status) of one order against one bar: a conservative approximation.

    Bars that begin before the order exclude it; without a touch nothing fills; else the volume's share does, in part or whole.
    """
    bad = ~valid_order(side, quantity, limit) | ~F.coalesce((end > start) & (volume >= 0) & (low > 0) & (high >= low), F.lit(False))
    hit = ~bad & (start >= submitted) & touched(side, limit, low, high)
    n = F.when(hit, filled(quantity, volume, participation)).otherwise(F.lit(0).cast("long"))
    status = F.when(bad, "INVALID_FILL_INPUT").when(start < submitted, "PRE_SUBMISSION_BAR_EXCLUDED").when(~hit, "NO_TOUCH").when(n < quantity, "PARTIAL").otherwise("APPROXIMATED_FILL")
    return F.struct(n.alias("filled"), F.when(n > 0, limit).alias("price"), F.when(n > 0, end).alias("available_at"), status.alias("status"))


def _nodes(bars: DataFrame, levels: int) -> DataFrame:
    """Blocks of ``WIDTH`` bars of a security, blocks of blocks and so on: rows (security_id, level, node, lows, highs, ...).

    The arrays have the least low and greatest high of each part, in order; those of level 1 also session, end and volume.
    """
    part = F.col("pos") % WIDTH
    packed = F.sort_array(F.collect_list(F.struct(part.alias("part"), "low", "high", "session", "end", "volume")))
    leaves = bars.groupBy("security_id", F.floor(F.col("pos") / WIDTH).cast("long").alias("node")).agg(packed.alias("p"))
    out = leaves.select("security_id", F.lit(1).alias("level"), "node", *(F.col(f"p.{c}").alias(c) for c in ("low", "high", "session", "end", "volume")))
    rows = leaves.select("security_id", "node", F.array_min("p.low").alias("low"), F.array_max("p.high").alias("high"))
    for level in range(2, levels + 1):
        packed = F.sort_array(F.collect_list(F.struct((F.col("node") % WIDTH).alias("part"), "low", "high")))
        rows = rows.groupBy("security_id", F.floor(F.col("node") / WIDTH).cast("long").alias("node")).agg(packed.alias("p"))
        rows = rows.select("security_id", "node", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
        out = out.unionByName(rows.withColumn("level", F.lit(level)), allowMissingColumns=True)
        rows = rows.select("security_id", "node", F.array_min("low").alias("low"), F.array_max("high").alias("high"))
    return out


def _first(side: Column, limit: Column, low: Column, high: Column, start: Column) -> Column:
    """The place of the first part from ``start`` on that the limit reaches, or NULL; parts are dense from the first."""
    hits = F.transform(F.when(side == "BUY", low).otherwise(high), lambda x, i: F.when((i >= start) & F.when(side == "BUY", x < limit).otherwise(x > limit), i))
    return F.array_min(hits)


def first_touch(orders: DataFrame, bars: DataFrame, participation: float = 0.1) -> DataFrame:
    """Each order with the first bar that begins after it was submitted and reaches its limit: ``orders`` and (session, filled,
    price, available_at, status).

    ``orders``: order_id, security_id, side, quantity, limit, submitted. ``bars``: security_id, session, end, low, high, volume,
    one for each security and session. An order that is none is INVALID_FILL_INPUT; one without any later bar is
    PRE_SUBMISSION_BAR_EXCLUDED, without a touch NO_TOUCH, else PARTIAL or APPROXIMATED_FILL.

    An order doesn't meet all later bars. Bars are numbered and kept in a tree of blocks with the least low and greatest high:
    an order looks at the rest of its block, of its block of blocks and so on, and then goes down to the bar. So it meets two
    rows for each level of the tree, by equal keys.
    """
    names = ("side", "quantity", "limit", "submitted")
    kind = orders.schema["submitted"].dataType
    # one sequence of bars and orders counts the bars before each order; an order stands before a bar that begins with it
    marks = bars.select("security_id", F.col("session").cast(kind).alias("at"), F.lit(1).alias("is_bar"), F.struct("session", "end", "low", "high", "volume").alias("bar"))
    asked = orders.select("security_id", F.col("submitted").alias("at"), F.lit(0).alias("is_bar"), F.struct("order_id", *names).alias("o"))
    order = Window.partitionBy("security_id").orderBy("at", "is_bar").rowsBetween(Window.unboundedPreceding, -1)
    numbered = written(marks.unionByName(asked, allowMissingColumns=True).withColumn("pos", F.coalesce(F.sum("is_bar").over(order), F.lit(0))), "numbered-bars")
    placed_bars = numbered.where("is_bar = 1").select("security_id", "pos", "bar.*")
    placed = numbered.where("is_bar = 0").select("security_id", "pos", "o.*")
    most, levels = placed_bars.agg(F.max("pos")).first()[0] or 0, 1
    while WIDTH**levels <= most:
        levels += 1
    nodes = _nodes(placed_bars, levels)

    good = valid_order(F.col("side"), F.col("quantity"), F.col("limit"))
    # going up: at each level the node that holds the order's place, from the part after it (at the first, from its own)
    climb = placed.where(good).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    own = F.floor(F.col("pos") / F.pow(F.lit(float(WIDTH)), F.col("level") - 1)).cast("long")
    climb = climb.withColumns({"node": F.floor(own / WIDTH).cast("long"), "from": own % WIDTH + F.when(F.col("level") > 1, 1).otherwise(0)})
    hit = _first(F.col("side"), F.col("limit"), F.col("low"), F.col("high"), F.col("from"))
    up = climb.join(nodes.select("security_id", "level", "node", "low", "high"), ["security_id", "level", "node"]).withColumn("hit", hit)
    found = up.groupBy("security_id", "order_id", *names).agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct("level", (F.col("node") * WIDTH + F.col("hit")).alias("child")))).alias("at"))
    at = found.where("at is not null").select("security_id", "order_id", *names, (F.col("at.level") - 1).alias("level"), F.col("at.child").alias("node"))
    # going down: the first part that the limit reaches, one level at a time; level 0 is a bar
    for level in range(levels - 1, 0, -1):
        here = at.where(F.col("level") == level).join(nodes.where(F.col("level") == level).select("security_id", "node", "low", "high"), ["security_id", "node"])
        down = here.select("security_id", "order_id", *names, F.lit(level - 1).alias("level"), (F.col("node") * WIDTH + _first(F.col("side"), F.col("limit"), F.col("low"), F.col("high"), F.lit(0))).alias("node"))
        at = at.where(F.col("level") != level).unionByName(down)
    part = (F.col("pos") % WIDTH).cast("int")
    leaf = nodes.where("level = 1").select("security_id", "node", "session", "end", "volume")
    bar = at.select("security_id", "order_id", F.col("node").alias("pos")).withColumn("node", F.floor(F.col("pos") / WIDTH).cast("long")).join(leaf, ["security_id", "node"])
    bar = bar.select("order_id", *(F.get(F.col(c), part).alias(c) for c in ("session", "end", "volume")))
    total = placed_bars.groupBy("security_id").agg(F.count("*").alias("n_bars"))
    out = placed.join(total, "security_id", "left").join(bar, "order_id", "left")
    n = F.when(F.col("session").isNotNull(), filled(F.col("quantity"), F.col("volume"), participation)).otherwise(F.lit(0).cast("long"))
    status = F.when(~good, "INVALID_FILL_INPUT").when(F.coalesce("n_bars", F.lit(0)) <= F.col("pos"), "PRE_SUBMISSION_BAR_EXCLUDED").when(F.col("session").isNull(), "NO_TOUCH").when(n < F.col("quantity"), "PARTIAL").otherwise("APPROXIMATED_FILL")
    return out.select("order_id", "security_id", *names, "session", n.alias("filled"), F.when(n > 0, F.col("limit")).alias("price"), F.when(n > 0, F.col("end")).alias("available_at"), status.alias("status"))
