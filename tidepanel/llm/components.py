"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, staged


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u > v): each neighbour of a node is tied to the node's least neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.where(F.col("v") > F.col("u")) if large else both
    tied = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (id, component) for every id that has a link; component is the smallest id it can reach.

    ``links`` has two columns of ids in any order. Self links and repeated links are allowed. Neighbour lists are never
    gathered: each star is a minimum by node joined back to the links. Every round is written to the shared folder, and the one
    before it removed. Rounds grow with the logarithm of the longest chain; ``most_rounds`` only stops a fault.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = staged(now, "links")
    state = None
    for _ in range(most_rounds):
        before, now = now, staged(_starred(_starred(now, large=True), large=False), "stars")
        discard(before)
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = tuple(row)
    raise RuntimeError("the links did not settle into stars")
