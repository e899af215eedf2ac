"""Mixing sources to target weights by exact block quotas and a multivariate-hypergeometric splitting tree.

Targets are words per source: shares by weight, capped at ``most_epochs`` times the source's size, the excess shared again.
Every source has a fixed random order of its documents for each epoch. A mix takes that order up to the target: whole bins
of documents by sums alone, and within the bin where the target falls every further document that still fits. So no source
is ever sorted or gathered as a whole.

What a source's mix takes is cut into blocks, epoch by epoch. The quotas of all sources are dealt to output shards by a tree:
each node halves its shards, and the blocks of each source that go left are one multivariate hypergeometric draw, so all
quotas come out exactly. The blocks themselves are drawn for these quotas in a random order of each source's blocks, so
each shard gets a fair sample of all epochs. Within a shard, rows are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD_CLASS, staged, table

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MOST_EPOCHS = 1.5, 2
BIN_DOCS, MOST_BINS = 256, 1 << 16
BLOCK_WORDS, SHARD_WORDS, LEAST_SHARDS = 1 << 16, 1 << 23, 8
#: Blocks of one source that are put in random order by one task, about.
CELL_BLOCKS = 1 << 12
#: Up to so many sources, their targets are sent to every task (about 200 bytes and a long per shard each).
SENT_SOURCES = 10_000
SEED = 20_240_101


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Rows (source, source_size, n_docs, target) from rows (source, source_size, n_docs).

    Sources in code point order, null last, have the weights in turn. The water level at which a source's weight reaches its
    cap is cap / weight; with sources sorted by it, the final level follows from running sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumns({"cap": F.col("source_size") * float(most_epochs), "level": F.col("source_size") * float(most_epochs) / F.col("weight")})
    whole = Window.partitionBy()
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "left": F.sum("source_size").over(whole) * total_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the first source that the remaining level does not fill sets the level of all after it
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy("level", F.col("source").asc_nulls_last())))
    at = F.when(F.col("left") <= F.col("level") * F.col("open"), F.struct("rank", (F.col("left") / F.col("open")).alias("water")))
    rows = rows.withColumn("water", F.min(at).over(whole)["water"])
    return rows.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _chance(*parts: Column) -> Column:
    """A fixed random number of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 2)


def _fitting(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bin in random order, each document that still fits into what the target leaves."""
    frame, keep, room = frame.sort_values(["chance", "key"]), [], float(frame["room"].iloc[0])
    for size in frame["size"]:
        keep.append(size <= room)
        room -= size if keep[-1] else 0
    return frame.loc[keep, ["place", "epoch", "key"]]


def _split(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """A node's quotas, divided between the halves of its shards."""
        frame = frame.sort_values("place")
        lo, hi = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
        if hi - lo < 2:
            return frame[["place", "lo", "hi", "blocks"]]
        mid, quota = (lo + hi) // 2, frame["blocks"].to_numpy(np.int64)
        total = int(quota.sum())
        share = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(quota, share, method="marginals") if total else quota
        halves = pd.concat([frame.assign(lo=lo, hi=mid, blocks=left), frame.assign(lo=mid, hi=hi, blocks=quota - left)])[["place", "lo", "hi", "blocks"]]
        return halves[halves["blocks"] > 0]

    return run


def _dealt(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (place, block, shard): the shard of every block of each source."""
    quotas = quotas.where("blocks > 0")
    now = quotas.select("place", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "blocks")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        now = now.groupBy("lo", "hi").applyInPandas(_split(seed), "place long, lo long, hi long, blocks long")
    upto = Window.partitionBy("place").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    runs = now.withColumn("end", F.sum("blocks").over(upto))
    drawn = runs.select("place", F.explode(F.sequence(F.col("end") - F.col("blocks"), F.col("end") - 1)).alias("draw"), F.col("lo").alias("shard"))
    return _permuted(quotas, seed).join(drawn, ["place", "draw"]).select("place", "block", "shard")


def _permuted(quotas: DataFrame, seed: int) -> DataFrame:
    """Rows (place, block, draw): each source's blocks in a random order, fixed by the seed.

    The order is that of a hash, found in cells of the hash range: a cell has some thousand blocks, so a source of any size is
    sorted in parts, and the cells' counts give each part its first place.
    """
    runs = quotas.select("place", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CELL_BLOCKS))).alias("run"))
    of_run = F.explode(F.sequence(F.col("run") * CELL_BLOCKS, F.least(F.col("blocks"), (F.col("run") + 1) * CELL_BLOCKS) - 1))
    rows = runs.select("place", F.ceil(F.col("blocks") / CELL_BLOCKS).alias("cells"), of_run.alias("block"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("place"), F.col("block")), 2)
    width = F.floor(F.lit(float(1 << 62)) / F.col("cells")).cast("long") + 1
    rows = rows.select("place", "block", chance.alias("chance"), F.floor(chance / width).alias("cell"))
    counts = rows.groupBy("place", "cell").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("place", "cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("place", "cell").orderBy("chance", "block"))
    return rows.withColumn("within", within).join(before, ["place", "cell"]).select("place", "block", (F.col("before") + F.col("within") - 1).alias("draw"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most_epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Which documents the mix takes: (id, key, source, size, source_size, target, places), a row for each row of ``docs``.

    ``size`` counts words (runs without spaces and tabs to carriage returns; null: 0), of whole texts however long. ``places``
    has a struct (epoch, block, shard, at) for each time the document is taken, at most ``most_epochs``. A block is a run of
    about ``BLOCK_WORDS`` words of the source's random order, and each block goes to one shard, drawn at random; rows of a shard,
    ordered by ``at``, are its shuffled output. A null source is a source of its own. Rows that repeat an id within a source are taken
    together; a row without an id goes by its text. Documents without words are never taken. The result depends on ids,
    sizes, sources and the seed alone, and ties of the random order go by id. An empty table gives no rows; other columns are
    not read, so their names can't clash.
    """
    if most_epochs < total_share:
        raise ValueError("the sources can't give so many words")
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "sizes")
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    bins = F.least(F.lit(MOST_BINS), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / BIN_DOCS))))).cast("long")
    aims = targets(sized, weights, total_share, most_epochs)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    aims = staged(aims.select(place.alias("place"), "source", "source_size", "target", bins.alias("bins")), "targets")
    sent = (lambda df: F.broadcast(df)) if aims.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES else (lambda df: df)

    named = rows.join(sent(aims.select("place", F.col("source").alias("of"), "bins")), F.col("source").eqNullSafe(F.col("of"))).where("size > 0")
    units = named.groupBy("place", "key").agg(F.sum("size").alias("size"), F.first("bins").alias("bins"))
    epochs = units.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))))
    epochs = epochs.withColumn("chance", _chance(F.col("epoch"), F.col("key"))).withColumn("bin", F.col("chance") % F.col("bins")).drop("bins")
    epochs = staged(epochs, "epochs")
    sums = epochs.groupBy("place", "epoch", "bin").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("place").orderBy("epoch", "bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("words").over(order)).join(sent(aims.select("place", "target")), "place")
    # all bins that end by the target are taken whole; of the bin where it falls, what still fits into the room that is left
    sums = sums.withColumn("start", F.col("end") - F.col("words")).where(F.col("start") < F.col("target"))
    sums = staged(sums.select("place", "epoch", "bin", "start", (F.col("end") > F.col("target")).alias("edge"), (F.col("target") - F.col("start")).alias("room")), "bins")
    cut = epochs.join(sums, ["place", "epoch", "bin"])
    fitting = cut.where("edge").groupBy("place").applyInPandas(_fitting, "place long, epoch int, key string").withColumn("fits", F.lit(True))
    partly = cut.where("edge").join(fitting, ["place", "epoch", "key"], "left_semi").select(*cut.columns)
    taken = cut.where("not edge").unionByName(partly)
    # the words before a document in its source's order say which block it is of
    before = F.sum("size").over(Window.partitionBy("place", "epoch", "bin").orderBy("chance", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = taken.withColumn("block", F.floor((F.col("start") + before) / BLOCK_WORDS)).select("place", "key", "epoch", "size", "block")
    taken = staged(taken, "taken")

    quotas = staged(taken.groupBy("place").agg((F.max("block") + 1).alias("blocks"), F.sum("size").alias("words")), "quotas")
    total = quotas.agg(F.sum("words")).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(total / SHARD_WORDS))
    placed = taken.join(staged(_dealt(quotas, shards, seed), "shards"), ["place", "block"])
    at = _chance(F.col("epoch"), F.col("key"), F.lit("at"))
    placed = placed.groupBy("place", "key").agg(F.sort_array(F.collect_list(F.struct("epoch", "block", "shard", at.alias("at")))).alias("places"))

    out = rows.join(sent(aims.drop("bins").withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    places = F.when(F.col("size") > 0, F.col("places"))
    out = out.join(placed, ["place", "key"], "left").withColumn("places", F.coalesce(places, F.array().cast(dict(placed.dtypes)["places"])))
    return out.select("id", "key", "source", "size", "source_size", "target", "places")


def row_key(id_: Column, text: Column) -> Column:
    """What names a row within its source: its id, or its text where there is none."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and places: ``epoch:block:shard`` of each time it is taken, comma-joined.
    Words taken are counted over these places. Nulls, long texts, ties and repeats as in ``mix``."""
    found = mix(table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["epoch"].cast("string"), p["block"].cast("string"), p["shard"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"), places.alias("places"))


def mixing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: sizes, targets, and that no bound is broken."""
    found = op6_mixing(spark, sf_dir)
    far = F.col("taken") > 2 * F.col("size")
    off = F.abs(F.sum("taken").over(Window.partitionBy("source_size", "target")) - F.col("target")) > 0.01 * F.col("target") + 100
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), far.alias("too_often"), off.alias("off_target"))


#: Water filling in SQL: in each round the sources above their cap are filled, and the rest shared again.
BOUNDS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY 1),
w AS (SELECT place, source_size, [5, 2, 1][(place - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT 0 AS round, []::BIGINT[] AS filled
  UNION ALL SELECT round + 1, (SELECT list(place ORDER BY place) FROM w WHERE list_contains(r.filled, place) OR weight *
    ((SELECT 1.5 * sum(source_size) FROM w) - coalesce((SELECT 2 * sum(source_size) FROM w WHERE list_contains(r.filled, place)), 0)) / (SELECT sum(weight) FROM w WHERE NOT list_contains(r.filled, place)) > 2 * source_size)
  FROM r WHERE round < (SELECT count(*) FROM w) AND (SELECT count(*) FROM w WHERE NOT list_contains(r.filled, place)) > 0),
f AS (SELECT coalesce(filled, []) AS filled FROM r ORDER BY round DESC LIMIT 1),
t AS (SELECT place, CASE WHEN list_contains(filled, place) THEN 2.0 * source_size ELSE weight * ((SELECT 1.5 * sum(source_size) FROM w) - coalesce((SELECT 2 * sum(source_size) FROM w x WHERE list_contains(filled, x.place)), 0))
  / (SELECT sum(weight) FROM w x WHERE NOT list_contains(filled, x.place)) END AS target FROM w, f)
SELECT doc_id, size, source_size, round(target, 6)::DOUBLE AS target, false AS too_often, false AS off_target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source JOIN t USING (place)
"""


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, dealt to its shards and shuffled in each.

    A row is found again by its id, or its text without one, within its source; null sources and rows that repeat are taken
    as ``mix`` says. All columns pass through, whatever their names.
    """
    places = mix(docs, id_col, text_col, source_col, **options).where(F.size("places") > 0)
    places = places.select(F.col("key").alias("__key"), F.col("source").alias("__source"), F.explode("places").alias("__place")).distinct()
    keyed = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col)))
    rows = keyed.join(places, (keyed["__row"] == places["__key"]) & keyed[source_col].cast("string").eqNullSafe(places["__source"])).drop("__row", "__key", "__source")
    # shards are of like size, and a range of them is one task
    return rows.repartitionByRange("__place.shard", "__place.at").sortWithinPartitions("__place.shard", "__place.at").drop("__place")
