"""Document fingerprints by winnowing, in DataFrame functions only.

Words (cut at spaces and tabs to carriage returns, lower-cased; the characters of runs of over 64 of them) are hashed to numbers below the prime 2**31 - 1; a k-gram's
hash is their polynomial in ``BASE`` modulo the prime, the value a rolling hash takes there. Of each window of ``w``
successive k-grams the least hash is chosen, the rightmost on ties, and kept with its place. Two texts that share
``w + k - 1`` words in a row therefore share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACE_CLASS, staged, table

PRIME, BASE = (1 << 31) - 1, 1_000_003
K_WORDS, WINDOW = 5, 8
#: A longer run without spaces (a script without them, an encoded block) counts as words of one character each.
MOST_LETTERS = 64
#: A chosen k-gram is one number: its hash above 32 bits that fall as its place grows, so that the least is the rightmost.
_PLACES = (1 << 32) - 1


def chosen(text: Column, k: int = K_WORDS, window: int = WINDOW) -> Column:
    """The chosen k-grams of a text, as numbers ``hash << 32 | (2**32 - 1 - place)``, in order of place.

    Null and empty texts, and texts without words, have none; with fewer words than k, the whole sequence is one k-gram;
    with fewer k-grams than a window, all are one window.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(lowered, f"{SPACE_CLASS}+"), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > MOST_LETTERS, F.split(w, "")).otherwise(F.array(w))))
    words = F.when(lowered.rlike(f"[^{SPACE_CLASS[1:-1]}]{{{MOST_LETTERS + 1}}}"), cut).otherwise(words)
    hashes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    # each expression is bound once, by a lambda over an array of one
    return F.flatten(F.transform(F.array(hashes), lambda h: _grams(h, k, window)))


def _grams(hashes: Column, k: int, window: int) -> Column:
    # Horner's rule over each run of k numbers; a sum of a product below 2**51 and a number below 2**31 stays exact
    def gram(h: Column, i: Column) -> Column:
        value = h
        for j in range(1, k):
            value = (value * BASE + F.coalesce(F.get(hashes, i + j), F.lit(0))) % PRIME
        return value

    starts = F.greatest(F.size(hashes) - (k - 1), F.least(F.size(hashes), F.lit(1)))
    packed = F.transform(F.slice(hashes, F.lit(1), starts), lambda h, i: gram(h, i) * (1 << 32) + (F.lit(_PLACES) - i))
    # minima of windows of 2, 4, ... by doubling; the last step makes up the rest of the window
    def halved(step: int):
        return lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + step)))

    span, least = 1, packed
    while span < window:
        step = min(span, window - span)
        least = F.flatten(F.transform(F.array(least), halved(step)))
        span += step
    # windows that reach past the end are left out, but a short text keeps its first
    whole = F.flatten(F.transform(F.array(least), lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (window - 1), F.least(F.size(m), F.lit(1))))))
    return F.array_distinct(whole)


def fingerprint_text(chosen_grams: Column) -> Column:
    """``place:hash`` of each chosen k-gram, comma-joined; the hash in hexadecimal."""
    return F.array_join(F.transform(chosen_grams, lambda x: F.concat((F.lit(_PLACES) - (x % (1 << 32))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(x, 32))))), ",")


def hash_set(chosen_grams: Column) -> Column:
    return F.array_distinct(F.transform(chosen_grams, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of chosen hashes (0 to 1); two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS, window: int = WINDOW) -> DataFrame:
    """Rows (id, grams, fingerprint), one for each row of ``docs``; equal texts have equal fingerprints."""
    rows = docs.select(F.col(id_col).alias("id"), chosen(F.col(text_col), k, window).alias("grams"))
    return rows.withColumn("fingerprint", fingerprint_text(F.col("grams")))


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows (id, next_id, need): for each distinct id the next in order, after the last the first, and how many code points
    at most the documents before it take from its text.

    Ids are sorted in ranges; each range looks ahead within itself, and its last id looks to the first of the next range.
    Only ids and lengths are moved, and only one id per range meets in one task.
    """
    lengths = docs.groupBy("id").agg(F.max("n").alias("n"))
    ranged = staged(lengths.repartitionByRange("id").select("id", "n", F.spark_partition_id().alias("range")), "ranges")
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    order = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("then"))
    ahead = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    nexts = ranged.withColumn("ahead", ahead).join(firsts, "range").select("id", "n", F.coalesce("ahead", "then").alias("next_id"))
    nexts = staged(nexts, "nexts")
    need = nexts.select(F.col("next_id").alias("id"), F.floor(F.col("n") / 4).cast("int").alias("need"), F.col("id").alias("before"))
    return nexts.select("id", "next_id").join(need, "id", "left")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS, window: int = WINDOW) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next document by
    id; after the last id comes the first. Rows without an id are followed by nothing: an empty text. Where rows repeat an
    id, the one whose text's beginning sorts first stands for it as a next document. Null texts are empty texts, which are
    alike; very long ones are taken whole. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = _neighbours(rows.where("id is not null").select("id", F.length("text").alias("n")))
    grams = chosen(F.col("text"), k, window)
    # both joins move the texts by id, in the same way, so Spark moves them once; a key that is never null keeps it so
    keyed = rows.join(order, "id", "left").withColumn("before", F.coalesce("before", F.lit(-(1 << 63))))
    told = keyed.select(F.col("before").alias("id"), F.expr("left(text, need)").alias("head"), hash_set(grams).alias("next_set"))
    told = told.groupBy("id").agg(F.min(F.struct("head", "next_set")).alias("told")).select("id", "told.head", "told.next_set")
    both = rows.join(told, "id", "left")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut))
    both = both.select("id", n.cast("long").alias("n_chars"), grams.alias("grams"), edited.alias("edited"), F.coalesce("next_set", F.array().cast("array<bigint>")).alias("next_set"))
    both = both.withColumn("edited_grams", chosen(F.col("edited"), k, window))
    own = hash_set(F.col("grams"))
    return both.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("grams")).alias("fingerprint"), fingerprint_text(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(own, hash_set(F.col("edited_grams"))).alias("near_edited"), likeness(own, F.col("next_set")).alias("near_next"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, long texts, ties and repeats as in ``edited_fingerprints``."""
    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
