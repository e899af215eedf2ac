"""Near duplicates by HyperMinHash sketches, banding, a corrected estimate and an exact check of full shingle sets.

Each set of word shingles is sketched in 128 registers of 16 bits: six bits for the leading zeros of the smallest hash of a
bucket and ten for the bits after its leading one. Larger sets are dealt into 8 buckets under 16 hash functions; small
sets, whose buckets would stand empty, use 128 hash functions over one bucket. Sets near the border have both sketches.
Four registers make a band key of 64 bits; two sets with similarity 0.75 share one of 32 bands but for a few in a million.

No pairs are made within a group of copies. Equal sets are one class. In each bucket of a band, the classes are first held
against the smallest class only, and each class against one such partner; what this links is joined up. Only classes of one
bucket that are still apart afterwards are then held against each other, so every candidate is either tested or already
connected. In small buckets these are all pairs; in large ones (many near copies of one text, some of them too far apart to be
linked) only pairs that share one of their rarest shingles at places that leave room for enough overlap, which loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import mix, seeds, staged, table
from tidepanel.llm.components import connected_components
from tidepanel.llm.shingles import shingle_sets

REGISTERS, BAND, MANTISSA = 128, 4, 10
LARGE_BUCKETS = 8
#: Sets of up to SMALL_SURE shingles are only sketched as small, those above SMALL_MOST only as large. The quotient of the
#: two is above 4/3, so that two sets of similarity 0.75 or more always have a kind of sketch in common.
SMALL_SURE, SMALL_MOST = 64, 86
_EMPTY = np.uint16(0xFFFF)
#: Buckets of up to so many classes compare all that are apart; larger ones by their rarest shingles.
NARROW = 32
#: Slots that count how common shingles are.
SLOT_BITS, SLOT_BLOCKS = 20, 256
#: Texts that share a token are compared in blocks of about so many.
TOKEN_BLOCK = 1024


def _register(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 64-bit minima."""
    part, power = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.clip(53 - power, 0, 62).astype(np.uint16)
    bits = np.where(part > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | bits


_SMALL_SEEDS, _LARGE_SEEDS = seeds(REGISTERS, 3), seeds(REGISTERS // LARGE_BUCKETS, 4)


def _minima(hashes: np.ndarray, salt: np.ndarray, step: int) -> np.ndarray:
    """Least hash of a set under each hash function, in runs of shingles that keep temporaries small."""
    return np.min([mix(hashes[i : i + step] ^ salt[:, None]).min(axis=1) for i in range(0, len(hashes), step)], axis=0)


def sketch(hashes: np.ndarray, small: bool) -> np.ndarray:
    """The registers of a set of sorted distinct 64-bit hashes."""
    if small:
        return _register(_minima(hashes, _SMALL_SEEDS, 1 << 12))
    out = np.full((len(_LARGE_SEEDS), LARGE_BUCKETS), _EMPTY)
    top = np.uint64(64 - LARGE_BUCKETS.bit_length() + 1)
    cut = np.searchsorted(hashes >> top, np.arange(LARGE_BUCKETS + 1, dtype=np.uint64))
    for b in range(LARGE_BUCKETS):
        if cut[b + 1] > cut[b]:
            out[:, b] = _register(_minima(hashes[cut[b] : cut[b + 1]], _LARGE_SEEDS, 1 << 14))
    return out.ravel()


def band_keys(registers: np.ndarray, small: bool) -> np.ndarray:
    bands = np.ascontiguousarray(registers).view(np.uint64)
    return mix(mix(bands) + seeds(len(bands), 5 + small))


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of two unrelated sets agree, n and m hashes to a bucket.

    The smallest of n uniform hashes has density n * exp(-n * x); a register holds x to a cell whose width is its octave's
    divided by the number of mantissas, so the chance sums, over octaves, width * n * m / (n + m) * (the fall of exp(-(n + m) * x)).
    """
    s = (n + m)[:, None]
    octave = np.arange(0, 63)[None, :]
    fall = np.exp(-s * 0.5 ** (octave + 1)) - np.exp(-s * 0.5**octave)
    return (0.5 ** (octave + 1 + MANTISSA) * (n * m)[:, None] / s * fall).sum(axis=1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sets by their registers (a row each), corrected for chance agreement."""
    filled = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=1)
    share = ((x == y) & (x != _EMPTY)).sum(axis=1) / np.maximum(filled, 1)
    chance = collision(n.astype(float), m.astype(float))
    return (share - chance) / (1 - chance)


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, one, two, small, large, keys, ends = [], [], [], [], [], [], [0]
                for hashes in shingle_sets(batch.column("text"), words):
                    n.append(len(hashes))
                    for names, x in zip((one, two), _names(hashes), strict=True):
                        names.append(x)
                    own, kept = [], [None, None]
                    if len(hashes):
                        for kind, fits in ((True, len(hashes) <= SMALL_MOST), (False, len(hashes) > SMALL_SURE)):
                            if fits:
                                registers = sketch(hashes, kind)
                                kept[not kind] = registers.tobytes()
                                own.append(band_keys(registers, kind))
                    small.append(kept[0])
                    large.append(kept[1])
                    keys += own
                    ends.append(ends[-1] + sum(map(len, own)))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(small, pa.binary()), pa.array(large, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["id", "n", "s1", "s2", "small", "large", "keys"])

    return run


_SKETCH = "id long, n long, s1 long, s2 long, small binary, large binary, keys array<long>"


def _likely(least: float):
    """Pairs whose estimated similarity reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k) for k in batch.schema.names}
            n, m = (np.asarray(col[k].to_numpy(zero_copy_only=False)) for k in ("na", "nb"))
            small = (n <= SMALL_MOST) & (m <= SMALL_MOST)
            good = np.zeros(len(n), bool)
            for kind, use in (("small", small), ("large", ~small & (n > SMALL_SURE) & (m > SMALL_SURE))):
                at = np.flatnonzero(use)
                if len(at):
                    x, y = (np.frombuffer(b"".join(col[f"{kind}_{side}"].take(pa.array(at)).to_pylist()), np.uint16).reshape(len(at), -1) for side in "ab")
                    share = 1 if kind == "small" else LARGE_BUCKETS
                    good[at] = estimate(x, y, n[at] / share, m[at] / share) >= least
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(good))

    return run


def _names(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed hashes, which name a set."""
    return int(mix(hashes + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)), int(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _hash_sets(words: int):
    """The sets of texts that have the names s1 and s2; other texts of the same id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                asked = zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
                sets = [x.tobytes() if _names(x) == name else None for x, name in zip(shingle_sets(batch.column("text"), words), asked, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "hashes"])
                yield out.filter(out.column("hashes").is_valid())

    return run


def _confirmed(percent: int):
    """Pairs whose full sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    def side(s: str) -> DataFrame:
        return classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("small").alias(f"small_{s}"), F.col("large").alias(f"large_{s}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(least), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets."""
    a, b = (sets.select(F.col("id").alias(s), F.col("hashes").alias(f"h{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(_confirmed(percent), "a long, b long")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each slot of the hash range, in blocks of slots."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for x in batch.column("hashes"):
            np.add.at(total, _slots(np.frombuffer(x.as_buffer(), np.int64)), 1)
    blocks = total.reshape(SLOT_BLOCKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """One block's counts over all tasks, of which there is one for each core."""
    total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [total.tobytes()]})


def _early(percent: int, counts):
    """Of each set the shingles that come first in the order from rare to common, as many as a linked partner must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, tokens, places, sizes = batch.slice(lo, 256), [], [], []
                for x in part.column("hashes"):
                    own = np.frombuffer(x.as_buffer(), np.int64)
                    most = len(own) + (-percent * len(own)) // 100 + 1
                    tokens.append(own[np.lexsort((own, counts.value[_slots(own)]))][:most])
                    places.append(np.arange(1, len(tokens[-1]) + 1))
                    sizes.append(len(own))
                times = [len(t) for t in tokens]
                at = pa.array(np.repeat(np.arange(len(times)), times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), part.column("id").take(at), part.column("label").take(at), pa.array(np.repeat(sizes, times), pa.int64()), pa.array(np.concatenate(places), pa.int64())],
                    ["token", "id", "label", "n", "place"])

    return run


def _blocked(early: DataFrame) -> DataFrame:
    """Rows (token, id, label, ...) of tokens that texts of different labels share, with the block ``own`` of the text, and the
    blocks it meets: from ``next`` on to ``blocks`` - 1, and from 0 to ``last``.

    A token of many texts is cut into blocks. A label with many texts has blocks of its own, which don't meet each other: its
    texts are never compared with each other, however many they are. Labels with few texts share blocks.
    """
    per = early.groupBy("token", "label").agg(F.count("*").alias("c"))
    whole = per.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("c").alias("total")).where("lo < hi").select("token", "total")
    parts = F.ceil(F.col("c") / TOKEN_BLOCK)
    many = per.where(F.col("c") > TOKEN_BLOCK / 2).join(whole.where(F.col("total") > TOKEN_BLOCK), "token").withColumn("parts", parts)
    before = F.sum("parts").over(Window.partitionBy("token").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    many = many.select("token", "label", "c", "parts", F.coalesce(before, F.lit(0)).alias("first"))
    large = many.groupBy("token").agg(F.sum("parts").alias("large_parts"), F.sum("c").alias("large_c"))
    whole = whole.join(large, "token", "left").fillna(0, ["large_parts", "large_c"]).withColumn("shared", F.ceil((F.col("total") - F.col("large_c")) / TOKEN_BLOCK))
    rows = early.join(whole.select("token", "shared", (F.col("shared") + F.col("large_parts")).alias("blocks")), "token").join(many.drop("c"), ["token", "label"], "left")
    alone, start = F.col("parts").isNotNull(), F.col("shared") + F.col("first")
    own = F.when(alone, start + F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("label"), F.greatest("shared", F.lit(1))))
    rows = rows.withColumns({"own": own, "next": F.when(alone, start + F.col("parts")).otherwise(own), "last": F.when(alone, start - 1).otherwise(own)})
    return rows.drop("shared", "parts", "first")


def _by_rarest(pool: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can be linked, from rows (id, label).

    Shingles are ordered from rare to common, the same for all sets; how common one is, is told by the count of its slot of the
    hash range, a table of fixed size that every task gets (8 MB). Two sets with enough overlap share a shingle early: at the
    first one, at places i and j, the overlap is at most 1 + min(n - i, m - j).
    """
    held = staged(sets.join(pool, "id").select("id", "label", "hashes"), "held")
    # one partial table of counts for each core rather than for each task
    told = held.select("hashes").coalesce(pool.sparkSession.sparkContext.defaultParallelism).mapInArrow(_slot_counts, "block int, counts binary")
    blocks = sorted((r["block"], bytes(r["counts"])) for r in told.groupBy("block").applyInPandas(_added, "block int, counts binary").collect())
    counts = np.frombuffer(b"".join(c for _, c in blocks), np.int64) if blocks else np.zeros(1 << SLOT_BITS, np.int64)
    sent = pool.sparkSession.sparkContext.broadcast(counts)
    early = staged(held.mapInArrow(_early(percent, sent), "token long, id long, label long, n long, place long"), "early")
    early = _blocked(early)
    # of blocks (i, j) with i <= j, a text of block i is on side a, one of block j on side b; within a block on both
    def side(s: str, first: bool) -> DataFrame:
        lo, hi = (F.col("next"), F.col("blocks") - 1) if first else (F.lit(0).cast("long"), F.col("last"))
        key = F.struct(F.col("own").alias("i"), F.col("other").alias("j")) if first else F.struct(F.col("other").alias("i"), F.col("own").alias("j"))
        rows = early.withColumn("other", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))).withColumn("pair", key)
        return rows.select("token", "pair", F.col("id").alias(s), F.col("label").alias(f"l{s}"), F.col("n").alias(f"n{s}"), F.col("place").alias(f"p{s}"))

    a, b = side("a", True), side("b", False)
    most = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # 100 * o >= percent * (n + m - o)
    room = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    # within one block both orders meet, between two only one
    once = (F.col("pair.i") != F.col("pair.j")) | (F.col("a") < F.col("b"))
    found = a.join(b, ["token", "pair"]).where("la != lb").where(once & room)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, slack: float = 0.23) -> DataFrame:
    """Groups of near duplicates: rows (id, n_shingles, component_id, kept), one for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles (A-Z
    lower-cased, words cut at spaces and tabs to carriage returns; fewer words: the whole sequence). ``component_id`` is the
    smallest id that links reach; ``kept`` marks that document. ``slack`` is how far a sketch's estimate may fall short of
    the threshold before the exact check (0.23 is six standard deviations).

    Null and empty texts, and texts without words, have empty sets and stand alone. Very long texts are hashed whole. Rows
    without an id take no part: their component is null and they are kept. Rows that repeat an id are each returned; if their
    texts differ they are one document, whose links are those of one of its texts, the same at every run. An empty table gives
    no rows; other columns are not read, so their names can't clash.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = staged(docs.mapInArrow(_sketched(words), _SKETCH), "sketches")
    named = sketches.where("n > 0 and id is not null")
    equal = staged(named.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    # an id that repeats with different texts is one document, compared by the text whose name is least
    one = equal.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("s1", "s2")).alias("name")).select("id", "name.*")
    classes = staged(named.join(one, ["id", "s1", "s2"], "left_semi").dropDuplicates(["id"]), "class-sketches")

    spread = classes.select("id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1")
    buckets = staged(spread.join(shared, "key"), "buckets")
    stars = buckets.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    least = percent / 100 - slack
    first = _estimated(stars, classes, least).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = staged(first, "first")
    # full sets of all that share a bucket
    named = classes.select("id", "s1", "s2").join(buckets.select("id").distinct(), "id", "left_semi")
    sets = staged(docs.join(named, "id").mapInArrow(_hash_sets(words), "id long, hashes binary").dropDuplicates(["id"]), "sets")
    links = staged(_linked(first, sets, percent), "links")
    joined = staged(connected_components(links), "joined")

    # classes that share a bucket and are still apart
    label = buckets.select("key", "id", "size").join(joined, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("label"))
    apart = label.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    label = staged(label.join(apart, "key"), "apart")
    a, b = (label.where(F.col("size") <= NARROW).select("key", F.col("id").alias(s), F.col("label").alias(f"l{s}")) for s in "ab")
    rest = a.join(b, "key").where("a < b and la != lb").select("a", "b")
    rest = rest.unionByName(_by_rarest(label.where(F.col("size") > NARROW).select("id", "label").distinct(), sets, percent)).distinct()
    rest = staged(_estimated(rest.join(first, ["a", "b"], "left_anti"), classes, least), "rest")
    found = staged(connected_components(links.unionByName(_linked(rest, sets, percent))), "components")

    groups = equal.join(found, equal.rep == found.id, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    rows = sketches.select("id", "n", "s1", "s2")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = rows.where("n > 0 and id is not null").join(groups, ["s1", "s2"], "left").select("id", "n", "component").unionByName(alone)
    return out.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the kept one of its group; all rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, empty and long texts, ties and repeats as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))) END AS g FROM w
), e AS (SELECT doc_id, unnest(g) AS x FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b
), m AS (SELECT id, min(root) AS c FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.id = n.doc_id
"""
