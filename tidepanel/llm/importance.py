"""Resampling documents by importance toward a target collection, with hashed word n-grams.

Texts become n-grams by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``. An
n-gram is a number made from shifted dictionary indices; only the distinct ones are spelt out and hashed by CRC-32, and their
buckets, or the buckets' gains, are taken back to every place. A document's weight is the mean gain of its n-grams, a
segmented sum over them. Gumbel noise fixed by the document's id is added, and the highest scores are drawn: sampling
without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import row_runs, staged, table, utf8

#: What stands between words: ASCII but for digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WORDS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
_CHUNK = 1 << 22
_KINDS = "n_words long, n_features long, weight long"


class Grams:
    """The n-grams of 1 to ``most`` words of a run of texts: for each n, places (row order), row offsets and distinct n-grams."""

    def __init__(self, texts: pa.Array, most: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
        encoded = pc.list_flatten(lists).dictionary_encode()
        words, at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        words, at = words[at[0] : at[-1]], at - at[0]
        # separators at an edge of a text leave an empty word
        empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
        if empty >= 0:
            real = words != empty
            at = np.concatenate(([0], np.cumsum(real)))[at]
            words = words[real]
        self.n_words, self.parts = np.diff(at), []
        codes, spelt, rows = words, encoded.dictionary, at
        for n in range(1, most + 1):
            if n > 1:
                # the n-gram at a place is the (n-1)-gram there and the word n - 1 places on, within its row
                room = np.maximum(np.diff(at) - (n - 1), 0)
                starts = np.repeat(rows[:-1], room) + _within(room)
                last = words[np.repeat(at[:-1], room) + _within(room) + (n - 1)]
                pairs, codes = np.unique(codes[starts] * len(encoded.dictionary) + last, return_inverse=True)
                first, then = np.divmod(pairs, len(encoded.dictionary))
                spelt = pc.binary_join_element_wise(spelt.take(pa.array(first)), encoded.dictionary.take(pa.array(then)), pa.scalar(" ", encoded.dictionary.type))
                rows = np.concatenate(([0], np.cumsum(room)))
            self.parts.append((codes, rows, spelt))

    def of_rows(self) -> np.ndarray:
        """The number of n-grams of each row."""
        return sum(np.diff(rows) for _, rows, _ in self.parts)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _buckets_of(spelt: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in spelt.cast(pa.large_binary()).to_pylist()), np.int64, len(spelt))


def _runs(column: pa.Array, most: int) -> Iterator[tuple[int, int, Grams]]:
    column = column.cast(pa.large_string()).fill_null("")
    _, at = utf8(column)
    for lo, hi in row_runs(at, _CHUNK):
        yield lo, hi, Grams(column.slice(lo, hi - lo), most)


def bucket_counts(rows: DataFrame, text_col: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): how often n-grams of each bucket occur in all texts. Each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, grams in _runs(batch.column("text"), most):
                for codes, _, spelt in grams.parts:
                    np.add.at(counts, _buckets_of(spelt, buckets), np.bincount(codes, minlength=len(spelt)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return rows.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket 1,000 times the logarithm of how much more frequent it is in the target, floored; counts have one added.
    ``raw`` and ``target`` are bucket counts, so the driver gets ``buckets`` rows of each at most."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, of in ((s, raw), (t, target)):
        for r in of.collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """Rows (id, n_words, n_features, weight), one for each row of ``docs``: weight is the floored mean gain of its n-grams."""
    kind, buckets = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"], len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams in _runs(batch.column("text"), most):
                total = np.zeros(hi - lo, np.int64)
                for codes, rows, spelt in grams.parts:
                    sums = np.concatenate(([0], np.cumsum(gain[_buckets_of(spelt, buckets)][codes])))
                    total += sums[rows[1:]] - sums[rows[:-1]]
                n = grams.of_rows()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(grams.n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {_KINDS}")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, rank), one for each row of ``docs``; rank is null where it isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` percent (floored) are drawn: the highest scores, ties to
    the smaller id. Null texts have no words, weight 0 and are never drawn; very long texts count whole. A null id has noise
    of its own kind (the hash of the seed alone) and goes before others on ties; rows that repeat an id have the same noise, each is
    drawn for itself, and equal ones have ranks in any order. An empty table gives no rows, an empty target leaves every gain
    to the raw counts; other columns are not read, so their names can't clash.

    Texts are read twice: for the counts and for the weights. Ranks are found in ranges of scores, each sorted by itself.
    """
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_text, most, buckets), buckets)
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((chance + 0.5) / 4294967296.0)))
    rows = staged(weights(docs, gain, id_col, text_col, most).withColumn("score", F.col("weight") + noise).withColumn("seq", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= least_words
    draws = rows.where(enough).count() * percent // 100
    order = (F.desc("score"), F.asc_nulls_first("id"), F.col("seq"))
    # a range of scores is one task; frequent scores are cut by id, frequent ids by the rows' numbers
    ranged = staged(rows.where(enough).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranged.join(before, "part").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    names = ("id", "n_words", "n_features", "weight", "score", "rank")
    return placed.select(*names).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*names))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, drawn toward ``benchmark``; nulls, long texts, ties and repeats as in ``resample``."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by bytes over a table of 256 remainders, made by its polynomial.
ORACLE = f"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOWER}, '{_WORDS}')) AS w FROM benchmark) GROUP BY ALL),
v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [(instr('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 1 FOR i IN range(1, length(h) // 2 + 1)]),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
g AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
w AS (SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
