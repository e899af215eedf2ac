"""A corpus pipeline: language identification, near-duplicate removal, redaction of personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
rereads for the next. All stages but the last return the columns of ``documents``; other columns of their input, whatever
their names, are dropped. Texts are read whole however long, and an empty input gives an empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import staged, table
from tidepanel.llm.language_id import fit_on_fold, predict_languages
from tidepanel.llm.mixing import mixed
from tidepanel.llm.near_dedup import keep_one
from tidepanel.llm.pieces import encode
from tidepanel.llm.pii import redact_pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the predicted one. Learns from labelled rows of ``docs`` outside
    the test fold. Null and empty texts, texts without letters and texts far from every centroid go; rows that repeat, or
    have no id, are judged by their own text."""
    found = predict_languages(docs, fit_on_fold(docs)).where(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows with null or empty texts or without an id stay;
    rows that repeat the kept id stay together."""
    return keep_one(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans are replaced by their kind; n_chars follows the new text (null where that is). All rows stay."""
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (never, once or twice), shuffled within output shards. A null source is one of
    its own, rows that repeat an id are taken together, a row without an id goes by its text; texts without words are never taken."""
    return mixed(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number for each row of the mix, null ids and repeated rows too; an empty text has no ids."""
    return encode(docs).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]
#: Hashes and centroids that SQL doesn't have decide most stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
