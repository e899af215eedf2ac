"""Writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Zstandard Parquet in partitions; refuses to overwrite. Rows of a partition are brought together, in splittable runs."""
    df.hint("rebalance", *by).write.partitionBy(*by).option("compression", "zstd").mode("errorifexists").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table; refuses to overwrite."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


RANK_KEYS = ("factor_id", "factor_version")


def rank_contents(ranks: DataFrame) -> DataFrame:
    """For each factor and version the number of rows and ``content``, a name of what they hold in any order.

    Rows are (factor_id, factor_version, session, security_id, score). The name is the sum of the first 60 bits of each row's
    MD5, so partial sums come before the shuffle.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in ("session", "security_id", "score")))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return ranks.groupBy(*RANK_KEYS).agg(F.count("*").alias("n_rows"), F.sum(bits).cast("string").alias("content"))


def write_rank_cache(ranks: DataFrame, path: str) -> DataFrame:
    """Write ranks by factor, version and content, and return the contents; those that the cache has are not written again.

    A changed factor gets a new content beside the old one, so readers of the old one are not disturbed.
    """
    contents = rank_contents(ranks)
    new = contents
    try:
        have = ranks.sparkSession.read.schema("factor_id string, factor_version int, content string").parquet(path)
        new = contents.join(have.select(*RANK_KEYS, "content").distinct(), [*RANK_KEYS, "content"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows = ranks.join(F.broadcast(new.select(*RANK_KEYS, "content")), list(RANK_KEYS))  # one row for each factor
    rows.hint("rebalance", *RANK_KEYS).write.partitionBy(*RANK_KEYS, "content").mode("append").parquet(path)
    return contents


def read_rank_cache(spark: SparkSession, path: str, contents: DataFrame) -> DataFrame:
    """The rows of the named contents (factor_id, factor_version, content), by partitions."""
    return spark.read.parquet(path).join(F.broadcast(contents.select(*RANK_KEYS, F.col("content").cast("string").alias("__content"))), list(RANK_KEYS)).where(F.col("content").cast("string") == F.col("__content")).drop("__content")
