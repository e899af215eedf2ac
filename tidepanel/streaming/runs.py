"""Streams that are run to the end of what has been delivered, stopped, and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.shared import scratch


def drain(stream: DataFrame, out: str, state: str) -> None:
    """Run a stream over all files that its source has now, append what it gives to ``out`` and stop.

    Offsets, watermark and state stay in ``state``, so the next start goes on where this one ended, also after a driver or
    executor was lost. The sink's log makes each row count once.
    """
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def in_starts(deliveries: DataFrame, of: Callable[[DataFrame], DataFrame], parts: int, label: str) -> DataFrame:
    """What a stream gives for rows delivered in parts (column ``part``, from 0), started anew after each part.

    Source, sink and checkpoint are folders that all machines share. Each start is one micro-batch of its part's files, and
    one without data that closes what the new watermark allows.
    """
    spark, root = deliveries.sparkSession, scratch(deliveries.sparkSession, label)
    source, out = f"{root}/in", f"{root}/out"
    schema = deliveries.drop("part").schema
    for k in range(parts):
        deliveries.where(F.col("part") == k).drop("part").write.mode("append").parquet(source)
        stream = of(spark.readStream.schema(schema).parquet(source))
        drain(stream, out, f"{root}/state")
    return spark.read.schema(stream.schema).parquet(out)
