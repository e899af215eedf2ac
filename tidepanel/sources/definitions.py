"""Factor definitions from JSON files of several shapes, every record with where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed names of the contract: what holds a list of records, and what a map of them.
LISTS, MAPS = ("records", "results"), ("candidates", "factors", "factor_simulation_results")


def _entries(v: Column) -> Column:
    """The records of a payload, structs (key, record): of a list, of a named list or map, of a map of records, else itself."""
    def listed(path: str) -> Column:
        return F.transform(F.try_variant_get(v, path, "array<variant>"), lambda r: F.struct(F.lit(None).cast("string").alias("key"), r.alias("record")))

    def mapped(path: str) -> Column:
        return F.transform(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("record")))

    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    all_records = F.forall(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), is_object) & (F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), v.alias("record")))
    found = F.when(F.schema_of_variant(v).startswith("ARRAY"), listed("$"))
    for name in LISTS:
        found = found.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).startswith("ARRAY"), listed(f"$.{name}"))
    for name in MAPS:
        found = found.when(is_object(F.try_variant_get(v, f"$.{name}", "variant")), mapped(f"$.{name}"))
    return found.when(is_object(v) & all_records, mapped("$")).otherwise(itself)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every JSON file: source_path, source_sha256, record_index, candidate_key, alpha_id, local_id, expression,
    settings, definition_hash, conflict.

    A file may be a list of records, have one under a name, be or have a map from keys to records, or be one record; maps are
    read in the order of their keys. Duplicates stay. A record without an id has a local one, made of its place in the file's
    content. Records of one id with different definitions are in conflict. An empty list
    has no records, a file that is no JSON one without anything. Each file is one row and is parsed in one task.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    rows = files.select("source_path", F.sha2("value", 256).alias("source_sha256"), F.try_parse_json("value").alias("payload"))
    rows = rows.select("source_path", "source_sha256", F.posexplode(_entries(F.col("payload"))).alias("record_index", "entry"))
    text = lambda p: F.try_variant_get(F.col("entry.record"), p, "string")
    rows = rows.select("source_path", "source_sha256", "record_index", F.col("entry.key").alias("candidate_key"), F.coalesce(text("$.alpha_id"), text("$.id")).alias("alpha_id"),
        F.coalesce(text("$.expression"), text("$.code")).alias("expression"), F.to_json(F.try_variant_get(F.col("entry.record"), "$.settings", "variant")).alias("settings"))
    place = F.concat_ws("|", "source_sha256", F.col("record_index").cast("string"), F.coalesce("candidate_key", F.lit("")))
    definition = F.sha2(F.concat_ws("|", F.coalesce("expression", F.lit("")), F.coalesce("settings", F.lit(""))), 256)
    rows = rows.withColumns({"local_id": F.when(F.col("alpha_id").isNull(), F.concat(F.lit("local-"), F.substring(F.sha2(place, 256), 1, 20))), "definition_hash": definition})
    of_id = Window.partitionBy("alpha_id", F.when(F.col("alpha_id").isNull(), F.col("local_id")))
    differ = F.min("definition_hash").over(of_id) != F.max("definition_hash").over(of_id)
    return rows.withColumn("conflict", F.col("alpha_id").isNotNull() & differ)
