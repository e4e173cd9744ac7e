"""Sinks: file names and keys, routed uploads, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edits import upsert


def anonymized_pdf_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "_anonymized.pdf")


def anonymized_json_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "_anonymized.json")


def shared_name(name: Column) -> Column:
    """Without the ending and an earlier mark, then with both."""
    return F.concat(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"(?i)_anonymized$", ""), F.lit("_anonymized.pdf"))


def dropped_name(number: Column, name: Column) -> Column:
    """A two-digit number (more digits stay) before the name."""
    n = number.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")), F.lit("_"), name)


def object_key(session: Column, name: Column) -> Column:
    return F.concat_ws("/", session, name)


def route_uploads(uploads: DataFrame) -> DataFrame:
    """Adds ``status`` and ``key`` to uploads (session_id, type, data_id, data): two kinds are stored, others rejected."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    bad = blank("session_id") | blank("type") | F.col("data").isNull()
    key = F.when(bad, None).when(F.col("type") == "false_positives", F.when(~blank("data_id"), F.concat(F.lit("false_positives/"), "data_id", F.lit(".json")))).when(F.col("type") == "questionnaire", F.concat("session_id", F.lit("/questionnaire.json")))
    return uploads.withColumn("key", key).withColumn("status", F.when(F.col("key").isNull(), 400).otherwise(200))


def write_uploads(routed: DataFrame, path: str) -> None:
    routed.where("status = 200").select("type", "key", "data").write.mode("append").partitionBy("type").json(path)


def upsert_metadata(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Document metadata by id, newest change first in the result."""
    version = F.coalesce("updated_at", "created_at")
    return upsert(current, changes, ["id"], F.col("seq")).orderBy(version.desc(), "id")


def as_entries(mapping: Column) -> Column:
    """A map as a JSON list of its sorted key-value pairs."""
    return F.to_json(F.array_sort(F.map_entries(mapping)))


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
