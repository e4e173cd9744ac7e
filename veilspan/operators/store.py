"""The document store and the entity log as DataFrame transformations.

Spark has no keyed updates without a table format that brings them, so each
change is a new version of the table: a projection, an anti join or an upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

ENTITIES = "array<struct<text:string,label:string>>"
LOG_KEY = ("user_id", "normalized_text")
METADATA = ("id", "user_id", "filename", "page_count", "entity_count", "created_at", "updated_at")


def documents_of(documents: DataFrame, user_id: int) -> DataFrame:
    """A user's documents, newest first, without their bytes (so these are never read)."""
    return documents.where(F.col("user_id") == user_id).select(*METADATA).orderBy(F.desc("created_at"), F.desc("id"))


def document(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.where(F.col("id") == doc_id)


def is_owner(documents: DataFrame, doc_id: Column | int, user_id: Column | int) -> DataFrame:
    return documents.agg(F.coalesce(F.bool_or((F.col("id") == doc_id) & (F.col("user_id") == user_id)), F.lit(False)).alias("owned"))


def rename(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """New filenames for (id, new_filename, at) rows."""
    met = documents.join(changes, "id", "left")
    return met.withColumn("filename", F.coalesce("new_filename", "filename")).withColumn("updated_at", F.coalesce("at", "updated_at")).drop("new_filename", "at")


def delete(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids, "id", "left_anti")


def change_entities(documents: DataFrame, norm_text: str, label: str | None) -> DataFrame:
    """Removes (label None) or relabels a text in every document's JSON entities.

    Only documents that change come back: id, the new JSON and count. The JSON
    is parsed to an array and changed in place; nothing is exploded. Texts are
    compared after parsing, because JSON may write a letter in several ways.
    """
    hit = lambda e: normalize(e["text"]) == norm_text
    parsed = documents.withColumn("_old", F.from_json("entities_json", ENTITIES))
    if label is None:
        new = F.filter("_old", lambda e: ~hit(e))
    else:
        new = F.transform("_old", lambda e: F.struct(e["text"].alias("text"), F.when(hit(e), F.lit(label)).otherwise(e["label"]).alias("label")))
    changed = parsed.withColumn("_new", new).where(F.col("_new") != F.col("_old"))
    return changed.select("id", F.to_json("_new").alias("entities_json"), F.size("_new").cast("long").alias("entity_count"))


def log_entries(log: DataFrame, user_id: int, active_only: bool = False) -> DataFrame:
    mine = log.where(F.col("user_id") == user_id)
    return (mine.where("is_active = 1") if active_only else mine).orderBy(F.desc("created_at"), F.desc("id"))


def last_of_each(changes: DataFrame) -> DataFrame:
    """Changes (seq, user_id, original_text, label), the last one for each user and normalised text."""
    keyed = changes.withColumn("normalized_text", normalize(F.col("original_text")))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*LOG_KEY).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def upsert_log(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log after changes: an entry that is there keeps its id and creation time, takes label and text, and is active again."""
    new = last_of_each(changes).select(*LOG_KEY, F.col("label").alias("_label"), F.col("original_text").alias("_text"), F.col("seq").alias("_seq"))
    met = log.join(new, list(LOG_KEY), "full")
    return met.select(
        F.coalesce("id", "_seq").alias("id"), *LOG_KEY, F.coalesce("_label", "label").alias("label"), F.coalesce("_text", "original_text").alias("original_text"),
        F.when(F.col("_seq").isNotNull(), 1).otherwise(F.col("is_active")).alias("is_active"), F.coalesce("created_at", F.timestamp_seconds("_seq")).alias("created_at"),
    )


def update_log(log: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates (id, new_label, new_active); null fields stay."""
    met = log.join(patches, "id", "left")
    return met.withColumn("label", F.coalesce("new_label", "label")).withColumn("is_active", F.coalesce("new_active", "is_active")).drop("new_label", "new_active")


def set_active(log: DataFrame, user_id: int, norm_text: str, active: bool) -> DataFrame:
    hit = (F.col("user_id") == user_id) & (F.col("normalized_text") == norm_text)
    return log.withColumn("is_active", F.when(hit, int(active)).otherwise(F.col("is_active")))


def propagate_label(log: DataFrame, documents: DataFrame, user_id: int, original_text: str, label: str, seq: int) -> tuple[DataFrame, DataFrame]:
    """A user's label for a text: the log with the entry written or revived (``seq`` gives a new one its id and time), and the user's documents that change."""
    change = log.sparkSession.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(user_id).cast("long").alias("user_id"), F.lit(original_text).alias("original_text"), F.lit(label).alias("label"))
    return upsert_log(log, change), change_entities(documents.where(F.col("user_id") == user_id), _plain(original_text), label)


def deactivate(log: DataFrame, documents: DataFrame, user_id: int, original_text: str, propagate: bool = True) -> tuple[DataFrame, DataFrame]:
    """A user's entry put to rest, if it is there, and the user's documents that lose the text (none without ``propagate``)."""
    mine = documents.where((F.col("user_id") == user_id) & F.lit(propagate))
    return set_active(log, user_id, _plain(original_text), False), change_entities(mine, _plain(original_text), None)


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def camel(log: DataFrame) -> DataFrame:
    """The log in the interface's names, activity as a boolean."""
    return log.select("id", F.col("user_id").alias("userId"), F.col("normalized_text").alias("normalizedText"), "label", F.col("original_text").alias("originalText"), (F.col("is_active") == 1).alias("isActive"))


def violations(table: DataFrame, *key: str) -> DataFrame:
    """Keys that a unique constraint would reject."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that a foreign key would reject."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def unless_any(rows: DataFrame, those: DataFrame) -> DataFrame:
    """All rows if there are none of ``those``, else none: a NOT EXISTS that no column of ``rows`` takes part in."""
    return rows.join(F.broadcast(those.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti")


def with_keys_of(pairs: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Stored pairs whose key begins with one of the prefixes (what wiping local data removes)."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("key").startswith(p)
    return pairs.where(test)
