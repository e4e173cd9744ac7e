"""Keyed tables kept in buckets: a batch of changes touches only the files that hold its keys.

A keyed table is a stored table (``operators.rewrites``; ``rewrites.read`` reads it) whose files each belong to one bucket of the
key's hash. An upsert reads the keys of the changes' buckets alone, writes again the files in which a row changes, and adds new
keys as new files of their buckets. The stored rows are never exchanged: changes whose written size is within ``BROADCAST_BYTES``
go to them. More changes than that are joined by a shuffle, with the same rows.

Of several changes to a key the one with the greatest ``order`` counts (of equal ones the greatest row), and it replaces a
stored row of the same or a smaller order, so that a batch can be repeated and come late. Nulls in a key are equal to each other; a null order
is the smallest. Columns that the changes lack keep what is stored (null in new rows); columns that the table lacks are added. Columns
must be of types that can be compared (no maps). Each upsert may add a file to a bucket; ``compact`` joins them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import rewrites

_BUCKET = "_bucket"
#: Changes are sent to the stored rows if they take at most so many bytes, as they were written.
BROADCAST_BYTES = 32 * 1024 * 1024


def _folder(spark: SparkSession, path: str) -> list:
    fs, p = rewrites._path(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _bytes(spark: SparkSession, path: str) -> int:
    return sum(s.getLen() for s in _folder(spark, path))


def _description(spark: SparkSession, table: str) -> tuple[list[str], str, int]:
    (row,) = spark.read.text(f"{table}/_versions/keyed", wholetext=True).collect()
    held = json.loads(row[0])
    return held["key"], held["order"], held["buckets"]


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the greatest order for each key; partial maxima are taken before the shuffle."""
    rest = [order, *(c for c in rows.columns if c not in (*key, order))]
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def _write(rows: DataFrame, table: str) -> list[str]:
    """Writes rows with their bucket's number as files of their buckets; the files' names."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy(_BUCKET).parquet(f"{table}/{folder}")
    parts = [s.getPath().getName() for s in _folder(spark, f"{table}/{folder}") if s.isDirectory()]
    return [f"{folder}/{b}/{s.getPath().getName()}" for b in parts for s in _folder(spark, f"{table}/{folder}/{b}") if s.getPath().getName().endswith(".parquet")]


def _number(file: str) -> int:
    return int(re.search(rf"/{_BUCKET}=([0-9]+)/", file).group(1))


def _same(key: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])


def _newer(order: str) -> Column:
    """Whether the change (c) replaces the stored row (s)."""
    return F.col(f"s.{order}").isNull() | F.coalesce(F.col(f"c.{order}") >= F.col(f"s.{order}"), F.lit(False))


def create(rows: DataFrame, table: str, key: list[str], order: str, buckets: int) -> None:
    """Stores rows, the last one of each key, as a new table of so many buckets."""
    spark = rows.sparkSession
    placed = _last(rows, key, order).withColumn(_BUCKET, _bucket(key, buckets)).repartition(buckets, _BUCKET)
    fs, p = rewrites._path(spark, f"{table}/_versions/keyed")
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps({"key": key, "order": order, "buckets": buckets}).encode()))
    finally:
        out.close()
    rewrites._commit(spark, table, 0, _write(placed, table), rewrites._with(rows.schema, StructType()))


def found(stored: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The keys of the changes that the stored rows have, the file of each, and whether the change replaces the row; no more rows than changes."""
    held = stored.select(*key, order, F.col("_metadata.file_path").alias("_file")).alias("s")
    return held.join(changes.select(*key, order).alias("c"), _same(key, "s", "c")).select(*[F.col(f"s.{k}") for k in key], "_file", _newer(order).alias("_newer"))


def merged(stored: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored rows, with the values of their changes where there are newer ones."""
    met = stored.alias("s").join(changes.withColumn("_met", F.lit(True)).alias("c"), _same(key, "s", "c"), "left")
    take = F.coalesce(F.col("c._met"), F.lit(False)) & _newer(order)
    return met.select(*[F.when(take, F.col(f"c.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c) if c in changes.columns and c not in key else F.col(f"s.`{c}`").alias(c) for c in stored.columns])


def upsert(changes: DataFrame, table: str) -> dict[str, int]:
    """Applies a batch of changes as the next version; returns it, the rows replaced and added, and how many files were read for keys and written again of how many."""
    spark = changes.sparkSession
    key, order, buckets = _description(spark, table)
    version, files, schema = rewrites._manifest(spark, table)
    wide = rewrites._with(schema, changes.schema)
    stage = f"{table}/stage/{uuid.uuid4().hex}"
    try:
        _last(changes, key, order).withColumn(_BUCKET, _bucket(key, buckets)).write.parquet(f"{stage}/changes")
        new = spark.read.parquet(f"{stage}/changes")
        touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}  # at most a row a bucket
        near = [f for f in files if _number(f) in touched]
        sent = F.broadcast if _bytes(spark, f"{stage}/changes") <= BROADCAST_BYTES else (lambda df: df)
        found(rewrites._rows(spark, table, near, wide), sent(new), key, order).write.parquet(f"{stage}/found") if near else None
        known = spark.read.parquet(f"{stage}/found") if near else None
        hits = known.where("_newer").groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect() if near else []  # a row a file with a hit
        names = {"/".join(h["_file"].split("/")[-4:]) for h in hits}
        hit = [f for f in near if f in names]
        if len(hit) != len(names):
            raise RuntimeError("files of hits that the manifest doesn't name")
        added = new.drop(_BUCKET)
        if near:
            added = added.alias("c").join(sent(known.select(*key)).alias("s"), _same(key, "s", "c"), "left_anti")
        out = added.withColumn(_BUCKET, _bucket(key, buckets)).repartition(F.col(_BUCKET))
        n_added = out.count()
        if hit:
            changed = merged(rewrites._rows(spark, table, hit, wide), sent(new.drop(_BUCKET)), key, order)
            out = changed.withColumn(_BUCKET, _bucket(key, buckets)).unionByName(out, allowMissingColumns=True)
        result = {"version": version, "replaced": sum(h["n"] for h in hits), "added": n_added, "read": len(near), "rewritten": len(hit), "files": len(files)}
        if not hit and not n_added:
            return result
        gone = set(hit)
        rewrites._commit(spark, table, version + 1, [f for f in files if f not in gone] + _write(out, table), wide)
        return result | {"version": version + 1}
    finally:
        fs, p = rewrites._path(spark, stage)
        fs.delete(p, True)


def compact(spark: SparkSession, table: str, most: int = 4) -> int:
    """Writes the buckets with more than ``most`` files as one file each, as the next version; how many there were."""
    key, _, buckets = _description(spark, table)
    version, files, schema = rewrites._manifest(spark, table)
    many = {b for b, n in Counter(map(_number, files)).items() if n > most}
    if many:
        old = [f for f in files if _number(f) in many]
        rows = rewrites._rows(spark, table, old, schema).withColumn(_BUCKET, _bucket(key, buckets)).repartition(F.col(_BUCKET))
        gone = set(old)
        rewrites._commit(spark, table, version + 1, [f for f in files if f not in gone] + _write(rows, table), schema)
    return len(many)
