"""Corpus-wide edits of stored tables: only the files with a hit are written anew, and a manifest commits them at once.

A table is a folder of Parquet files and a log of numbered manifests, each the list of the files that make up one
version. An edit reads the newest manifest, finds the files in which some row changes, writes their rows again as new files,
and adds the next manifest; readers of an older version keep their files. A run that fails leaves files that no manifest
names, and the table as it was. Two writers cannot both add the same number: a manifest is only ever created.

A manifest also holds the table's columns, so a column can be added without touching a file: files that lack it read as null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_LOG = "_versions"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, table: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{table}/{_LOG}") if n.endswith(".json")]


def _manifest(spark: SparkSession, table: str, version: int | None = None) -> tuple[int, list[str], StructType]:
    """A version's number, files and columns; the newest one's without a number."""
    known = versions(spark, table)
    if not known:
        raise ValueError(f"no table at {table}")
    version = known[-1] if version is None else version
    (row,) = spark.read.text(f"{table}/{_LOG}/{version:09d}.json", wholetext=True).collect()
    held = json.loads(row[0])
    return version, held["files"], StructType.fromJson(held["schema"])


def _commit(spark: SparkSession, table: str, version: int, files: list[str], schema: StructType) -> None:
    """Creates the manifest of a version; fails if another writer has."""
    fs, p = _path(spark, f"{table}/{_LOG}/{version:09d}.json")
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps({"files": sorted(files), "schema": schema.jsonValue()}).encode()))
    finally:
        out.close()


def _with(schema: StructType, more: StructType) -> StructType:
    """A schema's columns and those of another that it lacks (names in any case), all of which can be null."""
    known = {f.name.lower() for f in schema}
    return StructType([StructField(f.name, f.dataType) for f in [*schema, *(f for f in more if f.name.lower() not in known)]])


def _rows(spark: SparkSession, table: str, files: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{table}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def _write(rows: DataFrame, table: str) -> list[str]:
    """Writes rows as new files of the table; their names."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{folder}")
    return [f"{folder}/{n}" for n in _names(rows.sparkSession, f"{table}/{folder}") if n.endswith(".parquet")]


def create(rows: DataFrame, table: str) -> None:
    """Stores rows as version 0 of a new table."""
    _commit(rows.sparkSession, table, 0, _write(rows, table), _with(rows.schema, StructType()))


def create_empty(spark: SparkSession, table: str, columns: str | StructType) -> None:
    """Makes a table without rows."""
    _commit(spark, table, 0, [], _with(StructType.fromDDL(columns) if isinstance(columns, str) else columns, StructType()))


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one that is named."""
    _, files, schema = _manifest(spark, table, version)
    return _rows(spark, table, files, schema)


def append(rows: DataFrame, table: str) -> int:
    """Adds rows as the next version, whose number it returns; columns that the table lacks are added to it."""
    spark = rows.sparkSession
    version, files, schema = _manifest(spark, table)
    _commit(spark, table, version + 1, files + _write(rows, table), _with(schema, rows.schema))
    return version + 1


def replace(rows: DataFrame, table: str) -> int:
    """Puts rows in the place of all that the table holds, as the next version; the rows can come from the table itself."""
    spark = rows.sparkSession
    version, _, _ = _manifest(spark, table)
    _commit(spark, table, version + 1, _write(rows, table), _with(rows.schema, StructType()))
    return version + 1


def clear(spark: SparkSession, table: str) -> int:
    """Leaves the table without rows, as the next version."""
    version, _, schema = _manifest(spark, table)
    _commit(spark, table, version + 1, [], schema)
    return version + 1


def add_columns(spark: SparkSession, table: str, columns: str) -> int:
    """Adds columns (a DDL list) without writing any rows; those that are there already are left as they are. Returns the version."""
    version, files, schema = _manifest(spark, table)
    wider = _with(schema, StructType.fromDDL(columns))
    if len(wider) == len(schema):
        return version
    _commit(spark, table, version + 1, files, wider)
    return version + 1


def rewrite(spark: SparkSession, table: str, hit: Column, change: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Applies ``change`` to the rows of the newest version where ``hit`` holds (null: it doesn't), as the next version.

    Only files that hold such a row are written again; without any there is no new version. Returns the version, and
    how many rows changed and files were rewritten of how many.
    """
    version, files, schema = _manifest(spark, table)
    flag = F.coalesce(hit, F.lit(False))
    if not files:
        return {"version": version, "changed": 0, "rewritten": 0, "files": 0}
    touched = _rows(spark, table, files, schema).where(flag).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file that has a hit
    if not touched:
        return {"version": version, "changed": 0, "rewritten": 0, "files": len(files)}
    changed = [f for f in files if any(t["file"].endswith(f) for t in touched)]
    old = _rows(spark, table, changed, schema)
    new = old.where(~flag).unionByName(change(old.where(flag)), allowMissingColumns=True)
    _commit(spark, table, version + 1, [f for f in files if f not in set(changed)] + _write(new, table), _with(schema, new.schema))
    return {"version": version + 1, "changed": sum(t["n"] for t in touched), "rewritten": len(changed), "files": len(files)}
