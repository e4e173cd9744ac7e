"""Migrations of a folder of stored tables (``operators.rewrites``): in the order of their names, each once, safe to run again.

A migration makes tables and adds columns. What is there already is left as it is, so one that was stopped half way, or
whose record was lost, can simply run again. The table ``_migrations`` records what was applied: (id, name, applied_at).
Adding a column writes no rows: files from before read it as null. A migration that fails stops those after it; those before it
stay. Of two runs at the same time one fails on the version that the other has added, and finds the work done when it runs again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rewrites

RECORD = "_migrations"


@dataclass(frozen=True)
class Migration:
    """``create``: columns (a DDL list) of new tables by name; ``add``: columns added to tables, those of ``create`` included."""

    name: str
    create: dict[str, str] = field(default_factory=dict)
    add: dict[str, str] = field(default_factory=dict)


def _path(root: str, table: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(f"not a table's name: {table!r}")
    return f"{root}/{table}"


def applied(spark: SparkSession, root: str) -> DataFrame:
    """What has been applied to the tables of a folder, opened or made."""
    if not rewrites.versions(spark, _path(root, RECORD)):
        rewrites.create_empty(spark, _path(root, RECORD), "id bigint, name string, applied_at timestamp")
    return rewrites.read(spark, _path(root, RECORD))


def migrate(spark: SparkSession, root: str, migrations: Iterable[Migration]) -> list[str]:
    """Applies the migrations that aren't recorded yet; returns their names in the order they ran. Names must differ."""
    todo = sorted(migrations, key=lambda m: m.name)
    if len({m.name for m in todo}) < len(todo):
        raise ValueError("two migrations of one name")
    done = {r.name for r in applied(spark, root).collect()}  # a row a migration
    number, ran = len(done), []
    for m in todo:
        if m.name in done:
            continue
        for table, columns in m.create.items():
            if not rewrites.versions(spark, _path(root, table)):
                rewrites.create_empty(spark, _path(root, table), columns)
        for table, columns in m.add.items():
            rewrites.add_columns(spark, _path(root, table), columns)
        number += 1
        record = spark.range(1).select(F.lit(number).cast("bigint").alias("id"), F.lit(m.name).alias("name"), F.current_timestamp().alias("applied_at"))
        rewrites.append(record, _path(root, RECORD))
        ran.append(m.name)
    return ran
