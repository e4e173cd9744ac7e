"""Stored documents as a Spark data source: ``spark.read.format("stored_documents").load(path)``, and ``.write`` likewise.

A store is a folder of Parquet files and of commits. Each task writes one file and reports it; the commit, written
last and moved into place, names the files of the whole job, with the range of ids in each row group. Only files that a
commit names are read, so a job that fails, or a task that is lost or run twice, leaves nothing half written. An appending commit adds
to what is there; an overwriting one names the commits that it replaces, whose files stay for readers that hold them.
Two jobs that append at the same time both count; of two that overwrite at the same time neither replaces the other.

Reading has a partition for each row group. A schema that is given (``.schema("id long, num_pages int")``) limits the columns
that are read; a column that an older file lacks is null. Conditions on ``id`` that compare it with values leave out row groups.
The path is any that Arrow's file systems open on driver and executors.

Null ids, empty and very long texts and repeated rows are kept as they are. An empty job commits a file without rows, which
keeps the columns; a path without a commit is an error.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

FORMAT = "stored_documents"
KEY = "id"
#: A row group is written when it holds so many bytes.
GROUP_BYTES = 64 * 1024 * 1024


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path in it; Spark writes local ones with a single slash."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _commits(path: str) -> dict[str, dict]:
    """The commits that count, oldest first, by name."""
    fs, root = _open(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    every = {}
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                every[info.base_name] = json.loads(f.read())
    gone = {name for commit in every.values() for name in commit["replaces"]}
    return {name: commit for name, commit in every.items() if name not in gone}


@dataclass
class Group(InputPartition):
    """A row group of a file, with the range of its ids, [None, None] if all are null (None: not known)."""

    file: str
    number: int
    ids: list | None


@dataclass
class Written(WriterCommitMessage):
    """A task's file and the range of ids in each of its row groups."""

    file: str
    ranges: list[list | None] = field(default_factory=list)


class StoredDocuments(DataSource):
    """The format; its one option is the path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        """All columns that some file has, older files' first."""
        commits = _commits(self.options["path"])
        if not commits:
            raise ValueError(f"no stored documents at {self.options['path']}")
        fields = {}
        for commit in commits.values():
            for f in StructType.fromJson(commit["schema"]):
                fields.setdefault(f.name, StructField(f.name, f.dataType))
        return StructType(list(fields.values()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, to_arrow_schema(schema)
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Notes the conditions on the id; Spark tests all of them again."""
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == (KEY,):
                self.wanted.append(f)
            yield f

    def _may_hold(self, group: Group) -> bool:
        """Whether some row of the group can meet every condition; null ids meet none."""
        if not self.wanted or group.ids is None:
            return True
        low, high = group.ids
        if low is None:
            return False
        test = {
            EqualTo: lambda v: low <= v <= high,
            In: lambda vs: any(v is not None and low <= v <= high for v in vs),
            GreaterThan: lambda v: high > v,
            GreaterThanOrEqual: lambda v: high >= v,
            LessThan: lambda v: low < v,
            LessThanOrEqual: lambda v: low <= v,
        }
        return all(test[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> list[Group]:
        groups = [Group(file, n, ids) for c in _commits(self.path).values() for file, ranges in c["files"] for n, ids in enumerate(ranges)]
        return [g for g in groups if self._may_hold(g)] or [Group("", 0, None)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            file = pq.ParquetFile(f)
            has = [n for n in self.schema.names if n in file.schema_arrow.names]
            for batch in file.iter_batches(batch_size=1024, row_groups=[partition.number], columns=has):
                columns = [batch.column(c.name).cast(c.type) if c.name in has else pa.nulls(batch.num_rows, c.type) for c in self.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.spark_schema, self.schema = path, schema, to_arrow_schema(schema)
        self.replaces = list(_commits(path)) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task's rows as one file, which is removed again if the task fails."""
        fs, root = _open(self.path)
        done = Written(f"data/{uuid.uuid4().hex}.parquet")
        fs.create_dir(f"{root}/data", recursive=True)
        try:
            with fs.open_output_stream(f"{root}/{done.file}") as out, pq.ParquetWriter(out, self.schema) as writer:
                held, size = [], 0
                for batch in iterator:
                    held.append(batch.cast(self.schema))
                    size += batch.nbytes
                    if size >= GROUP_BYTES:
                        self._group(writer, held, done)
                        held, size = [], 0
                self._group(writer, held, done)
        except BaseException:
            self._remove(done)
            raise
        return done

    def _group(self, writer: pq.ParquetWriter, held: list[pa.RecordBatch], done: Written) -> None:
        rows = pa.Table.from_batches(held, self.schema)
        if not rows.num_rows:
            return
        known = KEY in rows.column_names and (pa.types.is_integer(rows.schema.field(KEY).type) or pa.types.is_string(rows.schema.field(KEY).type))
        writer.write_table(rows, row_group_size=rows.num_rows)
        done.ranges.append(list(pc.min_max(rows[KEY]).as_py().values()) if known else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        files = sorted((m.file, m.ranges) for m in messages if m is not None)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        content = {"files": files, "replaces": self.replaces, "schema": self.spark_schema.jsonValue()}
        fs.create_dir(f"{root}/_commits", recursive=True)
        with fs.open_output_stream(f"{root}/_commits/{name}.part") as out:
            out.write(json.dumps(content).encode())
        fs.move(f"{root}/_commits/{name}.part", f"{root}/_commits/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Removes the files of the tasks that had ended; those of lost tasks are named by no commit."""
        for m in messages:
            if m is not None:
                self._remove(m)

    def _remove(self, written: Written) -> None:
        fs, root = _open(self.path)
        path = f"{root}/{written.file}"
        if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
            fs.delete_file(path)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets the session push filters into Python sources, which the reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredDocuments)
