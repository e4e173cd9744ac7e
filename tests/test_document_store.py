"""The data source for stored documents."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan.sources import document_store
from veilspan.sources.document_store import FORMAT


@pytest.fixture
def store(spark, tmp_path):
    document_store.register(spark)
    return str(tmp_path / "store")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def files_of(store):
    return {p.name for p in Path(store, "data").iterdir()}


def documents(spark, n):
    pages = F.array(F.struct(F.lit(0).alias("pageIndex"), F.concat(F.lit("page of "), F.col("id").cast("string")).alias("text")))
    return spark.range(n).select("id", F.when(F.col("id") % 7 > 0, "a.pdf").alias("filename"), F.timestamp_seconds(F.col("id")).alias("at"), pages.alias("pages"))


def test_round_trip_with_awkward_rows(spark, store):
    long = "é\U0001f600" * 500_000
    rows = spark.createDataFrame([(1, long, None), (1, long, None), (None, "", [1, None]), (3, None, [])], "id bigint, text string, `list` array<int>")
    rows.write.format(FORMAT).mode("append").save(store)
    assert rows_of(spark.read.format(FORMAT).load(store)) == rows_of(rows)


def test_append_overwrite_and_snapshots(spark, store):
    rows = documents(spark, 100)
    rows.write.format(FORMAT).mode("append").save(store)
    rows.withColumn("id", F.col("id") + 100).write.format(FORMAT).mode("append").save(store)
    read = spark.read.format(FORMAT).load(store)
    assert read.schema == rows.schema or [f.dataType for f in read.schema] == [f.dataType for f in rows.schema]
    assert read.count() == 200 and rows_of(read.where("id < 100")) == rows_of(rows)
    # a store can be written from what it holds
    read.where("id % 2 = 0").write.format(FORMAT).mode("overwrite").save(store)
    assert [r.id for r in spark.read.format(FORMAT).load(store).orderBy("id").collect()] == list(range(0, 200, 2))
    assert rows_of(spark.read.format(FORMAT).load(store).where("id < 100")) == rows_of(rows.where("id % 2 = 0"))


def test_a_failing_task_leaves_nothing(spark, store):
    documents(spark, 50).write.format(FORMAT).mode("append").save(store)
    before, files, commits = rows_of(spark.read.format(FORMAT).load(store)), files_of(store), list(Path(store, "_commits").iterdir())
    bad = documents(spark, 400).repartition(4, "id").withColumn("filename", F.when(F.col("id") == 399, F.raise_error(F.lit("no such luck")).cast("string")).otherwise(F.col("filename")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no such luck"):
            bad.write.format(FORMAT).mode(mode).save(store)
        assert rows_of(spark.read.format(FORMAT).load(store)) == before
    assert list(Path(store, "_commits").iterdir()) == commits
    assert files <= files_of(store)


def test_uncommitted_files_are_not_read_and_aborted_ones_go(spark, store):
    import pyarrow as pa

    documents(spark, 10).write.format(FORMAT).mode("append").save(store)
    schema = spark.read.format(FORMAT).schema("id bigint").load(store).schema
    writer = document_store.Writer(store, schema, False)
    before = files_of(store)
    ended = writer.write(iter([pa.RecordBatch.from_pydict({"id": [7, 8]}, schema=writer.schema)]))  # a task that ran twice, or whose job never ended
    assert len(files_of(store) - before) == 1 and spark.read.format(FORMAT).load(store).count() == 10
    writer.abort([ended, None])
    assert files_of(store) == before

    def broken():
        yield pa.RecordBatch.from_pydict({"id": [7]}, schema=writer.schema)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert files_of(store) == before


def test_jobs_at_the_same_time_both_count(spark, store):
    documents(spark, 4).write.format(FORMAT).mode("append").save(store)
    schema = spark.read.format(FORMAT).load(store).schema
    one, two = (document_store.Writer(store, schema, True) for _ in range(2))
    documents(spark, 9).write.format(FORMAT).mode("append").save(store)  # neither saw it
    one.commit([one.write(iter([]))])
    two.commit([two.write(iter([]))])
    assert spark.read.format(FORMAT).load(store).count() == 9


def test_columns_are_pruned_and_older_files_lack_new_ones(spark, store):
    documents(spark, 6).write.format(FORMAT).mode("append").save(store)
    documents(spark, 6).select((F.col("id") + 6).alias("id"), F.lit(3).alias("num_pages")).write.format(FORMAT).mode("append").save(store)
    every = spark.read.format(FORMAT).load(store)
    assert every.columns == ["id", "filename", "at", "pages", "num_pages"]
    got = {r.id: r for r in every.collect()}
    assert got[0].num_pages is None and got[8].num_pages == 3 and got[8].pages is None and got[1].pages[0].text == "page of 1"
    narrow = spark.read.format(FORMAT).schema("num_pages int, id bigint").load(store)
    assert narrow.columns == ["num_pages", "id"] and narrow.count() == 12 and narrow.agg(F.sum("id")).first()[0] == 66


def test_empty_jobs_and_missing_stores(spark, store):
    with pytest.raises(PySparkException, match="no stored documents"):
        spark.read.format(FORMAT).load(store).collect()
    documents(spark, 0).write.format(FORMAT).mode("append").save(store)
    got = spark.read.format(FORMAT).load(store)
    assert got.columns == ["id", "filename", "at", "pages"] and got.count() == 0


def test_conditions_on_ids_leave_out_row_groups(spark, store, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    documents(spark, 400).repartitionByRange(8, "id").write.format(FORMAT).mode("append").save(store)
    spark.createDataFrame([(None, "x")], "id bigint, filename string").write.format(FORMAT).mode("append").save(store)

    def groups(*filters):
        reader = document_store.Reader(store, spark.read.format(FORMAT).load(store).schema)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [g for g in reader.partitions() if g.file]

    assert len(groups()) == 9 and len(groups(EqualTo(("id",), 7))) == 1 and len(groups(In(("id",), (7, 390, None)))) == 2
    assert len(groups(GreaterThan(("id",), 10), LessThanOrEqual(("id",), 20))) == 1 and groups(EqualTo(("id",), 1000)) == [] and len(groups(EqualTo(("filename",), "x"))) == 9
    few = spark.read.format(FORMAT).load(store).where("id > 10 and id <= 20")
    assert [r.id for r in few.orderBy("id").collect()] == list(range(11, 21)) and few.rdd.getNumPartitions() == 1
    assert spark.read.format(FORMAT).load(store).where("id = 1000").count() == 0
    assert spark.read.format(FORMAT).load(store).where("id is null").count() == 1


def test_ids_that_json_cannot_hold(spark, store):
    spark.sql("select date'2024-01-02' as id union all select null").write.format(FORMAT).mode("append").save(store)
    assert spark.read.format(FORMAT).load(store).where("id = date'2024-01-02'").count() == 1
    (commit,) = Path(store, "_commits").glob("*.json")
    assert all(r is None for _, ranges in json.loads(commit.read_text())["files"] for r in ranges)
