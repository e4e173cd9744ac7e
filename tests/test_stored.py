"""Stored rewrites file by file, and table functions in SQL."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspan.operators import migrations, ner, rewrites, table_functions


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select("id", F.when(F.col("id") % 100 == 7, "hit").otherwise("other").alias("text"), (F.col("id") / 2).alias("x"))
    rewrites.create(rows.repartitionByRange(8, "id"), str(tmp_path / "t"))
    return str(tmp_path / "t")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def files_of(spark, table, version):
    return set(rewrites._manifest(spark, table, version)[1])


def test_only_files_with_a_hit_are_written(spark, table):
    before = rows_of(rewrites.read(spark, table))
    done = rewrites.rewrite(spark, table, F.col("id") == 7, lambda rows: rows.withColumn("text", F.lit("new")))
    assert done == {"version": 1, "changed": 1, "rewritten": 1, "files": 8}
    assert len(files_of(spark, table, 0) & files_of(spark, table, 1)) == 7
    assert rows_of(rewrites.read(spark, table)) == sorted((i, "new" if i == 7 else t, x) for i, t, x in before)
    assert rows_of(rewrites.read(spark, table, 0)) == before
    # no hit, and nulls that decide nothing: no new version
    assert rewrites.rewrite(spark, table, F.lit(None).cast("boolean"), lambda rows: rows)["version"] == 1
    # rows can go, in all files that have some
    done = rewrites.rewrite(spark, table, F.col("text") == "hit", lambda rows: rows.where("false"))
    assert done["changed"] == 3 and done["rewritten"] <= 3 and rewrites.read(spark, table).count() == 397


def test_a_reader_keeps_its_snapshot(spark, table):
    old = rewrites.read(spark, table)
    rewrites.rewrite(spark, table, F.col("text") == "hit", lambda rows: rows.withColumn("text", F.lit("new")))
    assert old.where("text = 'hit'").count() == 4 and rewrites.read(spark, table).where("text = 'hit'").count() == 0


def test_a_failed_run_changes_nothing(spark, table):
    before = rows_of(rewrites.read(spark, table))
    with pytest.raises(Exception, match="no such luck"):
        rewrites.rewrite(spark, table, F.col("id") > 390, lambda rows: rows.withColumn("text", F.raise_error(F.lit("no such luck")).cast("string")))
    assert rewrites.versions(spark, table) == [0] and rows_of(rewrites.read(spark, table)) == before


def test_two_writers_cannot_add_the_same_version(spark, table):
    def meanwhile(rows):
        rewrites.rewrite(spark, table, F.col("id") == 1, lambda r: r.withColumn("text", F.lit("first")))
        return rows.withColumn("text", F.lit("second"))

    with pytest.raises(Exception, match="[Ee]xist"):
        rewrites.rewrite(spark, table, F.col("id") == 2, meanwhile)
    assert rewrites.versions(spark, table) == [0, 1]
    assert {r.id: r.text for r in rewrites.read(spark, table).where("id < 3").collect()} == {0: "other", 1: "first", 2: "other"}


def test_new_columns_read_as_null_in_old_files(spark, table):
    rewrites.rewrite(spark, table, F.col("text") == "hit", lambda rows: rows.withColumn("seen", F.lit(True)))
    got = {r.id: r.seen for r in rewrites.read(spark, table).collect()}
    assert len(got) == 400 and [i for i, s in got.items() if s] == [i for i in got if i % 100 == 7]
    assert Path(table, "_versions").exists()


def test_chunks_in_sql_equal_the_operator(spark):
    pages = spark.createDataFrame([(1, 0, "word. " * 900, "x"), (1, 1, None, "x"), (2, 0, "", "x"), (3, 0, "a b " * 700, "x")], "doc_id bigint, page_index int, text string, more string")
    pages.createOrReplaceTempView("some_pages")
    table_functions.register(spark)
    assert rows_of(spark.sql("select doc_id, page_index, chunk, start, text from chunks(table(some_pages))")) == rows_of(ner.split_into_chunks(pages))
    small = spark.sql("select start, text from chunks(table(select * from some_pages where doc_id = 3), 100, 10)")
    assert rows_of(small) == sorted((a, ("a b " * 700)[a:b]) for a, b in ner.chunk_bounds("a b " * 700, 100, 10))
    assert rows_of(spark.sql("select doc_id, count(*) from chunks(table(select * from some_pages) partition by doc_id) group by doc_id"))
    with pytest.raises(Exception, match="no column text"):
        spark.sql("select * from chunks(table(select doc_id, page_index from some_pages))").collect()


def test_a_detector_of_ones_own(spark):
    spark.createDataFrame([(1, 0, "see ABC-12 and XY-9, DEF-7"), (2, 0, None)], "doc_id bigint, page_index int, text string").createOrReplaceTempView("coded_pages")
    table_functions.register_detector(spark, "find_codes", lambda text: [("IDENTIFIER", 0.9, m.start(), m.end()) for m in re.finditer("[A-Z]{3}-[0-9]+", text)])
    got = spark.sql("select doc_id, ord, label, text, char_start, char_end from find_codes(table(coded_pages)) where confidence > 0.5")
    assert rows_of(got) == [(1, 0, "IDENTIFIER", "ABC-12", 4, 10), (1, 1, "IDENTIFIER", "DEF-7", 21, 26)]


def test_appended_replaced_and_cleared(spark, tmp_path):
    table = str(tmp_path / "t")
    rewrites.create_empty(spark, table, "id bigint, text string")
    assert rewrites.read(spark, table).count() == 0 and rewrites.rewrite(spark, table, F.lit(True), lambda rows: rows)["changed"] == 0
    assert rewrites.append(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "id bigint, text string"), table) == 1
    assert rewrites.append(spark.createDataFrame([("b", 2)], "more string, id bigint"), table) == 2
    assert sorted(map(repr, rewrites.read(spark, table).select("id", "text", "more").collect())) == sorted(["Row(id=1, text='a', more=None)"] * 2 + ["Row(id=2, text=None, more='b')", "Row(id=None, text=None, more=None)"])
    rewrites.replace(rewrites.read(spark, table).where("id = 2"), table)
    assert rewrites.read(spark, table).count() == 1 and rewrites.read(spark, table, 2).count() == 4
    rewrites.clear(spark, table)
    assert rewrites.read(spark, table).columns == ["id", "text", "more"] and rewrites.read(spark, table).count() == 0
    with pytest.raises(ValueError, match="no table"):
        rewrites.read(spark, str(tmp_path / "none"))


FIRST = migrations.Migration("001_first", create={"documents": "id bigint, filename string"})
SECOND = migrations.Migration("002_log", create={"entity_log": "id bigint, label string"}, add={"documents": "user_id bigint"})
THIRD = migrations.Migration("003_pages", add={"documents": "pages_json string, FILENAME string"})


def test_migrations_run_once_and_in_order(spark, tmp_path):
    root, table = str(tmp_path), str(tmp_path / "documents")
    assert migrations.migrate(spark, root, [FIRST]) == ["001_first"]
    rewrites.append(spark.createDataFrame([(1, "a.pdf")], "id bigint, filename string"), table)
    before = list(Path(table, "data").rglob("*.parquet"))
    assert migrations.migrate(spark, root, [THIRD, SECOND, FIRST]) == ["002_log", "003_pages"]
    assert rewrites.read(spark, table).columns == ["id", "filename", "user_id", "pages_json"]  # a column that is there is tolerated
    assert list(Path(table, "data").rglob("*.parquet")) == before
    rewrites.append(spark.createDataFrame([(2, "b.pdf", 5, "[]")], "id bigint, filename string, user_id bigint, pages_json string"), table)
    versions = rewrites.versions(spark, table)
    assert migrations.migrate(spark, root, [FIRST, SECOND, THIRD]) == [] and rewrites.versions(spark, table) == versions
    assert rows_of(rewrites.read(spark, table).where("id = 2")) == [(2, "b.pdf", 5, "[]")]
    assert rows_of(rewrites.read(spark, table).where("pages_json is null")) == [(1, "a.pdf", None, None)]
    assert [(r.id, r.name) for r in migrations.applied(spark, root).orderBy("id").collect()] == [(1, "001_first"), (2, "002_log"), (3, "003_pages")]


def test_a_migration_that_fails_stops_the_rest_and_can_run_again(spark, tmp_path):
    root = str(tmp_path)
    broken = migrations.Migration("002_log", create={"entity_log": "id bigint"}, add={"missing": "x int"})
    with pytest.raises(ValueError, match="no table"):
        migrations.migrate(spark, root, [FIRST, broken, THIRD])
    assert [r.name for r in migrations.applied(spark, root).collect()] == ["001_first"]
    assert migrations.migrate(spark, root, [FIRST, SECOND, THIRD]) == ["002_log", "003_pages"]  # the log that the first try made stays
    assert rewrites.read(spark, f"{root}/entity_log").columns == ["id"]
    with pytest.raises(ValueError, match="one name"):
        migrations.migrate(spark, root, [FIRST, FIRST])
    with pytest.raises(ValueError, match="not a table"):
        migrations.migrate(spark, root, [migrations.Migration("009", create={"../x": "id int"})])
