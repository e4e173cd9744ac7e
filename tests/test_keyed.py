"""Keyed tables in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import keyed, rewrites

ROWS = "id bigint, name string, seq bigint"


@pytest.fixture(params=[keyed.BROADCAST_BYTES, -1], ids=["sent", "shuffled"])
def way(request, monkeypatch):
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", request.param)
    return request.param


def rows_of(spark, table):
    return sorted((tuple(r) for r in rewrites.read(spark, table).collect()), key=repr)


def test_batches_equal_a_dictionary(spark, tmp_path, way):
    table, rng = str(tmp_path / "t"), random.Random(3)
    held = {}

    def apply(rows):
        for i, name, seq in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or "")):
            was = held.get(i)
            if was is None or was[1] is None or (seq is not None and seq >= was[1]):
                held[i] = (name, seq)

    def some(n, low, high):
        return [(rng.choice([None, *range(low, high)]), rng.choice([None, "", "a", "b", "é" * 2000]), rng.choice([None, *range(60)])) for _ in range(n)]

    first = some(300, 0, 200)
    apply(first)
    keyed.create(spark.createDataFrame(first, ROWS), table, ["id"], "seq", 8)
    for n in (40, 1):
        batch = some(n, 100, 300)
        # in a batch the last change alone counts
        last = {}
        for r in sorted(batch, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or "")):
            last[r[0]] = r
        apply(list(last.values()))
        keyed.upsert(spark.createDataFrame(batch, ROWS), table)
        assert rows_of(spark, table) == sorted(((i, name, seq) for i, (name, seq) in held.items()), key=repr)


def test_only_files_of_the_keys_are_read_and_written(spark, tmp_path):
    table = str(tmp_path / "t")
    keyed.create(spark.range(4000).select("id", F.lit("x").alias("name"), F.lit(1).cast("bigint").alias("seq")), table, ["id"], "seq", 16)
    before = set(rewrites._manifest(spark, table)[1])
    done = keyed.upsert(spark.createDataFrame([(7, "new", 2)], ROWS), table)
    assert done == {"version": 1, "replaced": 1, "added": 0, "read": 1, "rewritten": 1, "files": 16}
    assert len(before - set(rewrites._manifest(spark, table)[1])) == 1 and rewrites.read(spark, table).where("name = 'new'").count() == 1
    done = keyed.upsert(spark.createDataFrame([(9001, "new", 2), (9, "late", 0)], ROWS), table)  # a new key, and a change that comes late
    assert (done["replaced"], done["added"], done["rewritten"]) == (0, 1, 0) and rewrites.read(spark, table).count() == 4001
    assert rewrites.read(spark, table, 0).where("name = 'x'").count() == 4000  # readers of older versions keep them
    versions = rewrites.versions(spark, table)
    assert keyed.upsert(spark.createDataFrame([], ROWS), table)["added"] == 0 and rewrites.versions(spark, table) == versions
    assert not list((tmp_path / "t" / "stage").iterdir())
    assert keyed.compact(spark, table, 1) == 1 and len(rewrites._manifest(spark, table)[1]) == 16 and rewrites.read(spark, table).count() == 4001


def test_the_stored_side_is_not_exchanged(spark, tmp_path):
    table = str(tmp_path / "t")
    keyed.create(spark.range(4000).select("id", F.lit("x").alias("name"), F.lit(1).cast("bigint").alias("seq")), table, ["id"], "seq", 4)
    stored, changes = rewrites.read(spark, table), spark.createDataFrame([(7, "new", 2)], ROWS)
    for df in (keyed.found(stored, F.broadcast(changes), ["id"], "seq"), keyed.merged(stored, F.broadcast(changes), ["id"], "seq")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_columns_that_one_side_lacks(spark, tmp_path):
    table = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(1, "a", "k", 1), (2, "b", "k", 1)], "id bigint, name string, kind string, seq bigint"), table, ["kind", "id"], "seq", 2)
    keyed.upsert(spark.createDataFrame([("k", 1, 5, True), ("m", 1, 5, False)], "kind string, id bigint, seq bigint, seen boolean"), table)
    assert sorted(map(repr, rewrites.read(spark, table).select("id", "name", "kind", "seq", "seen").collect())) == sorted([
        "Row(id=1, name='a', kind='k', seq=5, seen=True)", "Row(id=2, name='b', kind='k', seq=1, seen=None)", "Row(id=1, name=None, kind='m', seq=5, seen=False)",
    ])
    empty = str(tmp_path / "e")
    keyed.create(spark.createDataFrame([], ROWS), empty, ["id"], "seq", 4)
    assert rewrites.read(spark, empty).count() == 0
    assert keyed.upsert(spark.createDataFrame([(1, "a", None), (1, "a", None)], ROWS), empty)["added"] == 1 and rows_of(spark, empty) == [(1, "a", None)]
