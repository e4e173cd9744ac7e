"""Edit distances of all pairs, block by block."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.functions.text import normalized_similarity
from veilspan.operators import name_pairs
from veilspan.plans import scalars


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def names(seed):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice("abé𝄞#") for _ in range(n)) for n in (1, 5, 17, 18, 18, 63, 64, 65, 130)), "Supplier#000000012", "Supplier#000000013", "Supplier#000000013"]


def test_distances_equal_the_plain_ones():
    left, right = names(1), sorted(names(2))
    found = name_pairs.Distances(left)
    for b in right:
        assert found.to(b).tolist() == [plain(a, b) for a in left] == [name_pairs.distance(a, b) for a in left]


@pytest.mark.parametrize("similar", [False, True])
def test_pairs_equal_spark(spark, similar):
    schema = "g int, k long, n string"
    left = spark.createDataFrame([(k % 2, k, n) for k, n in enumerate([*names(3), None] * 2)] + [(None, 99, "x")], schema)
    right = spark.createDataFrame([(k % 3, k, n) for k, n in enumerate([*names(4), None, *names(3)])], schema)
    got = name_pairs.pairs(left, right, similar=similar).collect()
    a, b = F.col("a.n"), F.col("b.n")
    value = F.round(normalized_similarity(a, b), 6) if similar else F.levenshtein(a, b)
    want = left.alias("a").join(right.alias("b"), "g").select("a.k", "b.k", value).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) > 200


def test_blocks_and_pieces_hold_every_pair(monkeypatch):
    monkeypatch.setattr(name_pairs, "BLOCK", 3)
    monkeypatch.setattr(name_pairs, "PIECE", 4)
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 7 + [2]), pa.array([0] * 4 + [1] * 4), pa.array(range(8)), pa.array(list("abcdefgh"))], ["g", "p", "k", "n"])
    packed = list(name_pairs._packed(iter([rows])))[0]
    assert packed.column("keys").to_pylist() == [[0, 1, 2], [3], [4, 5, 6], [7]]
    met = pa.RecordBatch.from_arrays([packed.column("keys").slice(0, 1), packed.column("names").slice(0, 1), packed.column("keys").slice(2, 1), packed.column("names").slice(2, 1)], ["left_keys", "left_names", "right_keys", "right_names"])
    out = list(name_pairs._pieces(False)(iter([met])))
    assert len(out) == 3 and sorted((r["left_key"], r["right_key"], r["value"]) for b in out for r in b.to_pylist()) == [(a, b, 1) for a in range(3) for b in range(4, 7)]


def test_similarities_round_as_spark(spark):
    cases = [(d, n) for n in range(40) for d in range(n + 1)]
    want = [r[0] for r in spark.createDataFrame(cases, "d int, n int").coalesce(1).select(F.round(1 - F.col("d") / F.greatest("n", F.lit(1)), 6)).collect()]
    assert [float(name_pairs.similarities(np.array([d]), np.array([n]), 0)[0]) for d, n in cases] == want


@pytest.mark.parametrize("query", [scalars.fn06_similarity, scalars.fn07_levenshtein])
def test_distances_are_taken_by_blocks_of_names(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow levenshtein_pairs" in plan and "levenshtein(" not in plan.replace("levenshtein_pairs(", "")
