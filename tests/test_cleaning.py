"""Whole texts cleaned by the batch give what the Columns give, in time that a text's white space doesn't square."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as fn
from veilspan.operators import cleaning, ner
from veilspan.operators import scanning
from veilspan.plans import model, scalars

PIECES = ("*", "**", "_", "__", "___", "#", "##", "#######", "-", "--", "---", "----", "+", ":", " : ", "\n", "\r", "\r\n", "\n- ", "\n+\t", "\n-\n-", " ", "  ", "\t", "\x0b", "\x0c", "\x1f", " ", " ", "　", "﻿", "\u0085", " ", "a", "B", "7", "É", "é", "é", "ǘ", "İ", "K", "Å", "ς", "Σ", "각", "가", "Ω", "日本", "😀", "̈́", "`", "≠", "½", "«", "»", "–", "—", ".", "'", '"', "(", "]")
PAIRS = ((cleaning.remove_diacritics, fn.remove_diacritics), (cleaning.normalize_fuzzy, fn.normalize_fuzzy), (cleaning.strip_markdown, ner.strip_markdown), (cleaning.normalize_for_match, ner.normalize_for_match))


@pytest.mark.parametrize("block", [1, 64, 1 << 23])
def test_batches_give_what_columns_give(spark, monkeypatch, block):
    monkeypatch.setattr(scanning, "BLOCK_BYTES", block)
    pick = random.Random(7)
    # Java's $ also matches before a last line's end, so none but white space stands there
    texts = [None, "", " ", "-", "- ", "́", *("".join(pick.choice(PIECES) for _ in range(pick.randint(1, 14))).rstrip("\u0085") for _ in range(3000)), *("x" + chr(c) + "y" for c in range(0x80, 0x3400) if chr(c) != "\u0085")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for ours, theirs in PAIRS:
        rows = df.select("t", ours(F.col("t")).alias("a"), theirs(F.col("t")).alias("b")).collect()
        assert [r for r in rows if r.a != r.b] == []


def test_long_white_space_is_linear(spark):
    df = spark.createDataFrame([("a" + " " * 400_000 + "b:c",)], "t string")
    assert df.select(cleaning.strip_markdown(F.col("t"))).first()[0] == "a b c"
    assert df.select(cleaning.normalize_fuzzy(F.col("t"))).first()[0] == "a bc"


@pytest.mark.parametrize("query", [scalars.fn04_diacritics, scalars.fn05_fuzzy, model.ner18_strip_markdown, model.ner20_normalize])
def test_documents_are_cleaned_by_the_batch(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan and "translate" not in plan
