"""Signature rules: a page's tokens and lines are arrays, so nothing is joined or handed to pandas page by page."""

import pytest
from pyspark.sql import functions as F

from veilspan.operators import signatures
from veilspan.plans import detection


TOKENS = "doc_id long, page_index int, token_idx int, text string, char_start int, char_end int, bbox struct<x:double,y:double,width:double,height:double>"


@pytest.mark.parametrize("query", [detection.dsg03_lines, detection.dsg04_headings, detection.dsg06_id_lines, detection.dsg07_band, detection.dsg08_signatures])
def test_pages_are_neither_joined_nor_groups_of_pandas(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan


def test_pages_of_several_headings(spark):
    """Two headings over one id, a heading too far from any, a heading line with an id of its own, and a page without heights."""
    words = [("DocuSigned", 0, 700), ("by:", 60, 700), ("DocuSigned", 0, 680), ("x", 40, 680), ("by", 60, 680), ("Jean", 0, 670), ("AB12345678", 0, 660), ("CD12345678", 0, 640), ("DocuSigned", 0, 300), ("by:", 60, 300), ("EF12345678", 0, 100)]
    row = lambda d, k, w, x, y, h: (d, 0, k, w, 20 * k, 20 * k + len(w), (float(x), float(y), 6.0 * len(w), h))
    rows = [row(d, k, *w, h) for d, h in ((1, 10.0), (2, 0.0)) for k, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, TOKENS)
    lined = signatures.lined(tokens)
    assert sorted(map(tuple, signatures.token_lines(tokens).collect())) == [(1, 0, k, n) for k, n in enumerate((0, 0, 1, 1, 1, 2, 3, 4, 5, 5, 6))]
    assert sorted(map(tuple, signatures.id_lines(lined).collect())) == [(1, 0, 0, 700.0, 3, 660.0), (1, 0, 1, 680.0, 3, 660.0)]
    band = signatures.band_tokens(lined).groupBy("head").agg(F.array_sort(F.collect_list("token_idx")).alias("t")).collect()
    assert sorted((r.head, r.t) for r in band) == [(0, [2, 3, 4, 5, 6]), (1, [5, 6])]
    found = sorted((r.text, r.char_start, r.char_end) for r in signatures.detect_signatures(tokens).collect())
    assert found == [("DocuSigned x by Jean AB12345678", 40, 130), ("Jean AB12345678", 100, 130)]
