"""Drafts that the stream saves."""

import json
from collections import Counter

from veilspan.operators import rewrites
from veilspan.streaming import progressive

SF = "/root/testdata/sf0.001"


def test_the_streams_drafts_hold_the_spans_so_far(spark):
    from veilspan.plans import rulebook
    from veilspan.sources.tables import conversation_pages

    base = rulebook._drafted(spark, SF)
    got = {r.doc_id: r for r in rewrites.read(spark, f"{base}/drafts").collect()}
    last = {r[0]: r[1] for r in conversation_pages(spark, SF).groupBy("doc_id").agg({"page_index": "max"}).collect()}
    assert {d: r.page_count for d, r in got.items()} == {d: (m + 1) // 2 * 2 for d, m in last.items() if m}
    spans = spark.read.parquet(f"{base}/out").collect()
    expected = Counter(s.doc_id for s in spans if s.doc_id in got and s.page_index < got[s.doc_id].page_count)
    assert {d: r.entity_count for d, r in got.items()} == {d: expected[d] for d in got}
    for d, r in got.items():
        held = [(e["page_index"], e["char_start"], e["char_end"], e["label"]) for e in json.loads(r.entities_json)]
        assert sorted(held) == sorted((s.page_index, s.char_start, s.char_end, s.label) for s in spans if s.doc_id == d and s.page_index < r.page_count)
        assert [h[0] for h in held] == sorted(h[0] for h in held)


def test_drafts_come_with_every_tenth_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, 9), (1, 19), (1, 20), (2, 8), (3, 9), (None, 9)], "doc_id bigint, page_index int")
    spans = spark.createDataFrame([(1, 3, "A", "x", 0, 1), (1, 19, "A", None, 5, 6), (1, 20, "A", "z", 0, 1), (1, 3, "A", "x", 0, 1), (2, 0, "A", "y", 0, 1)], "doc_id bigint, page_index int, label string, text string, char_start int, char_end int")
    found = progressive.drafts_of(pages, spans)
    rows = {r.doc_id: (r.page_count, r.entity_count) for r in found.collect()}
    assert rows == {1: (20, 3), 3: (10, 0), None: (10, 0)}
    path = str(tmp_path / "drafts")
    progressive.save_drafts(found, path)
    progressive.save_drafts(found, path)  # a batch that runs again
    progressive.save_drafts(progressive.drafts_of(pages.where("page_index = 9"), spans), path)  # and one that comes late
    assert {r.doc_id: (r.page_count, r.entity_count) for r in rewrites.read(spark, path).collect()} == rows
    progressive.save_drafts(progressive.drafts_of(pages.where("doc_id = 2"), spans), path)  # none due
    assert rewrites.read(spark, path).count() == 3
