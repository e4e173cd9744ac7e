"""What a batch of pages takes of a Python worker: each page scanned and resolved once, a block of bytes or spans at a time."""

import pyarrow as pa
import pytest

from veilspan.operators import scanning
from veilspan.plans import detection, resolution

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "steps"), [(resolution.spn04_resolve, 2), (resolution.spn05_deduplicate, 2), (resolution.spn07_combine, 2), (detection.det13_spans, 1)])
def test_no_page_is_scanned_a_second_time_for_a_filter(spark, query, steps):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == steps


def test_blocks_of_spans_change_nothing(monkeypatch):
    span = lambda ord, label, a, z, source="regex": {"ord": ord, "label": label, "text": "x", "norm_text": "x", "confidence": 0.5 + ord / 10, "source": source, "char_start": a, "char_end": z}
    lists = pa.array([[span(0, "A", 0, 5), span(1, "A", 0, 5), span(2, "B", 1, 6, "ner")], [], None, [span(0, "A", 3, 9)], [span(k, "ABC"[k % 3], k, k + 4) for k in range(7)]], pa.list_(scanning.SPAN))
    for unique, resolved in ((True, True), (True, False), (False, True)):
        body = scanning.processed(unique, resolved)
        whole = body(lists).to_pylist()
        assert len(whole) == 5 and whole[3]
        with monkeypatch.context() as m:
            m.setattr(scanning, "BLOCK_SPANS", 2)
            assert body(lists).to_pylist() == body(lists.slice(0)).to_pylist() == whole
            assert body(lists.slice(3)).to_pylist() == whole[3:]
        assert body(lists.slice(0, 0)).to_pylist() == []
