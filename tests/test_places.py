"""Page searches by batches of pages: what is free, what the plans hold, and odd spans and pages."""

import random

from veilspan.operators import propagate
from veilspan.operators.places import Taken
from veilspan.plans import rulebook
from veilspan.streaming import progressive

SPAN = "doc_id bigint, page_index int, ord bigint, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"
PAGES = "doc_id bigint, page_index int, text string"
RULES = "kind string, norm_text string, label string"


def test_taken_equals_the_plain_rule():
    rng = random.Random(5)
    for _ in range(200):
        spans = [(a := rng.randrange(60), a + rng.randrange(7)) for _ in range(rng.randrange(8))]
        taken, kept = Taken(spans), []
        for _ in range(40):
            a = rng.randrange(60)
            b = a + rng.randrange(7)
            free = not any(x < b and y > a for x, y in spans + kept)
            assert taken.overlaps_spans(a, b) == any(x < b and y > a for x, y in spans)
            assert taken.take(a, b) == free
            kept += [(a, b)] * free


def test_a_step_compares_no_texts_in_its_plan(spark):
    """Clusters and places come from batches: no comparison of every text with every cluster, no window over all places, no page text in the last join."""
    none = lambda schema: spark.createDataFrame([], schema)
    step = progressive.process_step(none(PAGES), none(progressive.STEP), none(RULES), rulebook._name_detector)
    plan = step._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "aggregate(" not in plan and plan.count("Window") == 1
    assert "levenshtein" not in propagate.propagate(none(SPAN), none(PAGES))._jdf.queryExecution().optimizedPlan().toString()


def test_odd_spans_and_pages(spark):
    """Missing texts are like no other, pages without a number get nothing, and a page that is there twice has its spans twice."""
    spans = spark.createDataFrame([(1, 0, 0, "A", None, None, None, "ner", 0, 1), (1, 0, 1, "B", "Dupont", "dupont", 0.5, "ner", 3, 9), (1, 0, 2, "C", None, None, 0.9, "ner", 0, 1)], SPAN)
    pages = spark.createDataFrame([(1, 0, "vu Dupont"), (1, 1, "dupont, DUPONT"), (1, 1, "dupont, DUPONT"), (1, None, "Dupont"), (None, 1, "Dupont"), (2, 1, "Dupont"), (1, 2, None)], PAGES)
    assert [c.text for c in sorted(propagate.leader_clusters(spans).collect(), key=lambda c: c.cluster)] == [None, "Dupont", None]
    want = [(1, 1, "B", "DUPONT", 8, 14)] * 2 + [(1, 1, "B", "dupont", 0, 6)] * 2
    rows = lambda df: sorted((r.doc_id, r.page_index, r.label, r.text, r.char_start, r.char_end) for r in df.collect())
    assert rows(propagate.propagate(spans, pages)) == want
    rules = spark.createDataFrame([("override", "dupont", "DATE"), ("suppress", "other", None)], RULES)
    assert rows(propagate.propagate_to_page(spans, pages, rules)) == [(*w[:2], "DATE", *w[3:]) for w in want]
    assert rows(propagate.propagate_to_page(spans, pages, rules.union(spark.createDataFrame([("suppress", "dupont", None)], RULES)))) == []


def test_a_streams_rules_are_made_once(spark, monkeypatch):
    class Ended:
        def awaitTermination(self):  # noqa: N802
            pass

    made = []
    monkeypatch.setattr(rulebook, "_stored_rules", lambda *a: made.append(a) or (lambda: None))
    monkeypatch.setattr(rulebook, "_page_indexes", lambda *a: [0, 1])
    monkeypatch.setattr(rulebook, "_feed", lambda *a: None)
    monkeypatch.setattr(rulebook, "_streamed", lambda *a: None)
    reader = type("R", (), {"readStream": property(lambda s: s), "schema": lambda s, *a: s, "parquet": lambda s, *a: s})
    monkeypatch.setattr(rulebook, "shared_path", lambda s: "base")
    monkeypatch.setattr(rulebook, "conversation_pages", lambda *a: None)
    monkeypatch.setattr(rulebook.progressive, "start", lambda *a, **k: Ended())
    for query in (rulebook._stream, rulebook.str03_resume, rulebook.str06_repeated_batch, rulebook._drafted):
        made.clear()
        query(reader(), "sf")
        assert len(made) == 1, query
