"""Batches of any pages: as if each page came in a batch of its own, in a number of batches that the longest document hardly changes."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import propagate
from veilspan.operators.leaders import Leaders
from veilspan.operators.places import fuzzy
from veilspan.plans import rulebook
from veilspan.streaming import progressive

PAGES = "doc_id bigint, page_index int, text string"
RULES = "kind string, norm_text string, label string"
NAMES = ["Dupont", "Martineau", "Lefebvre", "Anderson", "Beaumont", "Dupond", "Archibald Constantine Montgomery", "Archibald Constantine Montgomerys"]


def documents(rng):
    """Names in other cases, with marks, broken over lines; pages that are missing, there twice, null or without an index, and rows without a document."""
    spell = lambda n: rng.choice([n, n.lower(), n.upper(), f"**{n}**", f"{n[:2]}*{n[2:]}_", n])
    page = lambda: " ".join(rng.choice(["et", "la", "vu", "\n", spell(rng.choice(NAMES))]) for _ in range(rng.choice([0, 4, 25])))
    pages = [(d, p, page()) for d in range(6) for p in range(rng.randint(1, 6)) if rng.random() < 0.9]
    return [*pages, *[(d, 2, t) for d, p, t in pages if p == 2 and d % 2], (0, 1, None), (1, None, "Beaumont vu"), (None, 3, "Dupont et dupont"), (7, -3, "Dupont"), (7, 70, "dupont")]


def detector(pages):
    return rulebook._name_detector(pages)


def rows(df):
    return sorted(map(repr, df.select(*progressive._FIELDS).collect()))


def one_by_one(spark, pages, rules):
    """Every page index as a batch of its own, those without one first, by the step that joins."""
    found = spark.createDataFrame([], progressive.STEP)
    for index in sorted({p[1] for p in pages}, key=lambda i: (i is not None, i)):
        batch = spark.createDataFrame([p for p in pages if p[1] == index], PAGES)
        found = spark.createDataFrame(found.collect() + progressive.process_step(batch, found, rules, detector).select(*progressive._FIELDS).collect(), progressive.STEP)
    return found


@pytest.fixture(scope="module")
def case(spark):
    pages = documents(random.Random(11))
    rules = spark.createDataFrame([("suppress", "lefebvre", None), ("suppress", "be*aumont", None), ("suppress", None, None), ("override", "anderson", "ORGANIZATION"), ("override", "dupont", "A"), ("override", "dupont", "B"), ("override", "martineau", None)], RULES)
    return pages, rules, one_by_one(spark, pages, rules)


@pytest.mark.parametrize("most_rules", [progressive.MOST_RULES, 0])
def test_a_batch_of_many_pages_equals_batches_of_one(spark, case, most_rules, tmp_path):
    pages, rules, expected = case
    none = spark.createDataFrame([], progressive.STEP)
    whole = progressive.process_pages(spark.createDataFrame(pages, PAGES), none, rules, detector, most_rules=most_rules, keep=progressive.stored(spark, str(tmp_path)))
    assert rows(whole) == rows(expected)
    assert expected.where("abs(confidence * 10 - round(confidence * 10)) > 0.001").count() > 5  # what was brought keeps nine tenths


def test_two_batches_of_many_pages_equal_batches_of_one(spark, case):
    pages, rules, expected = case
    first = [p for p in pages if p[1] is None or p[1] < 3]
    found = progressive.process_pages(spark.createDataFrame(first, PAGES), spark.createDataFrame([], progressive.STEP), rules, detector)
    later = progressive.process_pages(spark.createDataFrame([p for p in pages if p not in first], PAGES), found, rules, detector)
    assert rows(found.unionByName(later)) == rows(expected)


def test_late_pages_take_from_all_that_is_known(spark):
    """A page that comes after later ones is searched for their texts, as by the step that joins."""
    rules, none = spark.createDataFrame([], RULES), spark.createDataFrame([], progressive.STEP)
    first, late = ([(1, 5, "vu Dupont et Martineau")], [(1, 2, "dupont, Lefebvre"), (1, 5, "MARTINEAU"), (1, 6, "lefebvre, dupont")])
    earlier = spark.createDataFrame(progressive.process_step(spark.createDataFrame(first, PAGES), none, rules, detector).collect(), progressive.STEP)
    found = progressive.process_pages(spark.createDataFrame(late, PAGES), earlier, rules, detector)
    by_hand = earlier
    for p in late:
        step = progressive.process_step(spark.createDataFrame([p], PAGES), by_hand, rules, detector).collect()
        by_hand = spark.createDataFrame(by_hand.collect() + step, progressive.STEP)
    assert rows(found.unionByName(earlier)) == rows(by_hand) and found.count() >= 4


def test_batches_grow_with_the_logarithm_of_the_pages(spark, monkeypatch):
    monkeypatch.setattr(rulebook, "_page_indexes", lambda *a: list(range(399)))
    ranges = rulebook._page_ranges(spark, "sf")
    assert len(ranges) == 9 and ranges[:3] == [(0, 0), (1, 2), (3, 6)] and ranges[-1] == (255, 398)
    monkeypatch.setattr(rulebook, "_page_indexes", lambda *a: [0, 4, 9, 11])
    assert rulebook._page_ranges(spark, "sf") == [(0, 0), (4, 9), (11, 11)]


def test_a_long_conversation_takes_few_batches(spark, tmp_path):
    """Twelve pages: the stream, its snapshots by page, and its closing pass, which holds a document's clusters once for many pages."""
    (tmp_path / "sf").mkdir()
    data = [(c, t, "user", f"Dupont vu {NAMES[t % 6]}" if t % 3 else "dupont et martineau") for c in range(3) for t in range(12 if c == 1 else 3)]
    spark.createDataFrame([*data, (4, None, "user", "Dupont")], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/sf/conversations.parquet")
    pages, out = rulebook._stream(spark, f"{tmp_path}/sf")
    spans = spark.read.parquet(out)
    assert spans.select("batch").distinct().count() <= 4
    expected = one_by_one(spark, [(c, t, x) for c, t, _, x in data], spark.read.parquet(out.removesuffix("out") + "rules"))
    assert rows(spans) == rows(expected)
    numbered = {r.batch: r.n for r in rulebook.str04_snapshots(spark, f"{tmp_path}/sf").collect()}
    assert numbered == {r.page_index: r.n for r in expected.groupBy("page_index").agg(F.count(F.lit(1)).alias("n")).collect()} and len(numbered) == 11  # nothing on the first page
    closed = progressive.close(spark, pages, out)
    assert sorted({r.page_index for r in closed.where("doc_id = 1").collect()}) == list(range(12))
    plan = propagate.propagate(progressive.numbered(spans), pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(page" in plan


def test_added_texts_are_taken_back():
    rng = random.Random(4)
    texts = [rng.choice(NAMES)[: rng.randint(3, 40)] for _ in range(80)]
    add = lambda to, part: [to.add(t, t.lower(), fuzzy(t), "A", rng.choice([0.5, 0.9]), "ner") for t in part]
    known, plain = Leaders(), Leaders()
    for k in range(0, 80, 8):
        known.begin()
        add(known, texts[k + 4 :])
        known.undo()
        state = rng.getstate()
        add(known, texts[k : k + 8])
        rng.setstate(state)
        add(plain, texts[k : k + 8])
        assert known.clusters == plain.clusters
