"""Candidate index, automaton, undo and redo, isolated failures and decompositions against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as fn
from veilspan.operators import edits, isolation, leaders, propagate, rules

SPAN = "doc_id bigint, page_index int, ord bigint, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def near_texts(rng, n):
    """Texts around the border of likeness: copies of a few with up to four edits, of 1 to 90 characters."""
    seeds = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 3, 10, 19, 20, 21, 40, 41, 60, 90]))) for _ in range(25)]
    out = []
    for _ in range(n):
        t = list(rng.choice(seeds))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", "b", "ab"])
        out.append("".join(t))
    return out


def test_edit_distance_within_a_bound():
    rng = random.Random(1)
    texts = near_texts(rng, 40)
    for a in texts:
        for b in rng.sample(texts, 15):
            for most in (0, 1, 2, 4):
                assert leaders.within(a, b, most) == (distance(a, b) <= most)


def test_index_finds_the_first_alike_cluster():
    rng = random.Random(2)
    found, plain = leaders.Leaders(), []
    for t in near_texts(rng, 700):
        confidence = rng.choice([0.5, 0.7, 0.9])
        at = next((k for k, c in enumerate(plain) if c[0] == t or 1 - distance(c[0], t) / max(len(c[0]), len(t), 1) >= 0.95), None)
        if at is None:
            plain.append([t, confidence, [t]])
        else:
            if t not in plain[at][2]:
                plain[at][2].append(t)
            if confidence > plain[at][1]:
                plain[at][:2] = [t, confidence]
        assert found.add(t, t, t, "A", confidence, "ner") == (len(plain) - 1 if at is None else at)
    assert [[c["fuzzy"], c["confidence"], c["variants"]] for c in found.clusters] == plain
    again = leaders.Leaders(found.clusters)
    assert [again.find(c[0]) for c in plain] == [found.find(c[0]) for c in plain]


def test_both_ways_of_clustering_agree(spark):
    rng = random.Random(3)
    rows = [(k % 3, 0, k, rng.choice("AB"), t.upper() if k % 4 else t, t, rng.choice([0.5, 0.8]), "ner", k, k + 1) for k, t in enumerate(near_texts(rng, 150))]
    spans = spark.createDataFrame(rows, SPAN)
    rows_of = lambda few: sorted(map(repr, propagate.leader_clusters(spans, few).collect()))
    assert rows_of(0) == rows_of(10**9) == rows_of(80)


def test_automaton_finds_what_single_needles_find(spark):
    rng = random.Random(4)
    needles = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))).strip() for _ in range(60)} | {"aa", "aaa", "b\\e"})
    texts = ["".join(rng.choice(["a", "A", "b", "é", " ", " \n\t", "\\E"]) for _ in range(rng.choice([0, 3, 200]))) for _ in range(25)] + [None, "a" * 50]
    pages = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id bigint, page_index int, text string")
    forced = spark.createDataFrame([(n, label) for n in needles for label in ("A", "B")][::-1] + [("", "A")], "norm_text string, rule_label string")
    run = lambda **how: sorted(map(repr, rules.find_in_pages(pages, forced, **how).collect()))
    alone = run(few=500)
    assert alone and run(few=0) == alone and run(few=0, block_chars=20) == alone


@pytest.mark.parametrize("most", [1, 3, 50])
def test_history_equals_stacks(spark, most):
    rng = random.Random(most)
    log = [(d, k, rng.choices(["edit", "undo", "redo", "other"], [3, 3, 2, 0.3])[0]) for d in range(4) for k in range(rng.choice([0, 1, 90, 260]))]
    expected, live = [], []
    for d in range(4):
        past, now, future = [], [None], []
        for _, seq, kind in [x for x in log if x[0] == d]:
            if kind == "edit":
                past, now, future = [*past, now][-most:], [*now, seq], []
            elif kind == "undo" and past:
                future, now, past = [*future, now], past[-1], past[:-1]
            elif kind == "redo" and future:
                past, now, future = [*past, now], future[-1], future[:-1]
            expected.append((d, seq, now[-1]))
        live += [(d, s) for s in now[1:]]
    df = spark.createDataFrame(log, "doc_id bigint, seq bigint, kind string")
    assert sorted(map(tuple, edits.history(df, most).select("doc_id", "seq", "state").collect()), key=repr) == sorted(expected, key=repr)
    assert sorted(map(tuple, edits.live_edits(df, most).collect())) == sorted(live)


def test_undone_edits_leave_no_trace(spark):
    spans = spark.createDataFrame([(1, 0, 0, "A", "t", "t", 0.5, "ner", 0, 1), (1, 0, 1, "A", "u", "u", 0.5, "ner", 2, 3)], SPAN)
    log = [(1, 1, "CHANGE_LABEL", 0, "B"), (1, 2, "REMOVE", 1, None), (1, 3, "undo", None, None), (1, 4, "CHANGE_LABEL", 1, "C"), (1, 5, "undo", None, None), (1, 6, "redo", None, None), (1, 7, "redo", None, None)]
    log = spark.createDataFrame(log, "doc_id bigint, seq bigint, type string, ord bigint, label string").withColumns({"char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int"), "text": F.lit(None).cast("string")})
    steps = log.select("doc_id", "seq", F.when(F.col("type").isin("undo", "redo"), F.col("type")).otherwise("edit").alias("kind"))
    left = edits.replay(spans, log.join(edits.live_edits(steps), ["doc_id", "seq"], "left_semi"))
    assert sorted((r.ord, r.label) for r in left.collect()) == [(0, "B"), (1, "C")]


def test_a_failing_page_is_a_row_of_its_own(spark):
    def detector(text):
        if "boom" in text:
            raise RuntimeError("no " + text)
        return [("PERSON", 0.9, m.start(), m.end()) for m in re.finditer("[A-Z][a-z]+", text)]

    pages = spark.createDataFrame([(1, 0, "Ann met Bob"), (1, 1, "boom Ann"), (2, 0, None), (2, 1, "Cid"), (3, 0, "never sent")], "doc_id bigint, page_index int, text string")
    found = isolation.guarded(pages.where("doc_id < 3"), detector)
    assert sorted((r.doc_id, r.page_index, r.ord, r.text, r.norm_text) for r in isolation.found_spans(found).collect()) == [(1, 0, 0, "Ann", "ann"), (1, 0, 1, "Bob", "bob"), (2, 1, 0, "Cid", "cid")]
    assert isolation.failures(found).collect() == [(1, 1, "RuntimeError: no boom Ann")]
    assert {(r.doc_id, r.page_index): r.status for r in isolation.statuses(pages, found).collect()} == {(1, 0): "ready", (1, 1): "error", (2, 0): "ready", (2, 1): "ready", (3, 0): "pending"}


def test_decompositions_of_every_script(spark):
    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k : k + 700]) for k in range(0, len(every), 700)] + ["Élan vital", "한국어 text", "क़लम", "é", "", "plain", None]
    plain = lambda t: None if t is None else re.sub("[̀-ͯ]", "", "".join(unicodedata.normalize("NFD", c) for c in t))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.remove_diacritics(F.col("t")).alias("p")).collect()
    assert all(r.p == plain(r.t) for r in got)
