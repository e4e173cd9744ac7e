"""The stream with keyed state: equal to the stream that reads its earlier output, whatever order and batches pages come in."""

import json
import random

from pyspark.sql import functions as F

from veilspan.operators.leaders import Leaders
from veilspan.plans import rulebook
from veilspan.streaming import progressive, stateful

PAGES = "doc_id bigint, page_index int, text string"
RULES = "kind string, norm_text string, label string"


def documents(rng):
    """Names that come back in other cases, with formatting marks, broken over lines, and on pages before they are detected."""
    names = ["Dupont", "Martineau", "Lefebvre", "Anderson", "Beaumont", "Dupond"]
    spell = lambda n: rng.choice([n, n.lower(), n.upper(), f"**{n}**", f"{n[:2]}*{n[2:]}_", n])
    return [(d, p, " ".join(rng.choice(["et", "la", "vu", "\n", spell(rng.choice(names))]) for _ in range(rng.choice([0, 4, 25])))) for d in range(6) for p in range(rng.randint(1, 5))]


def run_progressive(spark, pages, rules):
    found = spark.createDataFrame([], progressive.STEP)
    for index in sorted({p[1] for p in pages}):
        batch = spark.createDataFrame([p for p in pages if p[1] == index], PAGES)
        found = found.unionByName(spark.createDataFrame(progressive.process_step(batch, found, rules, rulebook._name_detector).collect(), progressive.STEP))
    return sorted(map(repr, found.collect()))


def run_stateful(spark, base, pages, rules, batches):
    for batch in batches:
        spark.createDataFrame(batch, PAGES).write.mode("append").parquet(f"{base}/in")
        query = stateful.start(spark.readStream.schema(PAGES).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint", rulebook._name_spans, rules)
        query.awaitTermination()
    return sorted(map(repr, spark.read.schema(progressive.STEP).parquet(f"{base}/out").collect())), query.lastProgress


def test_state_gives_the_same_spans_in_any_batches(spark, tmp_path):
    rng = random.Random(8)
    pages = documents(rng)
    rules = spark.createDataFrame([("suppress", "lefebvre", None), ("override", "anderson", "ORGANIZATION"), ("force", "vu", "DATE")], RULES)
    expected = run_progressive(spark, pages, rules)
    assert any("0.45" in r or "0.54" in r for r in expected)  # something was propagated
    shuffled = rng.sample(pages, len(pages))
    marks = [(d, 1 + max(p for x, p, _ in pages if x == d), None) for d in {p[0] for p in pages}]
    # pages come before their predecessors, some come twice, and the end marks last
    found, progress = run_stateful(spark, str(tmp_path), pages, rules, [shuffled[:8], shuffled[4:], pages[:5] + marks])
    assert found == expected
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_an_end_mark_works_off_what_waits(spark, tmp_path):
    none = spark.createDataFrame([], RULES)
    pages = [(1, 0, "Dupont"), (1, 2, "dupont et Martineau"), (1, 4, "martineau")]
    found, _ = run_stateful(spark, str(tmp_path), pages, none, [[pages[1], pages[2]], [pages[0]], [(1, 5, None)]])
    assert len(found) == 4 and sum("page_index=2" in r for r in found) == 2 and sum("page_index=4" in r for r in found) == 1


def test_normal_forms_equal_the_column_functions(spark):
    from veilspan.functions import text as fn

    rng = random.Random(3)
    texts = ["".join(rng.choice("aÀé ǅİß_*-\t\n\xa0\x1c 한ﬁ9.") for _ in range(rng.randrange(12))) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.normalize(F.col("t")).alias("n"), fn.normalize_fuzzy(F.col("t")).alias("f")).collect():
        assert (stateful.normalize(r.t), stateful.fuzzy(r.t)) == (r.n, r.f)


def test_a_page_step_costs_what_its_clusters_cost():
    """Pages that repeat the same names leave as many clusters as there are names, however many pages came before."""
    known = Leaders()
    for index in range(200):
        stateful.page_step(known, index, "Dupont et Martineau", [{"label": "PERSON", "text": t, "norm_text": t.lower(), "confidence": 0.5, "source": "ner", "char_start": a, "char_end": a + len(t)} for t, a in (("Dupont", 0), ("Martineau", 10))], frozenset(), {})
    assert [c["variants"] for c in known.clusters] == [["Dupont"], ["Martineau"]] and len(json.dumps(known.clusters)) < 500
