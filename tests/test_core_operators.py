"""Hand-computed cases, properties, and what SQL cannot express."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as fn
from veilspan.operators import detect, ner, propagate, rules, signatures, spans, tagging
from veilspan.streaming import progressive


def pages(spark, *texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, page_index int, text string")


SPAN = "doc_id long, page_index int, ord long, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"


def span(doc, page, ord_, label, text, conf, source, a, b):
    return (doc, page, ord_, label, text, text.lower(), conf, source, a, b)


def found(spark, text):
    return {(r.label, r.text) for r in detect.detect(pages(spark, text)).collect()}


def test_sample_of_every_identifier(spark):
    text = "Né le 15/03/1985, 12, rue des Lilas, 75011 Paris, jean@exemple.fr, 06 12 34 56 78, IBAN FR76 3000 6000 0112 3456 7890 189, SIREN 732 829 320."
    got = found(spark, text)
    assert ("DATE", "15/03/1985") in got and ("IDENTIFIER", "jean@exemple.fr") in got and ("IDENTIFIER", "06 12 34 56 78") in got
    assert ("IDENTIFIER", "FR76 3000 6000 0112 3456 7890 189") in got and ("IDENTIFIER", "732 829 320") in got


@pytest.mark.parametrize("text,hit", [("10 000 EUR", True), ("10 000 €.", False), ("100 000 euros", True), ("250.000 €", False)])
def test_amounts(spark, text, hit):
    assert any(t == text for _, t in found(spark, text + " dus")) is hit


def test_siren_inside_siret_is_dropped(spark):
    got = [r.text for r in detect.detect(pages(spark, "SIRET 732 829 320 00074 fin")).collect()]
    assert "732 829 320 00074" in got and "732 829 320" not in got


@pytest.mark.parametrize("number,valid", [("732829320", True), ("123456789", False), ("12", False)])
def test_checksum(spark, number, valid):
    assert spark.range(1).select(fn.siren_checksum(F.lit(number))).first()[0] is valid


def test_offsets_point_at_matches(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 é@.\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = pages(spark, *texts).withColumn("m", F.explode(fn.matches(F.col("text"), "[a-b]+|1")))
    for r in df.collect():
        assert r.text[r.m.start : r.m.stop] == r.m.text
    import re

    assert df.count() == sum(len(re.findall("[a-b]+|1", t)) for t in texts)


def test_occurrences_overlap_and_quote(spark):
    cases = [("aaaa", "aa"), ("xAxa", "xa"), ("a\\Eb\\Eb", "\\Eb"), ("", "a"), ("abc", ""), ("été ÉTÉ", "été"), ("(a)(a)", "(A)")]
    df = spark.createDataFrame(cases, "t string, n string").select("t", "n", fn.occurrences(F.col("t"), F.col("n")).alias("o"))
    for r in df.collect():
        low, small = r.t.lower(), r.n.lower()
        assert r.o == ([i for i in range(len(low)) if low.startswith(small, i)] if small else []), r


def test_resolution_leaves_no_conflict(spark):
    rng = random.Random(1)
    rows = []
    for d in range(40):
        for k in range(rng.randint(1, 12)):
            a = rng.randint(0, 40)
            rows.append(span(d, 0, k, rng.choice(["PERSON", "DATE"]), "x", rng.choice([0.5, 0.7, 0.95]), rng.choice(["ner", "regex", "user"]), a, a + rng.randint(1, 15)))
    kept = spans.process(spark.createDataFrame(rows, SPAN)).collect()
    assert kept
    for x in kept:
        for y in kept:
            if x.doc_id == y.doc_id and x.ord != y.ord:
                common = min(x.char_end, y.char_end) - max(x.char_start, y.char_start)
                assert common <= 0.5 * min(x.char_end - x.char_start, y.char_end - y.char_start)


def test_winner_evicts_its_whole_chain(spark):
    rows = [span(0, 0, 0, "DATE", "a", 0.5, "regex", 0, 10), span(0, 0, 1, "DATE", "b", 0.5, "regex", 10, 20), span(0, 0, 2, "DATE", "c", 0.9, "user", 2, 18)]
    assert [r.ord for r in spans.resolve(spark.createDataFrame(rows, SPAN)).collect()] == [2]


def test_tags_are_dense_and_rewriting_is_invertible(spark):
    text = "Paul et Marie et Paul, Lyon"
    rows = [span(0, 0, 0, "PERSON", "Paul", 0.9, "ner", 0, 4), span(0, 0, 1, "PERSON", "Marie", 0.9, "ner", 8, 13), span(0, 0, 2, "PERSON", "Paul", 0.9, "ner", 17, 21), span(0, 0, 3, "ADDRESS", "Lyon", 0.9, "ner", 23, 27)]
    s = spark.createDataFrame(rows, SPAN)
    tags = tagging.tag_map(s)
    assert {(r.norm_text, r.tag, r.n) for r in tags.collect()} == {("paul", "[PERSON_1]", 2), ("marie", "[PERSON_2]", 1), ("lyon", "[ADDRESS_1]", 1)}
    out = tagging.anonymize(pages(spark, text), tagging.with_tags(s, tags)).first().anonymized_text
    assert out == "[PERSON_1] et [PERSON_2] et [PERSON_1], [ADDRESS_1]"
    for r in tags.collect():
        out = out.replace(r.tag, r.original_texts[0])
    assert out == text


def test_chunks_cover_the_text():
    rng = random.Random(2)
    for n in (0, 1, 1500, 1501, 9000):
        text = "".join(rng.choice("abc  .\n") for _ in range(n))
        bounds = ner.chunk_bounds(text)
        assert bounds[0][0] == 0 and bounds[-1][1] == n
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_alignment():
    assert ner.align_tokens(["Jean", "pierre", "Du", "pont"], [True, False, True, False], "Jeanpierre  Dupont") == [(0, 4), (4, 10), (12, 14), (14, 18)]
    assert ner.align_tokens(["a", "zz", "b"], [True, True, True], "a b") == [(0, 1), None, (2, 3)]


DELIMITERS = set(".,;:!?()[]{}\"«»–—/\\-")


def entities_of_chunk(text, labels, tokens):
    """The steps from a chunk's tokens to its results, one token at a time."""
    ends = lambda c: c.isspace() or c in DELIMITERS
    bases, bars = ("PER", "ORG", "LOC"), {"PER": 0.6, "ORG": 0.7, "LOC": 0.6}
    runs, before = [], None
    places = ner.align_tokens([t[0] for t in tokens], [t[1] for t in tokens], text)
    for (_, starts, logits), place in zip(tokens, places, strict=True):
        if place is None:
            continue
        e = [math.exp(x - max(logits)) for x in logits]
        probs = [x / sum(e) for x in e]
        tag = labels[probs.index(max(probs))]
        base = {b: sum(p for p, t in zip(probs, labels, strict=True) if t[2:] == b) for b in bases}
        best = max(bases, key=lambda b: base[b])
        if base[best] < bars[best]:
            before = None
            continue
        gap = place[0] - before[1] if before else None
        follows = before and before[0] == best and (tag.startswith("I-") or (not starts and not tag.startswith("B-")) or (not starts and gap <= 1) or (best == "PER" and gap <= 2))
        if follows:
            runs[-1][1] = max(runs[-1][1], place[1])
            runs[-1][3].append(base)
        else:
            runs.append([*place, best, [base]])
        before = (best, place[1])
    kept = []
    for a, b, base, seen in runs:
        while a > 0 and not ends(text[a - 1]):
            a -= 1
        while b < len(text) and not ends(text[b]):
            b += 1
        p = {x: sum(s[x] for s in seen) / len(seen) for x in bases}
        word = text[a:b].strip()
        if len(word) > 1 and word.lower() not in ner.STOP_WORDS and not re.fullmatch(r"[\d\s.,;:!?'\"()-]+", word) and (len(word) > 2 or p[base] >= 0.9):
            kept.append([a, b, base, p, len(seen)])
    for k in kept:
        number = re.search(r"(?i)(\d+(?:\s*(?:bis|ter|quater|[a-c]))?[,\s]*)\s*$", text[max(0, k[0] - 30) : k[0]]) if k[2] == "LOC" else None
        if number:
            k[0] = k[0] - len(number.group(0)) + number.start(1) - number.start(0)
    def fits(base, gap):
        if base == "PER":
            return len(gap) <= 5 and re.fullmatch(r"[\s'-]*", gap)
        return base == "LOC" and len(gap) <= 30 and all(w.isdigit() or w in ner.BRIDGE_WORDS or len(w) <= 1 for w in re.split(r"[\s,]+", gap.lower()))

    for base in ("LOC", "PER"):
        out = []
        for a, b, kind, p, n in sorted(kept, key=lambda k: k[:2]):
            if out and kind == base == out[-1][2] and fits(base, text[out[-1][1] : a]):
                q, m = out[-1][3], out[-1][4]
                out[-1][0], out[-1][1], out[-1][3], out[-1][4] = min(out[-1][0], a), b, {x: (q[x] * m + p[x] * n) / (m + n) for x in p}, m + n
            else:
                out.append([a, b, kind, p, n])
        kept = out
    return [(a, b, ner.LABEL_OF[base], text[a:b], p[base]) for a, b, base, p, _ in kept]


def test_whole_pages_through_the_model(spark):
    """Chunks, alignment, entities and offsets composed, against the same steps in plain Python."""
    from veilspan.plans.model import TAGS, halves

    rng = random.Random(9)
    words = ["rue", "des", "Lilas", "12", "bis", "Paris", "Jean-Marc", "Dupont,", "Société", "(Anonyme)", "de", "la", "l'eau", "x", "Éloïse.", "75012"]
    texts = ["", "Paris", *(" ".join(rng.choice(words) for _ in range(n)) for n in (5, 60, 900, 2500)), "\n\n".join(" ".join(rng.choice(words) for _ in range(150)) for _ in range(9)), "Z" * 4000]
    p = pages(spark, *texts, None)
    labels = F.array(*map(F.lit, TAGS))
    got = sorted((r.doc_id, r.char_start, r.char_end, r.label, r.text, round(r.score, 9)) for r in ner.predict_pages(p, halves, labels).collect())
    chunks = [(d, a, t[a:b]) for d, t in enumerate(texts) for a, b in ner.chunk_bounds(t)]
    assert len(chunks) > 20
    seen = spark.createDataFrame([(*c,) for c in chunks], "d int, a int, text string").select("d", "a", "text", halves(F.col("text")).alias("tokens")).collect()
    by_page = {}
    for r in sorted(seen, key=lambda r: (r.d, r.a)):
        tokens = [(t.word, t.is_word_start, list(t.logits)) for t in r.tokens]
        by_page.setdefault(r.d, []).extend((a + r.a, b + r.a, *rest) for a, b, *rest in entities_of_chunk(r.text, TAGS, tokens))
    want = []
    for d, found_here in by_page.items():
        kept = []
        for x in sorted(found_here, key=lambda x: x[:4]):
            if kept and (kept[-1][1] > x[0] or kept[-1][3].lower() == x[3].lower()):
                kept[-1] = x if x[4] > kept[-1][4] else kept[-1]
            else:
                kept.append(x)
        want += [(d, a, b, label, text, round(score, 9)) for a, b, label, text, score in kept]
    assert got == sorted(want) and len(got) > 300
    assert all(texts[d][a:b] == text for d, a, b, _, text, _ in got)


def test_flexible_search(spark):
    cases = [("a **Je*an** _Dupont_, b", "Jean Dupont", [(4, 19)]), ("J.D.", "J.D.", [(0, 4)]), ("nothing", "Jean", []), ("x `p`(q", "p(q", [(3, 7)])]
    rows = [(k, t, n) for k, (t, n, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc_id long, text string, needle string")
    clusters = df.select("doc_id", F.lit(0).alias("cluster"), F.array("needle").alias("variants"))
    got = propagate.find_variants(clusters, df.select("doc_id", F.lit(0).alias("page_index"), "text")).collect()
    assert {k: [(r.char_start, r.char_end) for r in got if r.doc_id == k] for k in range(len(cases))} == {k: e for k, (_, _, e) in enumerate(cases)}


def test_tight_bounds(spark):
    df = spark.createDataFrame([("**abc**.", "abc"), ("****", "abcdefghi")], "m string, n string").select(*propagate.tight_bounds(F.col("m"), F.col("n")))
    assert [tuple(r) for r in df.collect()] == [(2, 5), (0, 4)]


def test_leader_keeps_label_and_takes_surer_text(spark):
    rows = [span(0, 0, 0, "PERSON", "Jean-Christophe Dupontel-Martin", 0.5, "ner", 0, 5), span(0, 0, 1, "DATE", "Jean-Christophe Dupontel Martin", 0.9, "regex", 9, 15)]
    c = propagate.leader_clusters(spark.createDataFrame(rows, SPAN)).collect()
    assert len(c) == 1 and c[0].label == "PERSON" and c[0].source == "ner" and c[0].text == "Jean-Christophe Dupontel Martin" and len(c[0].variants) == 2


def test_raw_offsets(spark):
    text = "  a \n\n b\tc "
    collapsed = " a b c "
    df = spark.createDataFrame([(text, i) for i in range(len(collapsed))], "t string, i int").select("i", rules.raw_offset(rules.stretches(F.col("t")), F.col("i")).alias("r"))
    for r in df.collect():
        assert text[r.r].strip() == collapsed[r.i].strip()


def test_signature_lines():
    assert signatures.group_into_lines([(0, 100, 10), (20, 102, 10), (0, 50, 10)], 6.0) == [0, 0, 1]
    assert signatures.group_into_lines([], 6.0) == []


def test_empty_tables(spark):
    none, no_pages = spark.createDataFrame([], SPAN), pages(spark)
    assert spans.process(none).count() == 0 and tagging.tag_map(none).count() == 0
    assert detect.detect(no_pages).count() == 0 and propagate.propagate(none, no_pages).count() == 0


def test_stream_equals_batch_steps(spark):
    """The stream's spans are those of the same steps applied by hand."""
    from veilspan.plans import rulebook
    from veilspan.plans.inputs import rules as rules_of
    from veilspan.sources.tables import conversation_pages

    sf = "/root/testdata/sf0.001"
    ours = rulebook.str01_progressive(spark, sf).collect()
    all_pages, earlier = conversation_pages(spark, sf), spark.createDataFrame([], progressive.STEP)
    for (k,) in sorted(all_pages.select("page_index").distinct().collect()):
        step = progressive.process_step(all_pages.where(F.col("page_index") == k), earlier, rules_of(spark, sf), rulebook._name_detector)
        earlier = spark.createDataFrame(earlier.collect() + step.select(*progressive._FIELDS).collect(), progressive.STEP)
    key = lambda r: (r.doc_id, r.page_index, r.char_start, r.char_end, r.label, round(r.confidence, 6))
    assert sorted(map(key, ours)) == sorted(map(key, earlier.collect()))


def test_resumed_and_repeated_stream(spark):
    from veilspan.plans import rulebook

    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, rulebook.str01_progressive(spark, sf).collect()))
    assert sorted(map(tuple, rulebook.str03_resume(spark, sf).collect())) == whole
    repeated = sorted(map(tuple, rulebook.str06_repeated_batch(spark, sf).collect()))
    assert repeated == whole
    assert all(r.suppressible == 0 for r in rulebook.str05_changing_rules(spark, sf).collect() if r.batch)


def test_binary_documents(spark, tmp_path):
    from veilspan.sources.readers import binary_documents

    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [(r.length, bytes(r.content)) for r in binary_documents(spark, str(tmp_path)).collect()] == [(8, b"%PDF-1.4")]


def test_white_space_of_every_kind(spark):
    """No-break and narrow no-break spaces are typed in French amounts and numbers; other engines' \\s takes them."""
    text = "Capital\u00a01\u202f500\u202f000\u00a0EUR, tél.\u00a006\u00a012\u00a034\u00a056\u00a078, SIREN 732\u00a0829\u00a0320, le 3\u00a0février\u202f2024"
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")
    found = {(r.text, r.norm_text) for r in detect.detect(pages).collect()}
    for part in ("1\u202f500\u202f000\u00a0EUR", "06\u00a012\u00a034\u00a056\u00a078", "732\u00a0829\u00a0320", "3\u00a0février\u202f2024"):
        assert any(t == part and n == part.replace("\u00a0", " ").replace("\u202f", " ").lower() for t, n in found), part


def test_matches_equal_python(spark):
    import re

    rows = ["a1b22c333", "", "no digits", "1", "12", "x\x01 7 \x02 8", "9" * 50, "1 " * 5000]
    df = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string")
    for r in df.select("t", fn.matches(F.col("t"), "[0-9]+").alias("m")).collect():
        assert [(m.start, m.stop, m.text) for m in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.t or "")]


@pytest.mark.parametrize("few", [0, 500])
def test_both_ways_of_searching_needles(spark, few):
    pages = spark.createDataFrame([(1, 0, "The  Old\n\n house, the old  HOUSE"), (1, 1, "old"), (2, 0, "  the\told"), (3, 0, "")], "doc_id long, page_index int, text string")
    needles = spark.createDataFrame([("the old", "A"), ("old house", "B"), ("o", "C"), ("", "D"), ("zz", "E")], "norm_text string, rule_label string")
    got = {(r.doc_id, r.page_index, r.norm_text, r.rule_label, r.char_start, r.char_end) for r in rules.find_in_pages(pages, needles, few).collect()}
    want = {(1, 0, "the old", "A", 0, 8), (1, 0, "the old", "A", 18, 25), (1, 0, "old house", "B", 5, 16), (1, 0, "old house", "B", 22, 32), (2, 0, "the old", "A", 2, 9)}
    assert {g for g in got if g[2] != "o"} == want
    assert sorted(g[4] for g in got if g[2] == "o" and g[:2] == (1, 0)) == [5, 12, 22, 28] and {g[4] for g in got if g[2] == "o" and g[:2] == (2, 0)} == {6}
