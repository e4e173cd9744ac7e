"""Detection and resolution by Arrow against the Column expressions, and pages whose spans stay in one array."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.operators import detect as det
from veilspan.operators import scanning
from veilspan.operators import spans as op
from veilspan.plans import duck
from veilspan.sources.tables import tokens

PIECES = ("732 829 320 00074", "732 829 320", "123 456 789", "+33 1 42 68 53 00", "06\u000b12.34-56 78", "a.b@c-d.example.com", "fr76 3000 6000 0112 3456 7890 189", "é", "日本", "😀", "€", "3 500 000 €.", "1,5 EUR",
          "12/03/2024", "3 FÉVRIER 2024", "1 Août 2023", "12, rue de l'Église, 75001 Paris", "69002 Lyon-Centre", "docusign  envelope id: 1A2B3C4D-00AA-11BB-22CC-000000000001", "\x01", "\x02", "\n", ".", ", ")


@pytest.fixture(scope="module")
def pages(spark):
    pick = random.Random(5)
    texts = [None, "", " ", "0", *(pick.choice(("", " ", "x")).join(pick.choice(PIECES) for _ in range(pick.randint(1, 12))) for _ in range(400))]
    return spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "doc_id long, page_index int, text string").repartition(2)


@pytest.mark.parametrize("block", [1, 1 << 23])
def test_arrow_finds_what_the_expressions_find(pages, monkeypatch, block):
    monkeypatch.setattr(scanning, "BLOCK_BYTES", block)
    found = {f: sorted(map(tuple, f(pages).collect())) for f in (det.detect, det.detect_resolved)}
    monkeypatch.setattr(det, "_by_arrow", lambda detectors: False)
    for f, rows in found.items():
        assert len(rows) > 400 and rows == sorted(map(tuple, f(pages).collect()))


def test_a_long_s_is_no_word_character(spark):
    """Boundaries are ASCII ones in patterns without case too, as in the checking SQL."""
    text = "ſfr76 3000 6000 0112 3456 7890 189 1,5 EURſ"
    found = det.detect(spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")).collect()
    con = duckdb.connect()
    con.execute("create table contracts as select 1 as doc_id, 0 as page_index, ? as text", [text])
    sql = duck.with_ctes(duck.detected()) + "select text, char_start, char_end from raw"
    assert sorted((r.text, r.char_start, r.char_end) for r in found) == sorted(con.execute(sql).fetchall())
    assert len(found) >= 2


def test_other_detectors_go_by_the_expressions(pages):
    own = (det.Detector("ahead", "X", 0.5, "[0-9]+(?=/)"), det.Detector("own", "Y", 0.5, "[0-9]+", valid=lambda m: F.length(m) == 2))
    assert not det._by_arrow(own[:1]) and not det._by_arrow(own[1:]) and det._by_arrow(det.DETECTORS)
    assert {r.label for r in det.detect(pages, own).collect()} == {"X", "Y"}


def test_pages_in_one_array(spark, pages):
    pick = random.Random(6)
    rows = [(d, d % 3, k, pick.choice("AB"), "t", "t", pick.choice((0.5, 0.8, 0.9)), pick.choice(("ner", "user", "regex")), a, a + pick.randint(0, 9)) for d in range(150) for k in range(pick.randint(1, 14)) for a in [pick.randint(0, 30)]]
    spans = spark.createDataFrame(rows, "doc_id long, page_index int, ord long, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int")
    listed = spans.groupBy("doc_id", "page_index").agg(F.collect_list(F.struct(*spans.columns[2:])).alias("spans"))
    of = lambda column: sorted(map(tuple, listed.select("doc_id", "page_index", column.alias("s")).select("doc_id", "page_index", F.inline("s")).collect()))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    s = F.col("spans")
    assert of(op.page_processed(s, resolved=False)) == rows_of(op.deduplicate(spans))
    assert of(op.page_processed(s, unique=False)) == rows_of(op.resolve(spans))
    assert of(op.page_processed(s)) == rows_of(op.process(spans))
    assert of(op.page_combined(s, lambda x: x["source"] == "ner")) == rows_of(op.combine(spans.where("source = 'ner'"), spans.where("source <> 'ner'")))
    met = op.attach_tokens(det.detect_resolved(pages), tokens(pages))
    attached = det.page_spans(pages, resolved=True).select("doc_id", F.explode(F.arrays_zip(s.alias("s"), op.page_words(F.col("text"), s).alias("w"))).alias("m"))
    assert rows_of(attached.select("doc_id", "m.s.ord", "m.w")) == rows_of(met.select("doc_id", "ord", "token_ids"))
