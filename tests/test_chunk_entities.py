"""Whole pages through a model without a row for each token."""

from pyspark.sql import functions as F

from veilspan.operators import chunk_entities, ner
from veilspan.plans import model

SF = "/root/testdata/sf0.001"


def test_tokens_and_entities_of_pages_are_not_shuffled(spark):
    plan = model.ner16_pages(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Window", "Join", "Sort", "Generate"))


def test_a_page_is_one_whatever_batches_its_chunks_come_in(spark):
    text = " ".join(f"rue {k} Lilas Dupont" for k in range(700))
    pages = spark.createDataFrame([(d, 0, text[d:]) for d in range(4)] + [(3, 0, "Dupont"), (9, 0, None)], "doc_id long, page_index int, text string").coalesce(1)
    labels = F.array(*map(F.lit, model.TAGS))
    found = lambda: sorted(map(repr, ner.predict_pages(pages, model.halves, labels).collect()))
    whole, most = found(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found() == whole and len(whole) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_blocks_of_chunks_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    texts = ["Jean Dupont, rue", "", "l'île d'Yeu", "x"]
    words = [t.split() for t in texts]
    tokens = pa.array([[{"word": w, "is_word_start": k != 1, "logits": [0.1 * ((len(w) + 3 * j) % 5) + 9 * (j == (len(w) + k) % 7) for j in range(9)]} for k, w in enumerate(ws)] for ws in words], pa.list_(pa.struct([("word", pa.string()), ("is_word_start", pa.bool_()), ("logits", pa.list_(pa.float64()))])))
    body = chunk_entities.chunk_entities(ner.align_tokens, ner.THRESHOLDS)
    whole = body(pa.array(texts), tokens, pa.array([list(model.TAGS)] * 4)).to_pylist()
    monkeypatch.setattr(chunk_entities, "BLOCK_CHUNKS", 1)
    assert body(pa.array(texts), tokens, pa.array([list(model.TAGS)] * 4)).to_pylist() == whole
    assert [e["char_end"] for e in whole[0]] and not whole[1]
