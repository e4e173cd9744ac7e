"""A step of the stream computes what it uses several times once, and leaves nothing that readers of its output see."""

from pyspark.sql import functions as F

from veilspan.plans import model
from veilspan.streaming import progressive

SPANS = "doc_id bigint, page_index int, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"


def test_rules_own_spans_and_clusters_are_kept_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "vu Dupont et dupont")], "doc_id bigint, page_index int, text string")
    rules = spark.createDataFrame([], "kind string, norm_text string, label string")
    detect = lambda p: p.select("doc_id", "page_index", F.lit("PERSON").alias("label"), F.lit("Dupont").alias("text"), F.lit("dupont").alias("norm_text"), F.lit(0.5).alias("confidence"), F.lit("ner").alias("source"), F.lit(3).alias("char_start"), F.lit(9).alias("char_end"))
    kept, store = [], progressive.stored(spark, f"{tmp_path}/out/_step")
    none = spark.createDataFrame([], SPANS)
    found = progressive.process_step(pages, none, rules, detect, keep=lambda df, name: (kept.append(name), store(df, name))[1])
    found.write.parquet(f"{tmp_path}/out/batch=0")
    assert kept == ["rules", "own", "clusters"]
    places = sorted((r.char_start, r.char_end) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert places == [(3, 9), (13, 19)] == sorted((r.char_start, r.char_end) for r in progressive.process_step(pages, none, rules, detect).collect())


def test_results_are_computed_once(spark):
    plan = model.ner15_deduplicate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_page_texts_stay_out_of_merges(spark):
    plan = model.ner16_predict(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "first(page_text" not in plan and "min_by(before" in plan
