"""The pipeline's stages on their own inputs, and the numbered queries' SQL."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both, connection  # noqa: E402

import corpus_pipeline  # noqa: E402
from veilspan.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_numbered_query_matches_sql(spark, name):
    ours, theirs = both(spark, connection(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ours == theirs


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    lettered = spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '\\p{L}'").count()
    assert len(kept["language"]) == lettered
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"]))
    assert set(kept["near_duplicates"]) <= set(kept["lines"]) <= set(kept["language"])
    assert sorted(kept["mixture"]) == sorted(kept["encode"])


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_rows(spark, name):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra columns: a stage loses only what it is meant to."""
    filler = [(100 + k, f"some plain words of text number {k} that nobody else has written down {k}", "en", "a", 1) for k in range(30)]
    rows = [
        (1, "Same line\nother words here", "en", "a", 1), (1, "Same line\nother words here", "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id here at all, first", "fr", "b", 5), (None, "no id here at all, second one", "fr", "b", 5),
        (4, " \n\t\n ", "fr", "", 3), (5, "word " * 30_000, "en", "a", 9), (6, "x" * 60_000, "de", "a", 9), (7, "one id", None, "b", 1), (7, "with two different texts", "de", "b", 1), *filler,
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ("row", "_h1", "pass", "content", "lines")})
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, df, SF).collect()
    texts = lambda rs: {t for _, t, *_ in rs if t and t.strip()}
    if name == "language":
        assert all(r.lang for r in got) and len(got) <= len(rows)
    elif name == "lines":
        assert len(got) == len(rows)
    elif name == "near_duplicates":
        assert {r.text for r in got if r.text and r.text.strip()} == texts(rows) and len(got) == len(texts(rows)) + 1
    elif name == "mixture":
        assert {r.source for r in got} == {"a", "b"} and all(r.text for r in got)
    else:
        assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == sorted((i or 0, bool(t)) for i, t, *_ in rows)
    assert stage(spark, df.limit(0), SF).count() == 0
