"""Detection by a Python function whose failure on one page is that page's result, not the job's end."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

#: What a detector yields for a text: label, confidence, start and end.
Found = tuple[str, float, int, int]
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("char_start", pa.int32()), ("char_end", pa.int32())]))
_SCHEMA = "doc_id bigint, page_index int, text string, spans array<struct<label:string,confidence:double,char_start:int,char_end:int>>, error string"


def guarded(pages: DataFrame, detector: Callable[[str], Iterable[Found]]) -> DataFrame:
    """Pages (doc_id, page_index, text) with the ``spans`` that the detector finds, or with its ``error``.

    A page on which the detector raises has no spans and the error's name and words; the
    others go on. Null texts are empty. The function travels to the executors and sees one text at a time; only
    exceptions of it are caught, so a lost executor or worker is run again as ever.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, errors = [], []
            for text in batch.column(2).to_pylist():
                try:
                    spans.append([{"label": k, "confidence": c, "char_start": a, "char_end": b} for k, c, a, b in detector(text or "")])
                    errors.append(None)
                except Exception as e:  # whatever the detector raises is the page's result
                    spans.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _SPANS), pa.array(errors, pa.string())], ["doc_id", "page_index", "text", "spans", "error"])

    return pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "text").mapInArrow(run, _SCHEMA)


def found_spans(found: DataFrame, source: str = "ner") -> DataFrame:
    """The spans of pages that did not fail, with their texts and ``ord``, their order on the page."""
    text = F.substring(F.col("page_text"), F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start"))
    flat = found.where("error is null").select("doc_id", "page_index", F.col("text").alias("page_text"), F.posexplode("spans").alias("ord", "s"))
    return flat.select("doc_id", "page_index", F.col("ord").cast("long").alias("ord"), "s.label", text.alias("text"), normalize(text).alias("norm_text"), "s.confidence", F.lit(source).alias("source"), "s.char_start", "s.char_end")


def failures(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, error) of the pages to set aside."""
    return found.where("error is not null").select("doc_id", "page_index", "error")


def statuses(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pending, ready or error for each page; ready also where nothing was found."""
    met = pages.select("doc_id", "page_index").join(found.select("doc_id", "page_index", "error", F.lit(True).alias("_seen")), ["doc_id", "page_index"], "left")
    return met.select("doc_id", "page_index", F.when(F.col("error").isNotNull(), "error").when(F.col("_seen"), "ready").otherwise("pending").alias("status"))
