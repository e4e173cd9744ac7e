"""Table functions for SQL: the chunker, and detectors of one's own, as functions over a table of pages.

    register(spark)
    spark.sql("select * from chunks(table(pages))")
    register_detector(spark, "find_codes", lambda text: [("IDENTIFIER", 0.9, m.start(), m.end()) for m in re.finditer("[A-Z]{3}-[0-9]+", text)])
    spark.sql("select * from find_codes(table(pages)) where confidence > 0.5")

A table of pages has doc_id, page_index and text, and may have more columns; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .isolation import Found
from .ner import CHUNK, OVERLAP, chunk_bounds

_PAGE = [StructField("doc_id", LongType()), StructField("page_index", IntegerType())]
CHUNKS = StructType([*_PAGE, StructField("chunk", IntegerType()), StructField("start", IntegerType()), StructField("text", StringType())])
SPANS = StructType([*_PAGE, StructField("ord", LongType()), StructField("label", StringType()), StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType())])


def _checked(pages: AnalyzeArgument, schema: StructType) -> AnalyzeResult:
    """The result's columns, if the argument is a table of pages."""
    if not pages.isTable:
        raise ValueError("the argument is a table: TABLE(pages)")
    missing = [c for c in ("doc_id", "page_index", "text") if c not in pages.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return AnalyzeResult(schema)


class Chunks:
    """(doc_id, page_index, chunk, start, text): a page's text in chunks; size and overlap can follow the table."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _checked(pages, CHUNKS)

    def eval(self, pages: Row, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple]:
        text = pages["text"] or ""
        for k, (a, b) in enumerate(chunk_bounds(text, size, overlap)):
            yield pages["doc_id"], pages["page_index"], k, a, text[a:b]


def detector_function(find: Callable[[str], Iterable[Found]]) -> type:
    """The table function of a detector, which gives (label, confidence, start, end) for a text."""

    class Detector:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            return _checked(pages, SPANS)

        def eval(self, pages: Row) -> Iterator[tuple]:
            text = pages["text"] or ""
            for k, (label, confidence, a, b) in enumerate(find(text)):
                yield pages["doc_id"], pages["page_index"], k, label, text[a:b], confidence, a, b

    return Detector


def register(spark: SparkSession) -> None:
    """``chunks`` for this session's SQL."""
    spark.udtf.register("chunks", F.udtf(Chunks))


def register_detector(spark: SparkSession, name: str, find: Callable[[str], Iterable[Found]]) -> None:
    """A detector for this session's SQL; a name that is taken is taken over."""
    spark.udtf.register(name, F.udtf(detector_function(find)))
