"""Sources: stored document JSON, positioned text items, words of recognised pages, binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.text import entity_label, strip

#: A line's items are at most this far apart; a file's largest size.
LINE_THRESHOLD = 5.0
MAX_BYTES = 50 * 1024 * 1024

STORED_PAGES = "array<struct<pageIndex:int,text:string>>"
STORED_ENTITIES = "array<struct<pageIndex:int,label:string,text:string,charStart:int,charEnd:int>>"


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of acceptable size: path, length, content; other files' contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select("path", "length", "content")


def accepted_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (mime, size) of the right kind and an acceptable size."""
    return uploads.where((F.col("mime") == "application/pdf") & (F.col("size") <= MAX_BYTES))


def transform_box(transform: Column, width: Column, height: Column) -> Column:
    """A text item's box from its matrix; items without a height take the vertical scale."""
    at = lambda k: F.get(transform, k)
    return box(at(4), at(5), width * F.abs(at(0)), F.when(height > 0, height).otherwise(F.abs(at(3))))


def reading_order(items: Column, page_height: Column) -> Column:
    """Items (str, x, y) by line from the top, then by x: an item joins the first line whose first item is near in height."""
    kind = "array<struct<line:double,x:double,i:int,str:string>>"

    def step(out: Column, item: Column) -> Column:
        y = page_height - item["y"]
        heads = F.array_distinct(F.transform(out, lambda o: o["line"]))
        near = F.filter(heads, lambda h: F.abs(y - h) < LINE_THRESHOLD)
        return F.concat(out, F.array(F.struct(F.coalesce(F.get(near, 0), y).alias("line"), item["x"].alias("x"), F.size(out).alias("i"), item["str"].alias("str"))))

    return F.array_sort(F.aggregate(items, F.array().cast(kind), step))


def page_text(items: Column) -> Column:
    """(text, places) of ordered items: one space between neighbours unless either brings one."""
    state = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,stop:int>>").alias("places"))

    def step(s: Column, item: Column) -> Column:
        gap = F.when((F.size(s["places"]) > 0) & ~F.endswith(s["text"], F.lit(" ")) & ~F.startswith(item["str"], F.lit(" ")), F.lit(" ")).otherwise(F.lit(""))
        start = F.length(s["text"]) + F.length(gap)
        return F.struct(F.concat(s["text"], gap, item["str"]).alias("text"), F.concat(s["places"], F.array(F.struct(start.alias("start"), (start + F.length(item["str"])).alias("stop")))).alias("places"))

    return F.aggregate(items, state, step)


def extract_pages(items: DataFrame) -> DataFrame:
    """Text items (doc_id, page_index, idx, str, x, y, page_height) as pages with text and places; blank items go."""
    grouped = items.where(F.length(strip(F.col("str"))) > 0).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "str"))).alias("items"), F.first("page_height").alias("h"))
    ordered = grouped.withColumn("ordered", reading_order(F.col("items"), F.col("h")))
    return ordered.withColumn("p", page_text(F.col("ordered"))).select("doc_id", "page_index", "p.text", "p.places")


def needs_recognition(text: Column, n_tokens: Column) -> Column:
    """Whether a page's text is too short, too garbled or too few words."""
    t = strip(text)
    printable = F.length(F.regexp_replace(t, r"[^\x20-\x7EÀ-ɏ\s]", ""))
    return (F.length(t) < 10) | (printable / F.greatest(F.length(t), F.lit(1)) < 0.7) | (n_tokens < 5)


def recognised_tokens(words: DataFrame, scale: float) -> DataFrame:
    """Recognised words (doc_id, page_index, idx, word, x0, y0, x1, y1 in pixels, page_height) as tokens in page units.

    Offsets run over the words joined by single spaces.
    """
    w = Window.partitionBy("doc_id", "page_index").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)).cast("int")
    height = (F.col("y1") - F.col("y0")) / scale
    bbox = box(F.col("x0") / scale, F.col("page_height") - F.col("y1") / scale, (F.col("x1") - F.col("x0")) / scale, height)
    return words.withColumn("char_start", start).select("doc_id", "page_index", F.concat(F.lit("ocr-"), F.col("page_index").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("id"), F.col("word").alias("text"), "char_start", (F.col("char_start") + F.length("word")).alias("char_end"), bbox.alias("bbox"))


def stored_pages(documents: DataFrame, *, in_range: bool = True, fill_blank: bool = False) -> DataFrame:
    """Pages of stored JSON (id, num_pages, pages_json): the first of each index, optionally only valid indexes or blanks for missing ones."""
    found = documents.select("id", "num_pages", F.posexplode(F.from_json("pages_json", STORED_PAGES)).alias("n", "p")).select("id", "num_pages", "n", F.col("p.pageIndex").alias("page_index"), F.col("p.text").alias("text"))
    if in_range:
        found = found.where("page_index >= 0 and page_index < num_pages")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("id", "page_index").orderBy("n"))).where("_r = 1").select("id", "page_index", "text")
    if fill_blank:
        every = documents.where("num_pages > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("num_pages") - 1)).alias("page_index"))
        first = every.join(first, ["id", "page_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return first


def stored_entities(documents: DataFrame) -> DataFrame:
    """Entities of stored JSON on valid pages, older labels mapped, numbered in stored order."""
    found = documents.select("id", "num_pages", F.posexplode(F.from_json("entities_json", STORED_ENTITIES)).alias("ord", "e")).where("e.pageIndex >= 0 and e.pageIndex < num_pages")
    return found.select("id", F.col("e.pageIndex").alias("page_index"), F.col("ord").cast("long").alias("ord"), entity_label(F.col("e.label")).alias("label"), F.col("e.text").alias("text"), F.col("e.charStart").alias("char_start"), F.col("e.charEnd").alias("char_end"))


def revived(state_json: Column) -> Column:
    """A state's JSON list of key-value pairs as a map."""
    return F.map_from_entries(F.from_json(state_json, "array<struct<key:string,value:string>>"))
