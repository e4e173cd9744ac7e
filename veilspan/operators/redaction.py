"""Redaction plans: which rectangles cover a page, with their tags, before anything is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, center_y, line_boxes, overlap, right, to_pdf
from ..functions.text import sanitized
from .spans import PAGE, tokens_in_spans

# Tag font size and padding.
FONT_SIZE, PADDING_X, PADDING_Y = 7.0, 2.0, 2.0
#: Mean width of a character in font sizes; a renderer with the font's metrics passes its own.
CHARACTER_WIDTH = 0.6


def drawings(tagged: DataFrame, tokens: DataFrame, character_width: float = CHARACTER_WIDTH) -> DataFrame:
    """Per span: its padded line boxes, the first line's own width, and the first box widened to hold the tag."""
    boxes = tokens_in_spans(tagged, tokens).groupBy("s.doc_id", "s.page_index", "s.ord", "s.tag").agg(line_boxes(F.array_sort(F.collect_list("t.bbox"))).alias("lines"))
    padded = boxes.withColumn("lines", F.transform("lines", lambda b: box(b["x"], b["y"] - PADDING_Y, b["width"], b["height"] + 2 * PADDING_Y)))
    first = F.get("lines", 0)
    needed = F.length(sanitized(F.col("tag"))) * (FONT_SIZE * character_width) + 2 * PADDING_X
    return padded.withColumn("own_width", first["width"]).withColumn("first", box(first["x"], first["y"], F.greatest(first["width"], needed), first["height"]))


def free_tokens(tagged: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that no span touches."""
    touched = tokens_in_spans(tagged, tokens).select("t.doc_id", "t.page_index", "t.token_idx").distinct()
    return tokens.join(touched, [*PAGE, "token_idx"], "left_anti")


def _same_line(a: Column, b: Column) -> Column:
    return F.abs(center_y(b) - center_y(a)) <= a["height"] / 2


def without_collisions(drawn: DataFrame, free: DataFrame) -> DataFrame:
    """Widened first boxes cut before the next free token or drawing on their right, never under their own width.

    A box only looks at boxes to its right, which are still uncut then, so the
    cuts don't depend on one another.
    """
    wide = drawn.where("first.width > own_width").select(*PAGE, "ord", F.col("first").alias("a"), "own_width")
    others = drawn.select(*PAGE, F.col("ord").alias("o"), F.col("first").alias("b")).unionByName(free.select(*PAGE, F.lit(None).cast("long").alias("o"), F.col("bbox").alias("b")))
    a, b = F.col("a"), F.col("b")
    later = F.col("o").isNull() | (b["x"] > a["x"]) | ((b["x"] == a["x"]) & (F.col("o") > F.col("ord")))
    hits = wide.join(others, list(PAGE)).where(later & (F.col("o").isNull() | (F.col("o") != F.col("ord"))) & (b["x"] >= a["x"] + F.col("own_width")) & _same_line(a, b) & overlap(a, b))
    limit = hits.groupBy(*PAGE, "ord").agg(F.min("b.x").alias("barrier"))
    first = F.col("first")
    cut = F.greatest(F.col("own_width"), F.least(right(first), F.col("barrier") - 1) - first["x"])
    met = drawn.join(limit, [*PAGE, "ord"], "left")
    return met.withColumn("first", F.when(F.col("barrier").isNotNull(), box(first["x"], first["y"], cut, first["height"])).otherwise(first)).drop("barrier")


def rectangles(drawn: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Every rectangle to draw: (doc_id, page_index, ord, part, bbox, tag)."""
    all_lines = F.concat(F.array("first"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))))
    out = drawn.select(*PAGE, "ord", "tag", F.posexplode(all_lines).alias("part", "bbox")).withColumn("tag", F.when(F.col("part") == 0, sanitized(F.col("tag"))))
    if regions is not None:
        out = out.unionByName(regions.select(*PAGE, F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("tag"), F.lit(0).alias("part"), "bbox"))
    return out.select(*PAGE, "ord", "part", "bbox", "tag")


def text_layer(free: DataFrame) -> DataFrame:
    """Free tokens for the invisible text layer with their font sizes (1 to 20)."""
    return free.withColumn("text", sanitized(F.col("text"))).where(F.length(F.trim("text")) > 0).select(*PAGE, "token_idx", "text", F.greatest(F.lit(1.0), F.least(F.col("bbox.height") * 0.8, F.lit(20.0))).alias("font_size"))


def drawn_region(x1: Column, y1: Column, x2: Column, y2: Column, page_height: Column, scale: Column, least: float) -> Column:
    """A box drawn on screen as a region of the page; null if a side is too short."""
    screen = box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))
    return F.when((screen["width"] >= least) & (screen["height"] >= least), to_pdf(screen, page_height, scale))
