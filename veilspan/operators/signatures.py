"""Signature rules: annotations of a page, and the block under an electronic signature's heading."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.text import normalize, rounded
from .spans import PAGE

#: Lines between a heading and its id, in median token heights; tolerance of a line in the same.
ID_GAP, LINE_TOLERANCE = 10.0, 0.6
CONFIDENCE = 0.85


def token_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_signature(a: Column) -> Column:
    """A signature widget, a widget named so, or contents that speak of one."""
    low = lambda f: F.lower(F.coalesce(a[f], F.lit("")))
    widget = low("subtype") == "widget"
    return (widget & (low("field_type") == "sig")) | (widget & low("field_name").rlike("sign")) | low("contents").rlike("docusign|signature")


def rectangle(rect: Column) -> Column:
    """Any two corners as a box."""
    x1, y1, x2, y2 = (F.get(rect, k) for k in range(4))
    return box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def annotation_regions(annotations: DataFrame) -> DataFrame:
    """Redaction regions of signature annotations with a positive area."""
    found = annotations.where(F.col("rect").isNotNull() & is_signature(F.struct("subtype", "field_type", "field_name", "contents"))).withColumn("bbox", rectangle(F.col("rect")))
    sized = found.where("bbox.width > 0 and bbox.height > 0")
    name = F.concat_ws("-", F.lit("region"), "page_index", "idx", *[rounded(F.col(f"bbox.{c}")).cast("string") for c in ("x", "y", "width", "height")])
    return sized.select(*PAGE, name.alias("id"), "bbox", F.lit("IDENTIFIER").alias("label"), F.lit("pdf-annotation").alias("source"), F.lit("signature").alias("kind"))


def median_heights(tokens: DataFrame) -> DataFrame:
    return tokens.where("bbox.height > 0").groupBy(*PAGE).agg(F.median("bbox.height").alias("median_height"))


def group_into_lines(boxes: list[tuple[float, float, float]], tolerance: float) -> list[int]:
    """Each (x, y, height) box's line, lines numbered from the top.

    Boxes by centre from the top, then x; each joins the first line whose mean
    centre is within the tolerance. On equal centres lines keep their order.
    """
    center = [y + h / 2 for _, y, h in boxes]
    lines: list[list] = []
    home = [0] * len(boxes)
    for k in sorted(range(len(boxes)), key=lambda k: (-center[k], boxes[k][0])):
        for line in lines:
            if abs(line[0] - center[k]) <= tolerance:
                line[0] = (line[0] * line[1] + center[k]) / (line[1] + 1)
                line[1] += 1
                home[k] = line[2]
                break
        else:
            home[k] = len(lines)
            lines.append([center[k], 1, len(lines)])
    rank = {line[2]: n for n, line in enumerate(sorted(lines, key=lambda v: -v[0]))}
    return [rank[h] for h in home]


def _lines(boxes: pa.Array, median_height: pa.Array) -> pa.Array:
    flat = boxes.flatten()
    each = list(zip(*[flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("x", "y", "height")], strict=True))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(boxes).to_numpy(zero_copy_only=False))]).tolist()
    found = [group_into_lines(each[i:j], max(2.0, h * LINE_TOLERANCE)) for i, j, h in zip(ends[:-1], ends[1:], median_height.to_pylist(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for page in found for k in page], pa.int32()))


def lined(tokens: DataFrame) -> DataFrame:
    """Tokens with their ``line`` and their page's ``median_height``; a page without any height has no lines.

    The running means go from token to token, so a page's tokens are one array; a batch of pages is lined at a time.
    """
    held = [c for c in tokens.columns if c not in PAGE]
    item = F.struct("token_idx", *[c for c in held if c != "token_idx"])
    height = F.col("bbox.height")
    pages = tokens.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("items"), F.median(F.when(height > 0, height)).alias("median_height")).where("median_height is not null")
    line = F.arrow_udf("array<int>")(_lines)(F.col("items.bbox"), F.col("median_height"))
    each = pages.select(*PAGE, "median_height", F.explode(F.arrays_zip(F.col("items").alias("t"), line.alias("line"))).alias("m"))
    return each.select(*PAGE, *[F.col(f"m.t.{c}").alias(c) for c in held], F.col("m.line").alias("line"), "median_height")


def token_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_index, token_idx, line)."""
    return lined(tokens.select(*PAGE, "token_idx", "bbox")).select(*PAGE, F.col("token_idx").cast("int").alias("token_idx"), "line")


def looks_like_id(text: Column) -> Column:
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return (F.length(plain) >= 8) & plain.rlike("[0-9]")


def _near(lined: DataFrame) -> DataFrame:
    """Adds ``near``: the token is "docusigned" and, at most three tokens further right on its line, there is "by"."""
    w = Window.partitionBy(*PAGE, "line").orderBy(F.col("bbox.x"), "token_idx")
    near = F.col("key").isin("docusigned") & ((F.lead("key", 1).over(w) == "by") | (F.lead("key", 2).over(w) == "by") | (F.lead("key", 3).over(w) == "by"))
    return lined.withColumn("key", token_key(F.col("text"))).withColumn("near", F.coalesce(near, F.lit(False))).drop("key")


def heading_lines(lined: DataFrame) -> DataFrame:
    """Lines that hold "docusigned" and, at most three tokens further right, "by"."""
    return _near(lined).where("near").select(*PAGE, "line").distinct()


def _banded(lined: DataFrame, *held: str) -> DataFrame:
    """(doc_id, page_index, head, band_top, id_line, band_bottom, lines): ``id_lines`` and all lines of the page, with these columns of their tokens.

    A page's lines are one array, so headings meet the lines below them without a join.
    """
    center = F.col("bbox.y") + F.col("bbox.height") / 2
    facts = [F.avg(center).alias("center"), F.min("bbox.y").alias("low"), F.max(looks_like_id(F.col("text"))).alias("has_id"), F.max("near").alias("near")]
    tokens = [F.collect_list(F.struct(*held)).alias("tokens")] if held else []
    by_line = _near(lined).groupBy(*PAGE, "median_height", "line").agg(*facts, *tokens)
    pages = by_line.groupBy(*PAGE, "median_height").agg(F.collect_list(F.struct("line", "center", "low", "has_id", "near", *(["tokens"] if held else []))).alias("lines"))
    heads = pages.select(*PAGE, "median_height", "lines", F.explode(F.filter("lines", lambda x: x["near"])).alias("h"))
    dy = lambda x: F.col("h.center") - x["center"]
    below = F.filter("lines", lambda x: x["has_id"] & (dy(x) > 0) & (dy(x) <= ID_GAP * F.col("median_height")))
    met = heads.withColumn("id", F.array_min(F.transform(below, lambda x: F.struct(x["line"].alias("line"), x["low"].alias("low"))))).where("id is not null")
    return met.select(*PAGE, F.col("h.line").alias("head"), F.col("h.low").alias("band_top"), F.col("id.line").alias("id_line"), F.col("id.low").alias("band_bottom"), "lines")


def id_lines(lined: DataFrame) -> DataFrame:
    """For each heading line, the nearest line below it that holds an id, within the gap."""
    return _banded(lined).drop("lines")


def _bands(lined: DataFrame, *held: str) -> DataFrame:
    """Each heading with the tokens between it and its id line as one array, without the heading's own."""
    inside = lambda t: (t["bbox"]["y"] + t["bbox"]["height"] >= F.col("band_bottom")) & (t["bbox"]["y"] <= F.col("band_top"))
    kept = F.flatten(F.transform(F.filter("lines", lambda x: x["line"] != F.col("head")), lambda x: F.filter(x["tokens"], inside)))
    return _banded(lined, *held).withColumn("band", kept).where(F.size("band") > 0)


def band_tokens(lined: DataFrame) -> DataFrame:
    """The tokens between a heading and its id line, without the heading's own: their columns, and those of ``id_lines``."""
    held = [c for c in lined.columns if c not in (*PAGE, "median_height")]
    return _bands(lined, *held).select(*PAGE, "head", "band_top", "id_line", "band_bottom", F.inline("band"))


def detect_signatures(tokens: DataFrame) -> DataFrame:
    """One span for the block under each heading: first start, the last token's end, texts joined by spaces."""
    bands = _bands(lined(tokens), "char_start", "token_idx", "char_end", "text", "bbox").select(*PAGE, F.array_sort(F.transform("band", lambda t: F.struct(*[t[c].alias(c) for c in ("char_start", "token_idx", "char_end", "text")]))).alias("band"))
    text = F.array_join(F.col("band.text"), " ")
    spans = bands.select(*PAGE, F.array_min("band.char_start").alias("char_start"), F.element_at("band", -1)["char_end"].alias("char_end"), text.alias("text"))
    return spans.select(*PAGE, F.lit("IDENTIFIER").alias("label"), "text", normalize(F.col("text")).alias("norm_text"), F.lit(CONFIDENCE).alias("confidence"), F.lit("regex").alias("source"), "char_start", "char_end")
