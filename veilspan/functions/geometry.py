"""Boxes as structs (x, y, width, height), origin bottom left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOX


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def top(b: Column) -> Column:
    return b["y"] + b["height"]


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def to_screen(b: Column, page_height: Column, scale: Column) -> Column:
    return box(b["x"] * scale, (page_height - b["y"] - b["height"]) * scale, b["width"] * scale, b["height"] * scale)


def to_pdf(b: Column, page_height: Column, scale: Column) -> Column:
    return box(b["x"] / scale, page_height - b["y"] / scale - b["height"] / scale, b["width"] / scale, b["height"] / scale)


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], right(b)) & y.between(b["y"], top(b))


def overlap(a: Column, b: Column) -> Column:
    return (a["x"] < right(b)) & (right(a) > b["x"]) & (a["y"] < top(b)) & (top(a) > b["y"])


def intersection(a: Column, b: Column) -> Column:
    """The common box; null where there is none."""
    x, y, x2, y2 = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(right(a), right(b)), F.least(top(a), top(b))
    return F.when((x2 > x) & (y2 > y), box(x, y, x2 - x, y2 - y))


def iou(a: Column, b: Column) -> Column:
    both = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    return both / (area(a) + area(b) - both)


def hull(boxes: Column) -> Column:
    """The box around an array of boxes; zeros for none."""
    least = lambda f: F.array_min(F.transform(boxes, f))
    most = lambda f: F.array_max(F.transform(boxes, f))
    x, y = least(lambda b: b["x"]), least(lambda b: b["y"])
    return F.when(F.size(boxes) > 0, box(x, y, most(right) - x, most(top) - y)).otherwise(box(*[F.lit(0.0)] * 4))


def lines(boxes: Column, threshold: float = 10.0) -> Column:
    """Boxes grouped to lines, top first, each left to right.

    From the top, a box joins the line at hand if its centre is near the line's
    mean centre or it reaches over it; else it starts a line.
    """
    ranked = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-center_y(b)).alias("k"), i.alias("i"), b.alias("b"))))
    state = f"struct<done:array<array<{BOX}>>,line:array<{BOX}>,total:double>"
    start = F.struct(F.array().cast(f"array<array<{BOX}>>").alias("done"), F.array().cast(f"array<{BOX}>").alias("line"), F.lit(0.0).alias("total")).cast(state)

    def step(s: Column, r: Column) -> Column:
        b, mean = r["b"], s["total"] / F.greatest(F.size(s["line"]), F.lit(1))
        joins = (F.size(s["line"]) > 0) & ((F.abs(center_y(b) - mean) <= threshold) | ((b["y"] < mean + threshold) & (top(b) > mean - threshold)))
        done = F.when(joins | (F.size(s["line"]) == 0), s["done"]).otherwise(F.concat(s["done"], F.array(s["line"])))
        line = F.when(joins, F.concat(s["line"], F.array(b))).otherwise(F.array(b))
        return F.struct(done.alias("done"), line.alias("line"), F.when(joins, s["total"] + center_y(b)).otherwise(center_y(b)).alias("total"))

    finish = lambda s: F.when(F.size(s["line"]) > 0, F.concat(s["done"], F.array(s["line"]))).otherwise(s["done"])
    return F.transform(F.aggregate(ranked, start, step, finish), lambda line: F.array_sort(line))


def line_boxes(boxes: Column, threshold: float = 5.0) -> Column:
    return F.transform(lines(boxes, threshold), hull)


def partial(token: Column, char_start: Column, char_end: Column, span_start: Column, span_end: Column) -> Column:
    """The part of a token's box that a span covers.

    Width per character, or from the height where the box is as wide as a line;
    a small margin on the right; never beyond the token.
    """
    n = char_end - char_start
    wide = token["width"] / F.greatest(n, F.lit(1))
    each = F.when(wide <= token["height"] * 1.2, wide).otherwise(token["height"] * 0.55)
    begin, stop = F.greatest(span_start, char_start) - char_start, F.least(span_end, char_end) - char_start
    x = F.greatest(token["x"], F.least(token["x"] + begin * each, right(token)))
    width = F.greatest(F.lit(0.0), F.least((stop - begin) * each + token["height"] * 0.15, right(token) - x))
    return F.when((n == 0) | ((span_start <= char_start) & (span_end >= char_end)), token).otherwise(box(x, token["y"], width, token["height"]))
