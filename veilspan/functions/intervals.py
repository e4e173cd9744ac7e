"""Sweeps over arrays of intervals, and the position buckets of interval joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, running

#: Characters of a position bucket: a page's positions are dealt to the cluster in stretches of this width.
BUCKET = 512


def _blocks(items: Column) -> Column:
    """The items in order, cut into about as many blocks as a block has items."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))), F.lit(1)).cast("int")
    return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), n), lambda at: F.slice(items, at + 1, n)))


def scan(items: Column, state: Column, kind: str, out: str, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column, Column], Column]) -> Column:
    """A fold that emits: ``emit(before, after, item)`` gives what every step adds to the result, an array of type ``out``.

    ``step(state, item)`` is the next state. Results are gathered block by block, so that
    what is copied grows with the power 1.5 of the items and not with their square.
    """
    inner = f"struct<s:{kind},out:{out}>"
    outer = f"struct<s:{kind},out:array<{out}>>"

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["s"], x), lambda after: F.struct(after.alias("s"), F.concat(acc["out"], emit(acc["s"], after, x)).alias("out")).cast(inner))

    def block(acc: Column, xs: Column) -> Column:
        return let(
            F.aggregate(xs, F.struct(acc["s"].alias("s"), F.array().cast(out).alias("out")).cast(inner), one),
            lambda done: F.struct(done["s"].alias("s"), F.concat(acc["out"], F.array(done["out"])).alias("out")).cast(outer),
        )

    begin = F.struct(state.cast(kind).alias("s"), F.array().cast(f"array<{out}>").alias("out")).cast(outer)
    return F.aggregate(_blocks(items), begin, block, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["out"]).alias("out")))


def sweep(items: Column, kind: str, admit: Callable[[Column, Column], Column], start: Callable[[Column], Column], stop: Callable[[Column], Column]) -> Column:
    """A greedy choice among items sorted by start, of which a step sees only the chosen ones that reach its item.

    ``admit(active, x)`` gives the active items after ``x``: those it leaves in place, with or without ``x``.
    An item that ends before the present start can meet nothing any more and leaves the active set as chosen, so a
    step costs as much as intervals overlap, not as many as there are. ``kind`` is the items' array type.
    """
    left = lambda active, x: F.filter(active, lambda y: stop(y) <= start(x))
    step = lambda active, x: admit(F.filter(active, lambda y: stop(y) > start(x)), x)
    swept = scan(items, F.array().cast(kind), kind, kind, step, lambda before, _, x: left(before, x))
    return let(swept, lambda end: F.concat(end["out"], end["s"]))


def runs(items: Column, start: Callable[[Column], Column], stop: Callable[[Column], Column]) -> Column:
    """Items sorted by start as an array of runs: no item of a run overlaps any of another."""

    def cut(ends: Column) -> Column:
        # where a run begins: nothing before reaches the item
        begins = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (F.get(ends, i - 1) <= start(x)), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(b, k + 1), F.size(items)) - at)))

    return let(running(F.transform(items, stop), lambda x, y: F.greatest(x, y)), cut)


def bucket_of(position: Column, width: int = BUCKET) -> Column:
    return F.floor(position / width).cast("long")


def in_buckets(rows: DataFrame, start: str = "char_start", stop: str = "char_end", width: int = BUCKET) -> DataFrame:
    """Every row once for each ``_bucket`` that its interval touches; an empty interval touches that of its start."""
    first = bucket_of(F.col(start), width)
    return rows.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(bucket_of(F.col(stop) - 1, width), first))))


def overlap_on(a: str, b: str, keys: tuple[str, ...], width: int = BUCKET) -> Column:
    """The condition of an interval join of two aliased tables ``in_buckets``, by char_start and char_end.

    Keys and position bucket are its equalities: a page of any size is spread over the
    cluster, and a row meets its neighbours alone. A pair that meets in several buckets
    counts in the one that holds the later of its two starts. Overlap is strict; an empty
    interval inside another overlaps it.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    on = (x("_bucket") == y("_bucket")) & (y("char_end") > x("char_start")) & (y("char_start") < x("char_end"))
    for k in keys:
        on = on & (x(k) == y(k))
    return on & (bucket_of(F.greatest(x("char_start"), y("char_start")), width) == x("_bucket"))
