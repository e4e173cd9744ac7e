"""Edits of spans: single operations and replayed edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import scan
from ..functions.text import normalize
from .spans import PAGE


def created(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """User spans of confidence 1 for (doc_id, page_index, label, char_start, char_end) requests."""
    text = F.substring(F.col("page_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    met = requests.join(pages.select(*PAGE, F.col("text").alias("page_text")), list(PAGE))
    return met.select(*PAGE, "label", text.alias("text"), normalize(text).alias("norm_text"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), "char_start", "char_end")


def replay(spans: DataFrame, edits: DataFrame, upto: int | None = None) -> DataFrame:
    """Spans after an edit log (doc_id, seq, type, ord, label, char_start, char_end, text), optionally up to a version.

    Edits of a span meet it once, reduced to the last label, the last bounds
    and whether it was removed; the log isn't replayed row by row. ADD brings a
    span with the edit's fields. EXTEND sets bounds and text and leaves the
    normalised text as it was.
    """
    log = edits if upto is None else edits.where(F.col("seq") <= upto)
    last = lambda kind, f: F.max_by(F.when(F.col("type") == kind, F.col(f)), F.when(F.col("type") == kind, F.col("seq")))
    per_span = log.where("type <> 'ADD'").groupBy("doc_id", "ord").agg(
        F.max((F.col("type") == "REMOVE").cast("int")).alias("_removed"), last("CHANGE_LABEL", "label").alias("_label"),
        last("EXTEND", "char_start").alias("_start"), last("EXTEND", "char_end").alias("_end"), last("EXTEND", "text").alias("_text"),
    )
    added = log.where("type = 'ADD'").select("doc_id", F.lit(0).alias("page_index"), "ord", "label", "text", normalize(F.col("text")).alias("norm_text"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), "char_start", "char_end")
    every = spans.select(*added.columns).unionByName(added)
    met = every.join(per_span, ["doc_id", "ord"], "left").where("coalesce(_removed, 0) = 0")
    new = {"label": F.coalesce("_label", "label"), "char_start": F.coalesce("_start", "char_start"), "char_end": F.coalesce("_end", "char_end"), "text": F.coalesce("_text", "text")}
    return met.withColumns(new).select(*added.columns)


#: So many earlier states can be gone back to.
MOST_STATES = 50


def history(log: DataFrame, most: int = MOST_STATES) -> DataFrame:
    """What every step of an edit log (doc_id, seq, kind) leads to: the log with ``depth`` and ``state``.

    ``kind`` is edit, undo or redo. ``state`` is the seq of the edit that made the state after the step (null: the
    document as it was), ``depth`` how many edits lie before it. An edit forgets what was undone; an undo goes back one
    state of at most ``most`` that are remembered, else changes nothing; a redo goes forward again while nothing
    was edited. Other kinds change nothing.

    A scan of each document's log keeps two counters and the depth; the state of a depth is then the last edit that reached it.
    """
    kind = "struct<past:int,future:int,depth:int>"

    def step(s: Column, x: Column) -> Column:
        to = lambda past, future, depth: F.struct(past.cast("int").alias("past"), future.cast("int").alias("future"), depth.cast("int").alias("depth"))
        back, forward = (x["kind"] == "undo") & (s["past"] > 0), (x["kind"] == "redo") & (s["future"] > 0)
        return F.when(x["kind"] == "edit", to(F.least(s["past"] + 1, F.lit(most)), F.lit(0), s["depth"] + 1)).when(back, to(s["past"] - 1, s["future"] + 1, s["depth"] - 1)).when(forward, to(s["past"] + 1, s["future"] - 1, s["depth"] + 1)).otherwise(s)

    steps = log.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("items"))
    emit = lambda _, after, x: F.array(F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"), after["depth"].alias("depth")))
    begin = F.struct(F.lit(0).alias("past"), F.lit(0).alias("future"), F.lit(0).alias("depth"))
    out = f"array<struct<seq:{log.schema['seq'].dataType.simpleString()},kind:string,depth:int>>"
    scanned = steps.select("doc_id", F.inline(scan(F.col("items"), begin, kind, out, step, emit)["out"]))
    last = F.last(F.when(F.col("kind") == "edit", F.col("seq")), ignorenulls=True).over(Window.partitionBy("doc_id", "depth").orderBy("seq"))
    return scanned.withColumn("state", F.when(F.col("depth") > 0, last))


def live_edits(log: DataFrame, most: int = MOST_STATES) -> DataFrame:
    """(doc_id, seq) of the edits that make up each document's last state: undone ones and their branches are left out."""
    steps = history(log, most)
    ends = steps.groupBy("doc_id").agg(F.max_by("depth", "seq").alias("end"))
    at_depth = steps.where("depth > 0").groupBy("doc_id", "depth").agg(F.max_by("state", "seq").alias("seq"))
    return at_depth.join(ends, "doc_id").where("depth <= end").select("doc_id", "seq")


def remove_by_text(spans: DataFrame, norm_text: str) -> tuple[DataFrame, DataFrame]:
    """Spans without a text, and how many went."""
    hit = F.col("norm_text") == norm_text
    return spans.where(~hit), spans.agg(F.sum(hit.cast("long")).alias("removed"))


def set_label(spans: DataFrame, where: Column, label: str) -> DataFrame:
    return spans.withColumn("label", F.when(where, F.lit(label)).otherwise(F.col("label")))


def set_bounds(spans: DataFrame, bounds: DataFrame, pages: DataFrame) -> DataFrame:
    """New bounds (doc_id, ord, lo, hi): text and normalised text are read anew, the source is the user."""
    met = spans.join(bounds, ["doc_id", "ord"], "left").join(pages.select(*PAGE, F.col("text").alias("page_text")), list(PAGE))
    text = F.substring(F.col("page_text"), F.col("lo") + 1, F.col("hi") - F.col("lo"))
    moved = F.col("lo").isNotNull()
    pick = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    return met.select(*PAGE, "ord", "label", pick(text, "text"), pick(normalize(text), "norm_text"), "confidence", pick(F.lit("user"), "source"), pick(F.col("lo"), "char_start"), pick(F.col("hi"), "char_end"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Rows by key, the highest version of both tables."""
    both = current.unionByName(changes)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(version.desc()))).where("_n = 1").drop("_n")
