"""Span algebra: scores, overlap, deduplication, greedy resolution, interval joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import bucket_of, in_buckets, overlap_on, sweep
from ..functions.text import normalize
from .scanning import processed, word_numbers

PAGE = ("doc_id", "page_index")
#: Overlap of the shorter span beyond which two spans conflict.
CONFLICT = 0.5
#: A page's spans as one array.
SPANS_TYPE = "array<struct<ord:bigint,label:string,text:string,norm_text:string,confidence:double,source:string,char_start:int,char_end:int>>"


def overlaps(a: Column, b: Column) -> Column:
    """Strict overlap of two structs with char_start and char_end."""
    return (a["char_end"] > b["char_start"]) & (a["char_start"] < b["char_end"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common characters over the shorter length."""
    common = F.greatest(F.least(a["char_end"], b["char_end"]) - F.greatest(a["char_start"], b["char_start"]), F.lit(0))
    return common / F.greatest(F.least(a["char_end"] - a["char_start"], b["char_end"] - b["char_start"]), F.lit(1))


def score(s: Column) -> Column:
    """Confidence, then model over pattern, users over all, then length."""
    return s["confidence"] * 100 + F.when(s["source"] == "ner", 10.0).when(s["source"] == "user", 1000.0).otherwise(0.0) + (s["char_end"] - s["char_start"]) * 0.1


def deduplicate(spans: DataFrame) -> DataFrame:
    """The first span (by ``ord``) of each place and label."""
    first = Window.partitionBy(*PAGE, "char_start", "char_end", "label").orderBy("ord")
    return spans.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def resolved_items(items: Column, kind: str) -> Column:
    """Greedy resolution of a page's (k1 = start, k2 = less score, k3 = ord, s = span) items, sorted.

    An item that conflicts with a kept one of at least its score is dropped, else it takes
    the place of all that it conflicts with. Kept spans that end before an item
    starts are not looked at again.
    """

    def conflict(y: Column, x: Column) -> Column:
        return overlaps(y["s"], x["s"]) & (overlap_ratio(y["s"], x["s"]) > CONFLICT)

    def admit(active: Column, x: Column) -> Column:
        beaten = F.exists(active, lambda y: conflict(y, x) & (y["k2"] <= x["k2"]))
        return F.when(beaten, active).otherwise(F.concat(F.filter(active, lambda y: ~conflict(y, x)), F.array(x)))

    return F.when(F.size(items) > 1, sweep(items, kind, admit, lambda x: x["k1"], lambda x: x["s"]["char_end"])).otherwise(items)


def sort_item(span: Column) -> Column:
    """A span struct as an item of ``resolved_items``: by start, then score, then order."""
    return F.struct(span["char_start"].alias("k1"), (-score(span)).alias("k2"), span["ord"].alias("k3"), span.alias("s"))


def resolve(spans: DataFrame) -> DataFrame:
    """Greedy resolution of conflicts page by page: spans come by start, then score (``resolved_items``).

    One array per page is swept; a step looks only at the spans that reach its place.
    """
    fields = [c for c in spans.columns if c not in PAGE]
    paged = spans.groupBy(*PAGE).agg(F.array_sort(F.collect_list(sort_item(F.struct(*fields)))).alias("items"))
    kept = resolved_items(F.col("items"), paged.schema["items"].dataType.simpleString())
    return paged.select(*PAGE, F.explode(kept).alias("i")).select(*PAGE, *[F.col(f"i.s.{c}").alias(c) for c in fields]).select(*spans.columns)


def process(spans: DataFrame) -> DataFrame:
    return resolve(deduplicate(spans))


def page_processed(spans: Column, unique: bool = True, resolved: bool = True) -> Column:
    """``deduplicate`` and ``resolve`` of pages that have their spans as one array: nothing is shuffled, and no filter inferred later runs it a second time."""
    return F.arrow_udf(processed(unique, resolved), SPANS_TYPE).asNondeterministic()(spans)


def page_combined(spans: Column, model: Callable[[Column], Column]) -> Column:
    """``combine`` of one page's spans, of which those that ``model`` tells are the model's: all in one array."""
    first = lambda s: F.struct(F.when(model(s), 0).otherwise(1).alias("k1"), s["ord"].alias("k2"), s["char_start"].alias("k3"), s["char_end"].alias("k4"), s["label"].alias("k5"), s.alias("s"))
    return page_processed(F.transform(F.array_sort(F.transform(spans, first)), lambda x, i: x["s"].withField("ord", i.cast("long"))))


def page_words(text: Column, spans: Column) -> Column:
    """For each of a page's spans the numbers of its words, as ``attach_tokens`` gives them for the page's words."""
    return F.arrow_udf("array<array<int>>")(word_numbers)(text, spans)


def combine(model: DataFrame, patterns: DataFrame) -> DataFrame:
    """Two detectors' spans as one resolved set; model spans count as the earlier ones."""
    both = model.withColumn("_set", F.lit(0)).unionByName(patterns.withColumn("_set", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("_set", "page_index", "ord", "char_start", "char_end", "label")
    return process(both.withColumn("ord", F.row_number().over(order).cast("long") - 1).drop("_set"))


def tokens_in_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Interval join: every token (``t``) that a span (``s``) touches, by page and position bucket."""
    return in_buckets(spans).alias("s").join(in_buckets(tokens).alias("t"), overlap_on("s", "t", PAGE))


def attach_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans with the indexes of their tokens, in order."""
    met = tokens_in_spans(spans, tokens).select("s.doc_id", "s.page_index", "s.ord", "t.token_idx")
    found = met.groupBy(*PAGE, "ord").agg(F.array_sort(F.collect_list("token_idx")).alias("token_ids"))
    return spans.join(found, [*PAGE, "ord"], "left").withColumn("token_ids", F.coalesce("token_ids", F.array().cast("array<int>")))


def span_boxes(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """The box around each span's tokens; spans without tokens are left out."""
    met = tokens_in_spans(spans, tokens)
    x, y = F.min("t.bbox.x"), F.min("t.bbox.y")
    return met.groupBy("s.doc_id", "s.page_index", "s.ord").agg(x.alias("x"), y.alias("y"), (F.max(F.col("t.bbox.x") + F.col("t.bbox.width")) - x).alias("width"), (F.max(F.col("t.bbox.y") + F.col("t.bbox.height")) - y).alias("height"))


def covered(positions: DataFrame, spans: DataFrame, how: str = "left_semi") -> DataFrame:
    """Positions that some span of the page overlaps (``left_anti``: that none does), repeated ones as often as they come.

    A position is looked up in each position bucket that it touches, and its findings are put together again.
    """
    columns = positions.columns
    p = in_buckets(positions.withColumn("_id", F.monotonically_increasing_id())).alias("p")
    s = in_buckets(spans.select(*PAGE, "char_start", "char_end")).withColumn("_hit", F.lit(True)).alias("s")
    met = p.join(s, overlap_on("p", "s", PAGE), "left").groupBy("p._id", *[F.col(f"p.{c}") for c in columns]).agg(F.count("_hit").alias("_hits"))
    return met.where(F.col("_hits") > 0 if how == "left_semi" else F.col("_hits") == 0).select(*columns)


def at_offsets(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """For (doc_id, page_index, offset) the first span (by ``ord``) that holds the offset."""
    s = in_buckets(spans.select(*PAGE, "ord", "label", "char_start", "char_end"))
    met = offsets.withColumn("_bucket", bucket_of(F.col("offset"))).join(s, [*PAGE, "_bucket"]).where((F.col("char_start") <= F.col("offset")) & (F.col("offset") < F.col("char_end")))
    return met.groupBy(*PAGE, "offset").agg(F.min_by(F.struct("ord", "label"), "ord").alias("s")).select(*PAGE, "offset", "s.ord", "s.label")


def overlapping(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of a probe (doc_id, page_index, probe_id, char_start, char_end) and a span that overlaps it."""
    met = in_buckets(probes).alias("p").join(in_buckets(spans.select(*PAGE, "ord", "char_start", "char_end")).alias("s"), overlap_on("p", "s", PAGE))
    return met.select(*[F.col(f"p.{c}") for c in probes.columns], F.col("s.ord").alias("span_ord"), F.col("s.char_start").alias("s_start"), F.col("s.char_end").alias("s_end"))


def has_overlap(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether some span other than the one with the probe's id overlaps it."""
    met = overlapping(probes, spans).where(F.col("span_ord") != F.col("probe_id")).select(*PAGE, "probe_id").distinct().withColumn("hit", F.lit(True))
    return probes.join(met, [*PAGE, "probe_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def grow_over_existing(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Probes grown to the hull of what they overlap, with the spans to remove."""
    met = overlapping(probes, spans)
    grown = met.groupBy(*PAGE, "probe_id", "char_start", "char_end").agg(F.min("s_start").alias("lo"), F.max("s_end").alias("hi"), F.array_sort(F.collect_list("span_ord")).alias("removed"))
    out = probes.join(grown, [*PAGE, "probe_id", "char_start", "char_end"], "left")
    return out.select(*PAGE, "probe_id", F.least("char_start", F.coalesce("lo", "char_start")).alias("char_start"), F.greatest("char_end", F.coalesce("hi", "char_end")).alias("char_end"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def split_at(spans: DataFrame, cut_start: Column, cut_end: Column, page_text: Column) -> DataFrame:
    """What remains of each span outside the cut: none, one or two user spans of confidence 1."""
    left = F.struct(F.col("char_start").alias("a"), F.least("char_end", cut_start).alias("b"))
    right = F.struct(F.greatest("char_start", cut_end).alias("a"), F.col("char_end").alias("b"))
    rest = F.filter(F.array(left, right), lambda p: p["b"] > p["a"])
    parts = spans.select(*PAGE, "ord", "label", page_text.alias("_page"), F.posexplode(rest).alias("part", "p"))
    text = F.substring(F.col("_page"), F.col("p.a") + 1, F.col("p.b") - F.col("p.a"))
    return parts.select(*PAGE, "ord", "label", "part", text.alias("text"), normalize(text).alias("norm_text"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), F.col("p.a").alias("char_start"), F.col("p.b").alias("char_end"))


def absorb_contained(bounds: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans without those that lie wholly inside new bounds of another span (doc_id, page_index, owner, lo, hi)."""
    b, s = bounds.withColumn("_bucket", F.explode(F.sequence(bucket_of(F.col("lo")), F.greatest(bucket_of(F.col("hi")), bucket_of(F.col("lo")))))).alias("b"), spans.withColumn("_bucket", bucket_of(F.col("char_start"))).alias("s")
    inside = (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.page_index") == F.col("b.page_index")) & (F.col("s._bucket") == F.col("b._bucket")) & (F.col("s.ord") != F.col("b.owner")) & (F.col("s.char_start") >= F.col("b.lo")) & (F.col("s.char_end") <= F.col("b.hi"))
    return s.join(b, inside, "left_anti").drop("_bucket")


def from_selection(tokens: DataFrame, selected: Column) -> DataFrame:
    """One span for each page's selected tokens: first start, last end, texts joined by spaces."""
    chosen = tokens.where(selected)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "text"))), lambda t: t["text"]), " ")
    return chosen.groupBy(*PAGE).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), joined.alias("text"))


def extend_to_token(span_start: Column, span_end: Column, token_start: Column, token_end: Column) -> tuple[Column, Column]:
    """A token wholly left or right of a span extends it to the hull; one that overlaps it changes nothing."""
    apart = (token_end <= span_start) | (token_start >= span_end)
    return F.when(apart, F.least(span_start, token_start)).otherwise(span_start), F.when(apart, F.greatest(span_end, token_end)).otherwise(span_end)


def new_places(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose exact place no existing span has."""
    return candidates.join(existing.select(*PAGE, "char_start", "char_end"), [*PAGE, "char_start", "char_end"], "left_anti")
