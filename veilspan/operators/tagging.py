"""Tags, rewriting, summaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import bucket_of
from ..functions.text import entity_label, let
from ..schema import LABELS
from .spans import PAGE

UNKNOWN = "[LABEL_UNKNOWN]"


def tag(label: Column, number: Column, brackets: bool = True) -> Column:
    core = F.concat(label, F.lit("_"), number.cast("string"))
    return F.concat(F.lit("["), core, F.lit("]")) if brackets else core


def parse_tag(text: Column) -> tuple[Column, Column]:
    """Label and number of a tag, null where it is none; labels of older files are mapped."""
    shape = r"^\[([A-Z_]+)_([0-9]+)\]$"
    good = text.rlike(shape)
    return F.when(good, entity_label(F.regexp_extract(text, shape, 1))), F.when(good, F.regexp_extract(text, shape, 2).cast("long"))


def tag_map(spans: DataFrame, *, by_position: bool = True, brackets: bool = True) -> DataFrame:
    """One row per document and normalised text: tag, label, texts, count.

    The label is that of the first occurrence (by page and start, or in stored
    order), and each label numbers its texts by their first occurrences. Two
    aggregations on (doc_id, norm_text), then a ranking within the document.
    """
    key = F.struct("page_index", "char_start", "ord") if by_position else F.struct("ord")
    entries = spans.groupBy("doc_id", "norm_text").agg(F.min_by("label", key).alias("label"), F.min(key).alias("_first"), F.array_sort(F.collect_set("text")).alias("original_texts"), F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("_first"))
    return entries.withColumn("tag", tag(F.col("label"), number, brackets)).select("doc_id", "norm_text", "tag", "label", "original_texts", "n")


def tag_spans(spans: DataFrame) -> DataFrame:
    """Spans with their tags, as ``with_tags(spans, tag_map(spans))`` gives them, in one pass.

    Windows within a document in place of an aggregation and a join, so that
    the spans are computed once and, dealt by document, not exchanged again.
    """
    key, same = F.struct("page_index", "char_start", "ord"), Window.partitionBy("doc_id", "norm_text")
    first = spans.withColumns({"_first": F.min(key).over(same), "_label": F.min_by("label", key).over(same)})
    number = F.dense_rank().over(Window.partitionBy("doc_id", "_label").orderBy("_first"))
    return first.withColumn("tag", tag(F.col("_label"), number)).drop("_first", "_label")


def with_tags(spans: DataFrame, tags: DataFrame) -> DataFrame:
    return spans.join(tags.select("doc_id", "norm_text", "tag"), ["doc_id", "norm_text"], "left").withColumn("tag", F.coalesce("tag", F.lit(UNKNOWN)))


def rewrite(text: Column, items: Column) -> Column:
    """The text with each (char_start, char_end, tag) replaced, from the last start to the first.

    Where no two places overlap the text is cut once at the places' ends. Overlapping
    ones change a text that has changed already, so those pages go place by place.
    """
    ordered = F.array_sort(F.transform(items, lambda s: F.struct(s["char_start"].alias("a"), s["char_end"].alias("b"), s["tag"].alias("tag"))))
    before = lambda places, i: F.coalesce(F.get(places, i - 1)["b"], F.lit(0))

    def cut(places: Column) -> Column:
        pieces = F.transform(places, lambda s, i: F.concat(F.substring(text, before(places, i) + 1, s["a"] - before(places, i)), s["tag"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(places, -1)["b"] + 1, F.length(text)))

    def in_turn(places: Column) -> Column:
        return F.aggregate(F.reverse(places), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["a"]), s["tag"], F.substring(t, s["b"] + 1, F.length(t))))

    apart = lambda places: ~F.exists(F.transform(places, lambda s, i: s["a"] < before(places, i)), lambda x: x)
    return let(ordered, lambda places: F.when(F.size(places) == 0, text).when(apart(places), cut(places)).otherwise(in_turn(places)))


def anonymize(pages: DataFrame, tagged: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, anonymized_text, n_spans) for every page; places that repeat are replaced once."""
    items = tagged.groupBy(*PAGE).agg(F.collect_set(F.struct("char_start", "char_end", "tag")).alias("items"), F.count(F.lit(1)).alias("n"))
    met = pages.join(items, list(PAGE), "left")
    return met.select(*PAGE, "text", F.when(F.col("items").isNotNull(), rewrite(F.col("text"), F.col("items"))).otherwise(F.col("text")).alias("anonymized_text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"))


def entity_summary(tags: DataFrame) -> DataFrame:
    """Occurrences by label."""
    return tags.groupBy("doc_id", "label").agg(F.sum("n").alias("n"))


def unique_entities(tags: DataFrame) -> DataFrame:
    return tags.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


def tag_objects(tags: DataFrame) -> DataFrame:
    """A document's tags as a map from the normalised text."""
    return tags.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm_text", F.struct("tag", "label", "n").alias("v"))))).alias("tag_map"))


def reverse_tags(tags: DataFrame) -> DataFrame:
    """The original texts of each tag."""
    return tags.select("doc_id", "tag", F.explode("original_texts").alias("t")).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("t")).alias("originals"))


def annotate_tokens(tokens: DataFrame, tagged: DataFrame) -> DataFrame:
    """Tokens with the tag of the first span (by ``ord``) that wholly contains them."""
    s = tagged.select(*[F.col(c).alias(f"s_{c}") for c in (*PAGE, "ord", "char_start", "char_end", "label", "tag")], F.explode(F.sequence(bucket_of(F.col("char_start")), bucket_of(F.col("char_end")))).alias("s_bucket"))
    on = (F.col("doc_id") == F.col("s_doc_id")) & (F.col("page_index") == F.col("s_page_index")) & (bucket_of(F.col("char_start")) == F.col("s_bucket")) & (F.col("char_start") >= F.col("s_char_start")) & (F.col("char_end") <= F.col("s_char_end"))
    found = tokens.join(s, on).groupBy(*PAGE, "token_idx").agg(F.min_by(F.struct("s_label", "s_tag"), "s_ord").alias("s"))
    met = tokens.join(found, [*PAGE, "token_idx"], "left")
    return met.select(*PAGE, "token_idx", "text", F.coalesce("s.s_tag", "text").alias("anonymized_text"), F.col("s").isNotNull().alias("is_entity"), F.col("s.s_label").alias("entity_label"))


def export_documents(pages: DataFrame, tokens: DataFrame, tagged: DataFrame, tags: DataFrame, filename: Column) -> DataFrame:
    """One JSON document each: pages with texts, tokens and spans, the tag map and the summary."""
    annotated = annotate_tokens(tokens, tagged).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("token_idx", "text", "anonymized_text", "is_entity", "entity_label"))).alias("tokens"))
    listed = tagged.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "label", F.col("text").alias("original_text"), "tag", "char_start", "char_end"))).alias("spans"))
    rewritten = anonymize(pages, tagged).join(annotated, list(PAGE), "left").join(listed, list(PAGE), "left")
    page = F.struct("page_index", F.col("text").alias("original_text"), "anonymized_text", "tokens", "spans")
    docs = rewritten.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.count(F.lit(1)).alias("page_count"))
    summary = entity_summary(tags).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("entity_summary"))
    whole = docs.join(tag_objects(tags), "doc_id", "left").join(summary, "doc_id", "left").withColumn("filename", filename)
    return whole.select("doc_id", "page_count", F.to_json(F.struct("filename", "page_count", "pages", "tag_map", "entity_summary")).alias("json"))


def by_confidence(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    return spans.where(F.col("confidence") >= threshold)


def grouped_entities(spans: DataFrame) -> DataFrame:
    """Label groups in display order, each with its texts: first text, count, pages."""
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    first = F.struct("page_index", "char_start", "ord")
    groups = spans.groupBy("doc_id", "label", "norm_text").agg(F.min_by("text", first).alias("text"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("page_index")).alias("pages"))
    return groups.withColumn("label_ord", order.cast("int"))


def page_list(pages: Column) -> Column:
    """p1,2,3... of the first five pages, 1-based."""
    first = F.array_join(F.transform(F.slice(pages, 1, 5), lambda p: (p + 1).cast("string")), ",")
    return F.concat(F.lit("p"), first, F.when(F.size(pages) > 5, F.lit("...")).otherwise(F.lit("")))


def next_occurrence(spans: DataFrame) -> DataFrame:
    """The occurrence after each one of the same text, from the last to the first again."""
    w = Window.partitionBy("doc_id", "norm_text").orderBy("page_index", "char_start", "ord")
    return spans.withColumn("next_ord", F.coalesce(F.lead("ord").over(w), F.first("ord").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
