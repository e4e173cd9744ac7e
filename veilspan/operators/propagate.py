"""Propagation: fuzzy grouping of found texts, and search for them on a document's other pages.

Everything happens within a document, so a document is the unit of grouping. A page's row takes its document's
clusters and its own spans as arrays; clusters, places and the choice among them are Arrow functions over batches
of rows (``leaders``, ``places``), so plans are small and only places that nothing covers leave a row.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_regex, let, normalize_fuzzy, normalized_similarity, strip
from .leaders import clusters_of
from .places import MARKDOWN, PAGE_PLACE, PLACE, TRAILING, document_places, fuzzy, page_places, uncovered
from .rules import _of
from .spans import PAGE

#: Likeness from which two texts are one entity.
SAME = 0.95
#: Confidence that a propagated span keeps.
DECAY = 0.9


def strip_formatting(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN, "")


#: So many spans of a document at most are folded by the plan, comparing with every cluster; more take the candidate index. The fold
#: says the same as a Column, but costs the square of a document's texts and seconds of planning.
FEW_SPANS = 0
_CLUSTERS = "array<struct<text:string,norm_text:string,fuzzy:string,variants:array<string>,label:string,confidence:double,source:string>>"


_ARROW_CLUSTERS = pa.list_(pa.struct([("text", pa.string()), ("norm_text", pa.string()), ("fuzzy", pa.string()), ("variants", pa.list_(pa.string())), ("label", pa.string()), ("confidence", pa.float64()), ("source", pa.string())]))


def _indexed_clusters(items: pa.Array) -> pa.Array:
    listed = ([{**s, "fuzzy": None if s["text"] is None else fuzzy(s["text"])} for s in spans] if spans is not None else None for spans in items.to_pylist())
    return pa.array([clusters_of(x) for x in listed], _ARROW_CLUSTERS)


def _folded(items: Column) -> Column:
    """The clusters of a document's spans as a fold over their array."""

    def step(found: Column, s: Column) -> Column:
        alike = F.array_position(F.transform(found, lambda c: normalized_similarity(c["fuzzy"], s["fuzzy"]) >= SAME), F.lit(True))
        fresh = F.struct(s["text"].alias("text"), s["norm_text"].alias("norm_text"), s["fuzzy"].alias("fuzzy"), F.array(s["text"]).alias("variants"), s["label"].alias("label"), s["confidence"].alias("confidence"), s["source"].alias("source"))

        def joined(c: Column) -> Column:
            better = s["confidence"] > c["confidence"]
            pick = lambda f: F.when(better, s[f]).otherwise(c[f]).alias(f)
            return F.struct(pick("text"), pick("norm_text"), pick("fuzzy"), F.array_union(c["variants"], F.array(s["text"])).alias("variants"), c["label"].alias("label"), pick("confidence"), c["source"].alias("source"))

        return let(alike, lambda at: F.when(at == 0, F.concat(found, F.array(fresh))).otherwise(F.transform(found, lambda c, i: F.when(i + 1 == at, joined(c)).otherwise(c))))

    return F.aggregate(F.transform(items, lambda s: s.withField("fuzzy", normalize_fuzzy(s["text"]))), F.array().cast(_CLUSTERS), step)


def cluster_lists(spans: DataFrame, few: int = FEW_SPANS) -> DataFrame:
    """(doc_id, clusters): the clusters of ``leader_clusters`` as one array a document."""
    grouped = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "norm_text", "label", "confidence", "source"))).alias("items"))
    indexed = F.arrow_udf(_CLUSTERS)(_indexed_clusters)
    if few < 1:
        return grouped.select("doc_id", indexed("items").alias("clusters"))
    return grouped.select("doc_id", F.coalesce(F.when(F.size("items") <= few, _folded(F.col("items"))), indexed(F.when(F.size("items") > few, F.col("items")))).alias("clusters"))


def leader_clusters(spans: DataFrame, few: int = FEW_SPANS) -> DataFrame:
    """(doc_id, cluster, text, norm_text, variants, label, confidence, source).

    Spans by ``ord``: each joins the first cluster whose present text is alike,
    else starts one. A surer span gives the cluster its text; label and source
    stay the first's. Candidates are looked for in an index (``leaders``); documents of at most ``few`` spans
    are folded by comparing with every cluster, with the same result.
    """
    found = cluster_lists(spans, few).select("doc_id", F.posexplode("clusters").alias("cluster", "c"))
    return found.select("doc_id", "cluster", *[F.col(f"c.{f}").alias(f) for f in ("text", "norm_text", "variants", "label", "confidence", "source")])


def flexible_pattern(needle: Column) -> Column:
    """A needle with formatting marks allowed between its characters and around its spaces."""
    marks = "[*_~`]*"
    spell = lambda w: F.array_join(F.transform(F.split(w, ""), escape_regex), marks)
    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(F.split(strip(needle), r"\s+"), spell), rf"{marks}\s+{marks}"))


def tight_bounds(matched: Column, needle: Column) -> tuple[Column, Column]:
    """A match without outer marks and trailing punctuation; all of it if too little would stay."""
    start = F.length(matched) - F.length(F.regexp_replace(matched, f"^{MARKDOWN}+", ""))
    stop = F.greatest(start, F.length(F.regexp_replace(matched, f"{TRAILING}+$", "")))
    enough = stop - start >= F.length(needle) * 0.5
    return F.when(enough, start).otherwise(F.lit(0)), F.when(enough, stop).otherwise(F.length(matched))


_NO_SPANS = "array<struct<char_start:int,char_end:int>>"


def find_variants(clusters: DataFrame, pages: DataFrame, flexible: bool = True) -> DataFrame:
    """Places of every cluster's variants on its document's pages: exact first, flexible where there is no exact one; each once for a cluster.

    A document's variants stand beside each of its pages as one array, so a text moves once, and only places leave
    the row. A page that doesn't hold the needle, marks and spaces aside, is no candidate for the flexible search.
    """
    held = clusters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "variants"))).alias("held"))
    found = F.arrow_udf(f"array<{PLACE}>")(page_places(flexible))("text", F.transform("held", lambda c: c["variants"]), F.array().cast(_NO_SPANS))
    met = pages.select(*PAGE, "text").join(held, "doc_id").select(*PAGE, "held", found.alias("found"))
    numbered = F.transform("found", lambda p: F.struct(F.get("held", p["cluster"])["cluster"].alias("cluster"), p["variant_no"].alias("variant_no"), p["char_start"].alias("char_start"), p["char_end"].alias("char_end")))
    return met.select(*PAGE, F.inline(numbered))


def _chosen(rows: DataFrame) -> DataFrame:
    """Of a page's spans (cluster -1) and places, each with whatever columns, the places that no span or earlier place overlaps."""
    fields = [c for c in rows.columns if c not in PAGE]
    paged = rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("items"))
    return paged.select(*PAGE, F.arrow_udf(paged.schema["items"].dataType)(uncovered)("items").alias("kept")).select(*PAGE, F.inline("kept"))


def _uncovered(places: DataFrame, spans: DataFrame) -> DataFrame:
    """Places in order of cluster, variant and start, without those that a span or an earlier taken place overlaps."""
    fields = [*PAGE, "cluster", "variant_no", "char_start", "char_end"]
    taken = spans.join(places.select(*PAGE).distinct(), list(PAGE), "left_semi").withColumns({"cluster": F.lit(-1), "variant_no": F.lit(0)})
    return _chosen(places.select(*fields).unionByName(taken.select(*fields))).select(*PAGE, "cluster", "char_start", "char_end")


#: So many pages of a document stand in one row beside its clusters: these are repeated for each row, not for each page.
ROW_PAGES = 64


def _open_places(spans: DataFrame, pages: DataFrame, flexible: bool, chosen: bool, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Places of the spans' texts on pages that no span overlaps, as spans with ``cluster`` and ``variant_no``; ``chosen``: that no earlier place overlaps either."""
    clusters = keep(cluster_lists(spans), "clusters")

    def listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.where("doc_id is not null and page_index is not null").select("doc_id", F.floor(F.col("page_index") / ROW_PAGES).alias("row"), F.struct("page_index", *fields).alias(name))

    both = listed(pages, "page", "text").unionByName(listed(spans, "span", "char_start", "char_end"), allowMissingColumns=True)
    # dealt once: by document, for its rows and for its clusters
    rows = both.repartition("doc_id").groupBy("doc_id", "row").agg(F.collect_list("page").alias("pages"), F.collect_list("span").alias("taken")).where("size(pages) > 0")
    found = F.arrow_udf(f"array<{PAGE_PLACE}>")(document_places(flexible, chosen))("pages", F.transform("clusters", lambda c: c["variants"]), "taken")
    of = lambda p: F.get("clusters", p["cluster"])
    named = F.transform("found", lambda p: p.withField("label", of(p)["label"]).withField("confidence", of(p)["confidence"] * DECAY).withField("source", of(p)["source"]))
    met = rows.join(clusters, "doc_id").select("doc_id", "clusters", found.alias("found")).select("doc_id", F.inline(named))
    return met.select(*PAGE, "cluster", "variant_no", "label", "text", "norm_text", "confidence", "source", "char_start", "char_end")


_BROUGHT = (*PAGE, "label", "text", "norm_text", "confidence", "source", "char_start", "char_end")


def as_it_is(df: DataFrame, name: str) -> DataFrame:
    """Keeps nothing: a table is computed wherever it is used."""
    return df


def propagate(spans: DataFrame, pages: DataFrame, *, flexible: bool = True, keep: Callable[[DataFrame, str], DataFrame] = as_it_is) -> DataFrame:
    """New spans wherever a found text occurs on any page of its document and nothing covers it; ``keep`` is given the clusters."""
    return _open_places(spans, pages, flexible, True, keep).select(*_BROUGHT)


def propagate_to_page(spans: DataFrame, new_pages: DataFrame, rules: DataFrame, *, flexible: bool = True, keep: Callable[[DataFrame, str], DataFrame] = as_it_is) -> DataFrame:
    """The same for new pages only; suppressed texts are skipped and overridden labels used.

    Skipped places don't cover later ones.
    """
    places = _open_places(spans, new_pages, flexible, False, keep)
    allowed = places.join(_of(rules, "suppress").select("norm_text"), "norm_text", "left_anti").select(*places.columns)
    # a page that is there twice has its spans twice
    found = _chosen(allowed).join(new_pages.select(*PAGE), list(PAGE)).select(*_BROUGHT)
    return found.join(_of(rules, "override"), "norm_text", "left").withColumn("label", F.coalesce("rule_label", "label")).drop("rule_label").select(*_BROUGHT)
