"""Corpus rules: suppressed texts, label overrides, forced labels.

Rules are rows (kind, norm_text, label) with kind suppress, override or force.
They are edited by people; still, joins leave it to the planner whether the
rules' measured size allows a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entity_label, let, matches, normalize, occurrences, running, spaced, strip
from .spans import PAGE, new_places


#: So many needles at most are searched one by one on every page.
FEW_NEEDLES = 500
#: Characters of the needles that one automaton holds, about.
BLOCK_CHARS = 4_000_000


def _of(rules: DataFrame, kind: str) -> DataFrame:
    return rules.where(F.col("kind") == kind).select("norm_text", F.col("label").alias("rule_label"))


def apply_decisions(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Without suppressed texts, with overridden labels."""
    kept = spans.join(_of(rules, "suppress").select("norm_text").distinct(), "norm_text", "left_anti")
    return kept.join(_of(rules, "override"), "norm_text", "left").withColumn("label", F.coalesce("rule_label", "label")).drop("rule_label").select(*spans.columns)


def effective_suppression(builtin: DataFrame, user: DataFrame) -> DataFrame:
    return builtin.select("norm_text").union(user.select("norm_text")).distinct()


def collapsed(text: Column) -> Column:
    """The text with every stretch of white space as one space."""
    return F.regexp_replace(text, spaced(r"\s+"), " ")


def stretches(text: Column) -> Column:
    """Of every stretch of several white-space characters: its place in the collapsed text, and how many characters are lost up to its end."""
    def listed(found: Column) -> Column:
        lost = running(F.transform(found, lambda m: m["stop"] - m["start"] - 1), lambda x, y: x + y)
        return let(lost, lambda n: F.transform(found, lambda m, i: F.struct((m["start"] - F.coalesce(F.get(n, i - 1), F.lit(0))).alias("at"), F.get(n, i).alias("lost"))))

    return let(matches(text, spaced(r"\s{2,}")), listed)


def raw_offset(found: Column, at: Column) -> Column:
    """Where a place in the collapsed text is in the raw text with these ``stretches``."""
    return at + F.coalesce(F.array_max(F.transform(F.filter(found, lambda s: s["at"] < at), lambda s: s["lost"])), F.lit(0))


def _needle_blocks(needles: DataFrame, block_chars: int) -> Iterator[list[str]]:
    """Different needles in blocks of so many characters about; the driver holds one at a time."""
    block, size = [], 0
    for (needle,) in needles.toLocalIterator():
        block.append(needle)
        size += len(needle)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _automaton(spark: SparkSession, needles: list[str]) -> Callable[[Column], Column]:
    """A function that gives all (needle, at) of a lower-cased text, overlaps included: one pass, whatever the number of needles."""
    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, needle in enumerate(needles):
        built.add_word(needle, k)
    built.make_automaton()
    held = spark.sparkContext.broadcast((built, needles))  # a block's size

    @F.arrow_udf("array<struct<needle:string,at:int>>")
    def find(text: pa.Array) -> pa.Array:
        automaton, known = held.value
        hits, at, ends = [], [], [0]
        for t in text:
            for last, k in automaton.iter(t.as_py() or ""):
                hits.append(known[k])
                at.append(last + 1 - len(known[k]))
            ends.append(len(hits))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(hits, pa.string()), pa.array(at, pa.int32())], ["needle", "at"]))

    return find


def find_in_pages(pages: DataFrame, needles: DataFrame, few: int = FEW_NEEDLES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every occurrence of every needle (norm_text, rule_label), in texts with white space collapsed; places in the raw text.

    Up to ``few`` different needles, counted, are tried on every page as they
    are. More are built into an automaton that passes once over each page; very many are
    several automata of bounded size, each with a pass of its own. Only places leave a page's row.
    """
    keyed = needles.where(F.length("norm_text") > 0).distinct()
    held = [r.norm_text for r in keyed.select("norm_text").distinct().limit(few + 1).collect()]
    low = F.lower(collapsed(F.col("text")))
    if len(held) <= few:
        tried = F.array(*map(F.lit, held)).cast("array<string>")
        met = pages.select(*PAGE, "text", F.explode(let(low, lambda x: F.filter(tried, lambda n: F.contains(x, n)))).alias("norm_text"))
        found = met.join(F.broadcast(keyed), "norm_text")  # at most ``few`` texts
        placed = found.withColumn("_stretches", stretches(F.col("text"))).withColumn("_at", F.explode(occurrences(collapsed(F.col("text")), F.col("norm_text"))))
    else:
        different = keyed.select(F.lower("norm_text").alias("needle")).distinct()
        placed = None
        for block in _needle_blocks(different, block_chars):
            hits = pages.select(*PAGE, "text", stretches(F.col("text")).alias("_stretches"), _automaton(pages.sparkSession, block)(low).alias("_hits")).where(F.size("_hits") > 0)
            hits = hits.select(*PAGE, "text", "_stretches", F.explode("_hits").alias("_hit")).select(*PAGE, "text", "_stretches", F.col("_hit.needle").alias("_needle"), F.col("_hit.at").alias("_at"))
            placed = hits if placed is None else placed.unionByName(hits)
        placed = placed.join(keyed.withColumn("_needle", F.lower("norm_text")), "_needle")
    start = raw_offset(F.col("_stretches"), F.col("_at"))
    stop = raw_offset(F.col("_stretches"), F.col("_at") + F.length("norm_text") - 1) + 1
    return placed.select(*PAGE, "norm_text", "rule_label", start.alias("char_start"), stop.alias("char_end"), "text")


def forced_spans(pages: DataFrame, spans: DataFrame, rules: DataFrame) -> DataFrame:
    """User spans of confidence 1 wherever a forced text occurs and no span has that place.

    Suppressed texts are not forced. A place that several rules claim goes to
    the rule with the smallest text.
    """
    needles = _of(rules, "force").join(_of(rules, "suppress").select("norm_text"), "norm_text", "left_anti")
    found = new_places(find_in_pages(pages, needles), spans)
    first = Window.partitionBy(*PAGE, "char_start", "char_end").orderBy("norm_text")
    once = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    text = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return once.select(*PAGE, F.col("rule_label").alias("label"), text.alias("text"), normalize(text).alias("norm_text"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), "char_start", "char_end")


def literal_spans(pages: DataFrame, spans: DataFrame, needle: str, label: str) -> DataFrame:
    """All occurrences of one text as it is, letter case aside, where no span has the place."""
    found = pages.where(F.contains(F.lower("text"), F.lit(needle.lower()))).withColumn("char_start", F.explode(occurrences(F.col("text"), F.lit(needle)))).withColumn("char_end", F.col("char_start") + len(needle))
    text = F.substring(F.col("text"), F.col("char_start") + 1, F.lit(len(needle)))
    return new_places(found, spans).select(*PAGE, F.lit(label).alias("label"), text.alias("text"), normalize(text).alias("norm_text"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), "char_start", "char_end")


def count_matches(pages: DataFrame, needle: str) -> DataFrame:
    """(doc_id, n): occurrences of a text in each document."""
    return pages.groupBy("doc_id").agg(F.sum(F.size(occurrences(F.col("text"), F.lit(needle)))).alias("n"))


def remove_text(spans: DataFrame, norm_text: str) -> tuple[DataFrame, DataFrame]:
    """Spans of all documents without a text; (doc_id, removed, entity_count) of the documents that change."""
    kept = spans.where(F.col("norm_text") != norm_text)
    hit = F.sum((F.col("norm_text") == norm_text).cast("long"))
    return kept, spans.groupBy("doc_id").agg(hit.alias("removed"), (F.count(F.lit(1)) - hit).alias("entity_count")).where("removed > 0")


def relabel_text(spans: DataFrame, norm_text: str, label: str) -> DataFrame:
    """A text's spans get the label and count as the user's."""
    hit = F.col("norm_text") == norm_text
    return spans.withColumn("label", F.when(hit, F.lit(label)).otherwise(F.col("label"))).withColumn("source", F.when(hit, F.lit("user")).otherwise(F.col("source")))


def upsert_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Rules after (seq, kind, text, label, deleted) edits, last one wins; blank texts are rejected, labels mapped."""
    clean = edits.withColumn("norm_text", normalize(F.col("text"))).where(F.length(strip(F.col("text"))) > 0)
    both = rules.select("kind", "norm_text", "label", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted")).unionByName(clean.select("kind", "norm_text", "label", F.col("seq").cast("long").alias("seq"), "deleted"))
    last = Window.partitionBy("kind", "norm_text").orderBy(F.desc("seq"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1 and not deleted").select("kind", "norm_text", entity_label(F.col("label")).alias("label"))


def effective_scope(scope: Column) -> Column:
    """Changes for future documents also reach the stored ones."""
    return F.when(scope == "future_documents", "all_documents").otherwise(scope)
