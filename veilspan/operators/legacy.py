"""The older engine's entity handling: ranked merging, ignore list, first occurrences, rewriting.

Entities are rows (doc_id, ord, char_start, char_end, original, type,
confidence high/medium/low/manual, source, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches
from .ner import expand_to_words

# The two address patterns and the types that carry no number.
ADDRESS = r"(?iu)[0-9]{1,4}[\s,]+(?:rue|avenue|boulevard|place|chemin|allée|impasse|passage|cours|quai)\s+[A-Za-zÀ-ÿ\s\x27-]+,?\s*[0-9]{5}\s+[A-Za-zÀ-ÿ\s-]+"
ADDRESS_SIMPLE = r"(?iu)(?:au|demeurant\s+(?:au)?)\s+[0-9]{1,4}[\s,]+(?:rue|avenue|boulevard|place|chemin|allée)[A-Za-zÀ-ÿ\s\x27,-]+(?:[0-9]{5}\s+[A-Za-zÀ-ÿ-]+)?"
UNNUMBERED = ("TÉLÉPHONE", "EMAIL", "NIR", "SIREN", "SIRET", "CAPITAL")


def rank(confidence: Column, manual: int) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).when(confidence == "manual", manual).otherwise(0)


def priority(e: Column) -> Column:
    """What overlapping entities compete by: confidence first, then score, length, and a bonus for places found by pattern."""
    return rank(e["confidence"], 100) * 1000 + F.coalesce(F.nullif(e["score"], F.lit(0.0)), F.lit(0.5)) * 100 + (e["char_end"] - e["char_start"]) + F.when((e["source"] == "regex") & (e["type"] == "LIEU"), 500).otherwise(0)


def detect_addresses(pages: DataFrame) -> DataFrame:
    """Full addresses; simpler ones where neither end lies in one that was found before."""
    full, simple = matches(F.col("text"), ADDRESS), matches(F.col("text"), ADDRESS_SIMPLE)
    inside = lambda m, e: ((m["start"] >= e["start"]) & (m["start"] < e["stop"])) | ((m["stop"] > e["start"]) & (m["stop"] <= e["stop"]))
    typed = lambda m, c: F.struct(m["start"].alias("char_start"), m["stop"].alias("char_end"), F.trim(m["text"]).alias("original"), F.lit(c).alias("confidence"))
    withs = pages.withColumn("full", full).withColumn("simple", simple)
    rest = F.filter("simple", lambda m: ~F.exists("full", lambda e: inside(m, e)))
    all_found = F.concat(F.transform("full", lambda m: typed(m, "high")), F.transform(rest, lambda m: typed(m, "medium")))
    return withs.select("doc_id", F.posexplode(all_found).alias("ord", "m")).select("doc_id", "ord", "m.*", F.lit("ADRESSE").alias("type"), F.lit("regex").alias("source"))


def merge_entities(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """One sweep by start: of overlapping entities the higher priority stays, and takes in the tail of one of its type."""
    item = F.struct("char_start", (-rank(F.col("confidence"), 4)).alias("k"), "ord", "char_end", "original", "type", "confidence", "source", "score")
    grouped = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(texts.select("doc_id", F.col("text").alias("page_text")), "doc_id")
    kind = grouped.schema["items"].dataType.simpleString()
    names = [f.name for f in grouped.schema["items"].dataType.elementType.fields]

    def step(out: Column, x: Column) -> Column:
        now = F.element_at(out, -1)
        won = F.when(priority(x) > priority(now), x).otherwise(now)
        grows = (x["char_end"] > won["char_end"]) & (x["type"] == won["type"])
        stop = F.when(grows, x["char_end"]).otherwise(won["char_end"])
        text = F.when(grows, F.substring(F.col("page_text"), won["char_start"] + 1, stop - won["char_start"])).otherwise(won["original"])
        merged = F.struct(*[{"char_end": stop, "original": text}.get(n, won[n]).alias(n) for n in names])
        return F.when(F.size(out) == 0, F.array(x)).when(x["char_start"] < now["char_end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    folded = grouped.select("doc_id", F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("e"))
    return folded.select("doc_id", *[F.col(f"e.{n}").alias(n) for n in names if n != "k"])


def clean_model_entities(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Without AUTRE; missing places are looked up; widened to words; places take in a number of 2 to 5 digits before them."""
    met = entities.where("type <> 'AUTRE'").join(texts.select("doc_id", F.col("text").alias("page_text")), "doc_id")
    missing = F.col("char_start").isNull() | F.col("char_end").isNull() | (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start"))
    found = F.instr(F.lower("page_text"), F.lower("original")) - 1
    placed = met.withColumn("_a", F.when(missing, found).otherwise(F.col("char_start"))).withColumn("_b", F.when(missing, found + F.length("original")).otherwise(F.col("char_end"))).where("_a >= 0")
    a, b = expand_to_words(F.col("page_text"), F.col("_a"), F.col("_b"))
    wide = placed.withColumns({"char_start": a, "char_end": b})
    before = F.substring(F.col("page_text"), F.greatest(F.col("char_start") - 9, F.lit(1)), F.least(F.col("char_start"), F.lit(10)))
    number = F.when(F.col("type") == "LIEU", F.length(F.regexp_extract(before, r"[0-9]{2,5}\s*$", 0))).otherwise(0)
    out = wide.withColumn("char_start", F.col("char_start") - number)
    return out.withColumn("original", F.substring(F.col("page_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("_a", "_b", "page_text")


def without_ignored(entities: DataFrame, ignored: DataFrame) -> DataFrame:
    return entities.withColumn("_k", F.lower(F.trim("original"))).join(ignored.select(F.lower(F.trim("original")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def first_of_each(entities: DataFrame) -> DataFrame:
    """The first entity of every text."""
    w = Window.partitionBy("doc_id", F.lower(F.trim("original"))).orderBy("char_start", "ord")
    return entities.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def earliest(occurrences: DataFrame) -> DataFrame:
    """Occurrences (doc_id, char_start, char_end, replacement) without those that begin inside a kept earlier one."""
    item = F.struct("char_start", "char_end", "replacement")
    kind = "array<struct<char_start:int,char_end:int,replacement:string>>"
    keep = lambda out, x: F.when((F.size(out) == 0) | (x["char_start"] >= F.element_at(out, -1)["char_end"]), F.concat(out, F.array(x))).otherwise(out)
    return occurrences.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), keep).alias("kept"))


def rewrite(kept: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts with their kept occurrences replaced, left to right."""
    parts = F.transform("kept", lambda k, i: F.concat(F.substring(F.col("text"), F.coalesce(F.get("kept", i - 1)["char_end"], F.lit(0)) + 1, k["char_start"] - F.coalesce(F.get("kept", i - 1)["char_end"], F.lit(0))), k["replacement"]))
    tail = F.substring(F.col("text"), F.element_at("kept", -1)["char_end"] + 1, F.length("text"))
    met = texts.join(kept, "doc_id", "left")
    return met.select("doc_id", F.when(F.size("kept") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text")).alias("anonymized_text"))


def numbered(entities: DataFrame) -> DataFrame:
    """[TYPE_n] by order within the type; some types carry no number."""
    w = Window.partitionBy("doc_id", "type").orderBy("char_start", "ord")
    n = F.row_number().over(w).cast("string")
    return entities.withColumn("replacement", F.when(F.col("type").isin(*UNNUMBERED), F.concat(F.lit("["), "type", F.lit("]"))).otherwise(F.concat(F.lit("["), "type", F.lit("_"), n, F.lit("]"))))


def edited(entities: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Entities with manual ones added (the manual one wins a place) and (doc_id, ord) rows removed."""
    kept = entities.join(added.select("doc_id", "char_start", "char_end"), ["doc_id", "char_start", "char_end"], "left_anti").unionByName(added.withColumn("confidence", F.lit("manual")))
    return kept.join(removed, ["doc_id", "ord"], "left_anti")
