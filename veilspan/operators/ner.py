"""Post-processing of token classification: from token probabilities to entities.

Inference is outside. ``predict`` starts at tokens with places and
probabilities; ``predict_pages`` at whole pages, with a model that is a Column
over chunks of text, so that inference moves no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import ends_with_date, let, looks_like_date, looks_like_date_part, normalize, strip
from .chunk_entities import ENTITY, RESULT, RESULT_ROWS, chunk_entities, swept_pages
from .detect import excluded
from .spans import PAGE

# Thresholds, limits, word lists.
THRESHOLDS = {"PER": 0.60, "ORG": 0.70, "LOC": 0.60}
LABEL_OF = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "ADDRESS"}
CHUNK, OVERLAP = 1500, 200
ADDRESS_GAP, PERSON_GAP = 30, 5
STOP_WORDS = tuple("d de du des le la les l un une et ou à au aux en par pour sur sous avec sans entre dans ce cette ces son sa ses leur leurs qui que dont où est sont s n m t c j qu si ne pas plus tout tous toute toutes autre autres même mêmes".split())
BRIDGE_WORDS = tuple("rue avenue boulevard place allée impasse chemin route passage cours quai square villa cité résidence de du des la le les l aux au saint sainte st ste cedex bp cs bis ter quater a b c".split())
DELIMITERS = r"\s.,;:!?()\[\]{}\"«»–—/\\-"
PUNCTUATION = r"[.,;:!?\x27\"()\[\]«»\s–—-]"
SCORE_FLOOR = 0.05
PROMPTS = {"person name and surname": "PERSON", "organization and company": "ORGANIZATION", "address and location": "ADDRESS"}

PROBS = ("p_per", "p_org", "p_loc", "p_misc", "p_o")
_ENTITY_FIELDS = [f.split(":")[0] for f in ENTITY.removeprefix("struct<").removesuffix(">").split(",")]


def chunk_bounds(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping stretches that break, if late enough, at a blank line, a sentence or a space."""
    out, start, n = [], 0, len(text)
    while start < n or not out:
        stop = min(start + size, n)
        if stop < n:
            floor = start + size / 2
            for mark in ("\n\n", ". ", " "):
                at = text.rfind(mark, 0, stop + len(mark))
                if at > floor:
                    stop = at + 1
                    break
        out.append((start, stop))
        if stop >= n:
            break
        start = max(stop - overlap, start + 1)
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.doc_id, r.page_index, k, a, r.text[a:b]) for r in pdf.itertuples(index=False) for k, (a, b) in enumerate(chunk_bounds(r.text))]
        yield pd.DataFrame(rows, columns=["doc_id", "page_index", "chunk", "start", "text"])


def split_into_chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, chunk, start, text); breaks depend on the break before, hence a function over whole texts."""
    return pages.select("doc_id", "page_index", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_chunks, "doc_id long, page_index int, chunk int, start int, text string")


def softmax(logits: Column) -> Column:
    # the largest, the powers and their sum are each computed once, not for every element
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def base_type(label: Column) -> Column:
    base = F.when(F.startswith(label, F.lit("B-")) | F.startswith(label, F.lit("I-")), F.substring(label, 3, 1 << 30)).otherwise(label)
    return F.when(base.isin("PER", "ORG", "LOC", "MISC", "O"), base).otherwise("O")


def base_probabilities(probs: Column, labels: Column) -> Column:
    """A struct with the sums of each base type's probabilities."""
    zipped = F.zip_with(probs, labels, lambda p, l: F.struct(p.alias("p"), base_type(l).alias("b")))
    total = lambda pairs, t: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(x["b"] == t, x["p"]).otherwise(0.0))
    return let(zipped, lambda pairs: F.struct(*[total(pairs, t).alias(f"p_{t.lower()}") for t in ("PER", "ORG", "LOC", "MISC", "O")]))


def winning_tag(probs: Column, labels: Column) -> Column:
    """The label of the largest probability, the first of equals."""
    return F.coalesce(F.element_at(labels, F.array_position(probs, F.array_max(probs)).cast("int")), F.lit("O"))


def align_tokens(words: list[str], starts_word: list[bool], text: str) -> list[tuple[int, int] | None]:
    """Each token's place: right after the last one inside a word, else forward from it, else from five before."""
    out, at, low = [], 0, text.lower()
    for k, (word, begins) in enumerate(zip(words, starts_word, strict=True)):
        small = word.lower()
        found = at if not begins and low.startswith(small, at) else -1
        if found < 0:
            found = low.find(small, at)
        if found < 0 and at > 0:
            found = low.find(small, max(0, at - 5))
        if found < 0:
            out.append(None)
            continue
        at = found + len(word)
        out.append((found, at))
    return out


def _token_starts(words: pd.Series, starts_word: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[-1 if p is None else p[0] for p in align_tokens(list(w), list(s), t)] for w, s, t in zip(words, starts_word, text, strict=True)], dtype=object)


def token_starts(words: str, starts_word: str, text: str) -> Column:
    """Where each token of an array begins in its text, -1 if nowhere; each place depends on the one before.

    Told to be non-deterministic, so that no filter inferred later runs it, and the model under it, a second time.
    """
    return F.pandas_udf(_token_starts, ArrayType(IntegerType())).asNondeterministic()(words, starts_word, text)


def align(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens (doc_id, page_index, token_idx, word, is_word_start) with their places on their page, whose text is met once."""
    per_page = tokens.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("token_idx", "word", "is_word_start"))).alias("tokens"))
    met = per_page.join(pages.select(*PAGE, F.coalesce("text", F.lit("")).alias("text")), list(PAGE))
    placed = met.select(*PAGE, F.arrays_zip(F.col("tokens").alias("t"), token_starts("tokens.word", "tokens.is_word_start", "text").alias("at")).alias("tokens"))
    each = placed.select(*PAGE, F.explode("tokens").alias("x")).where("x.at >= 0")
    return each.select(*PAGE, "x.t.token_idx", "x.t.word", F.col("x.at").alias("char_start"), (F.col("x.at") + F.length("x.t.word")).alias("char_end"))


def decide_labels(tokens: DataFrame) -> DataFrame:
    """Adds ``winner`` (PER, ORG, LOC or O) and ``winner_p``: the best of the three if it reaches its threshold."""
    per, org, loc = (F.col(c) for c in ("p_per", "p_org", "p_loc"))
    best = F.greatest(per, org, loc)
    name = F.when(best <= 0, "O").when(per == best, "PER").when(org == best, "ORG").otherwise("LOC")
    bar = F.when(name == "ORG", THRESHOLDS["ORG"]).otherwise(THRESHOLDS["PER"])
    winner = F.when((name != "O") & (best >= bar), name).otherwise("O")
    return tokens.withColumn("winner", winner).withColumn("winner_p", F.when(F.col("winner") != "O", best).otherwise(F.col("p_o")))


def group_tokens(tokens: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Runs of tokens as entities: (the keys, char_start, char_end, base, means of PROBS, n_tokens).

    A token continues the entity of the token before it if the winner is the
    same and it is an I tag, a subword without a B tag, a subword right behind,
    or a person within two characters. A token of no entity ends a run.
    """
    w = Window.partitionBy(*keys).orderBy("token_idx")
    before, gap = F.lag("winner").over(w), F.col("char_start") - F.lag("char_end").over(w)
    subword = ~F.col("is_word_start")
    follows = F.col("bio_tag").startswith("I-") | (subword & ~F.col("bio_tag").startswith("B-")) | (subword & (gap <= 1)) | ((F.col("winner") == "PER") & (gap <= 2))
    marked = tokens.withColumn("new", F.when((F.col("winner") == before) & follows, 0).otherwise(1))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    named = marked.withColumn("run", run).where("winner <> 'O'")
    return named.groupBy(*keys, "run").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.first("winner").alias("base"), *[F.avg(c).alias(c) for c in PROBS], F.count(F.lit(1)).alias("n_tokens")).drop("run")


def expand_to_words(text: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """A place widened to the delimiters around it."""
    left = F.length(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), start)), f"^[^{DELIMITERS}]*", 0))
    right = F.length(F.regexp_extract(F.substring(text, stop + 1, F.length(text)), f"^[^{DELIMITERS}]*", 0))
    return start - left, stop + right


def cut(text: str, start: str = "char_start", stop: str = "char_end") -> Column:
    return F.substring(F.col(text), F.col(start) + 1, F.col(stop) - F.col(start))


def finalize(entities: DataFrame, pages: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Entities widened to whole words, with their text and the page's as ``page_text``."""
    met = entities.join(pages.select(*keys, F.col("text").alias("page_text")), list(keys))
    start, stop = expand_to_words(F.col("page_text"), F.col("char_start"), F.col("char_end"))
    return met.withColumns({"char_start": start, "char_end": stop}).withColumn("text", cut("page_text"))


def max_probability() -> Column:
    return F.when(F.col("base") == "PER", F.col("p_per")).when(F.col("base") == "ORG", F.col("p_org")).when(F.col("base") == "LOC", F.col("p_loc")).otherwise(F.col("p_misc"))


def is_false_positive(text: Column, base: Column, p: Column) -> Column:
    """One character, a common word, digits and punctuation only, short and unsure, or a person that is a date's part."""
    plain = lambda t: (F.length(t) <= 1) | F.lower(t).isin(*STOP_WORDS) | t.rlike(r"^[\d\s.,;:!?\x27\"()-]+$") | ((F.length(t) <= 2) & (p < 0.9)) | ((base == "PER") & looks_like_date_part(t))
    return let(strip(text), plain)


def filter_false_positives(entities: DataFrame) -> DataFrame:
    return entities.where(~is_false_positive(F.col("text"), F.col("base"), max_probability()))


def _behind(text: Column, start: Column) -> Column:
    """The 30 characters before a place."""
    return F.substring(text, F.greatest(start - (ADDRESS_GAP - 1), F.lit(1)), F.least(start, F.lit(ADDRESS_GAP)))


def _street_number(behind: Column, base: Column) -> Column:
    # only a place with a digit behind it has a number to look for
    return F.when((base == "LOC") & behind.rlike("[0-9]"), F.regexp_extract(behind, r"(?i)(\d+(?:\s*(?:bis|ter|quater|[a-c]))?[,\s]*)\s*$", 1)).otherwise("")


def _address_start(start: Column, behind: Column, number: Column) -> Column:
    takes = (F.length(number) > 0) & ~looks_like_date(number) & ~ends_with_date(behind)
    # the number's last occurrence in the stretch is where it ends
    return F.when(takes, start - F.instr(F.reverse(behind), F.reverse(number)) + 1 - F.length(number)).otherwise(start)


def expand_addresses(entities: DataFrame) -> DataFrame:
    """Places take in a street number in the 30 characters before them, unless it belongs to a date."""
    behind = _behind(F.col("page_text"), F.col("char_start"))
    return entities.withColumn("char_start", _address_start(F.col("char_start"), behind, _street_number(behind, F.col("base")))).withColumn("text", cut("page_text"))


def _merge_runs(entities: DataFrame, base: str, bridges: Column, keys: tuple[str, ...]) -> DataFrame:
    """Joins consecutive entities of one type where ``bridges`` holds for ``gap`` and ``gap_text``; means by tokens.

    Entities come with ``page_text``, or with ``before`` alone, the ADDRESS_GAP characters before them, and then leave without a text.
    """
    w = Window.partitionBy(*keys).orderBy("char_start", "char_end")
    prior = entities.withColumns({"prior_base": F.lag("base").over(w), "prior_end": F.lag("char_end").over(w)})
    gap = F.col("char_start") - F.col("prior_end")
    whole = "page_text" in entities.columns
    between = F.substring(F.col("page_text"), F.col("prior_end") + 1, F.greatest(gap, F.lit(0))) if whole else F.when(gap <= ADDRESS_GAP, F.right(F.col("before"), F.greatest(gap, F.lit(0))))
    gapped = prior.withColumn("gap", gap).withColumn("gap_text", between)
    joins = (F.col("base") == base) & (F.col("prior_base") == base) & bridges
    run = gapped.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    means = [(F.sum(F.col(p) * F.col("n_tokens")) / F.sum("n_tokens")).alias(p) for p in PROBS]
    last = F.max_by("char_end", F.struct("char_start", "char_end"))
    carried = F.first("page_text").alias("page_text") if whole else F.min_by("before", F.struct("char_start", "char_end")).alias("before")
    merged = run.groupBy(*keys, "run", "base").agg(F.min("char_start").alias("char_start"), last.alias("char_end"), carried, *means, F.sum("n_tokens").alias("n_tokens")).drop("run")
    return merged.withColumn("text", cut("page_text")) if whole else merged


def _bridges_addresses(gap: Column, between: Column) -> Column:
    def bridged(between: Column) -> Column:
        words = F.filter(F.split(between, r"[\s,]+", -1), lambda w: F.length(w) > 0)
        fits = F.forall(words, lambda w: w.rlike("^[0-9]+$") | w.isin(*BRIDGE_WORDS) | (F.length(w) <= 1))
        return ~looks_like_date(between) & fits

    return (gap <= ADDRESS_GAP) & bridged(F.lower(strip(between)))


def _bridges_persons(gap: Column, between: Column) -> Column:
    return (gap <= PERSON_GAP) & between.rlike(r"^[\s\x27-]*$")


def merge_addresses(entities: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Places at most 30 apart with only numbers, address words or single characters between them."""
    return _merge_runs(entities, "LOC", _bridges_addresses(F.col("gap"), F.col("gap_text")), keys)


def merge_persons(entities: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Persons at most five characters apart with only spaces, hyphens or apostrophes between them."""
    return _merge_runs(entities, "PER", _bridges_persons(F.col("gap"), F.col("gap_text")), keys)


def merged_items(entities: Column, text: Column, base: str, bridges: Callable[[Column, Column], Column]) -> Column:
    """``_merge_runs`` of one text's entities as an array (``chunk_entities.ENTITY``): the first of a run has the sums of its means by tokens."""
    kind = f"array<{ENTITY}>"
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(*[(e[p] * e["n_tokens"]).alias(p) if p in PROBS else e[p].alias(p) for p in _ENTITY_FIELDS])))

    def step(out: Column, x: Column) -> Column:
        def met(last: Column) -> Column:
            gap = x["char_start"] - last["char_end"]
            joins = (x["base"] == base) & (last["base"] == base) & bridges(gap, F.substring(text, last["char_end"] + 1, F.greatest(gap, F.lit(0))))
            both = F.struct(*[x[f].alias(f) if f == "char_end" else (last[f] + x[f]).alias(f) if f in (*PROBS, "n_tokens") else last[f].alias(f) for f in _ENTITY_FIELDS])
            return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(x)))

        return F.when(F.size(out) == 0, F.array(x)).otherwise(let(F.element_at(out, -1), met)).cast(kind)

    means = lambda e: F.struct(*[(e[f] / e["n_tokens"]).alias(f) if f in PROBS else e[f].alias(f) for f in _ENTITY_FIELDS])
    return F.transform(F.aggregate(ordered, F.array().cast(kind), step), means)


def to_results(entities: DataFrame, offset: Column | None = None) -> DataFrame:
    """Labels and scores; MISC falls back to the best other type above its threshold, else the entity goes."""
    p = {b: F.col(f"p_{b.lower()}") for b in THRESHOLDS}
    able = {b: F.when(p[b] >= THRESHOLDS[b], p[b]).otherwise(F.lit(0.0)) for b in THRESHOLDS}
    best = F.greatest(*able.values())
    fallback = F.when(best <= 0, "MISC").when(able["PER"] == best, "PER").when(able["ORG"] == best, "ORG").otherwise("LOC")
    shown = F.when(F.col("base") == "MISC", fallback).otherwise(F.col("base"))
    label = F.when(shown == "PER", "PERSON").when(shown == "ORG", "ORGANIZATION").when(shown == "LOC", "ADDRESS")
    score = F.when(shown == "PER", p["PER"]).when(shown == "ORG", p["ORG"]).when(shown == "LOC", p["LOC"])
    shift = offset if offset is not None else F.lit(0)
    return entities.select(*PAGE, label.alias("label"), "text", (F.col("char_start") + shift).alias("char_start"), (F.col("char_end") + shift).alias("char_end"), score.alias("score")).where("label is not null")


def deduplicate_results(results: DataFrame) -> DataFrame:
    """One sweep by start: a result that overlaps the one at hand, or has its text, replaces it if it scores more, else goes."""
    item = F.struct("char_start", "char_end", "label", "text", "score")
    kind = "array<struct<char_start:int,char_end:int,label:string,text:string,score:double>>"

    def step(out: Column, x: Column) -> Column:
        now = F.element_at(out, -1)
        meets = (now["char_end"] > x["char_start"]) | (F.lower(now["text"]) == F.lower(x["text"]))
        swapped = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(x))
        return F.when(F.size(out) == 0, F.array(x)).when(~meets, F.concat(out, F.array(x))).when(x["score"] > now["score"], swapped).otherwise(out)

    folded = results.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), step).alias("kept"))
    return folded.select(*PAGE, F.explode("kept").alias("k")).select(*PAGE, "k.label", "k.text", "k.char_start", "k.char_end", "k.score")


def results_to_spans(results: DataFrame) -> DataFrame:
    return results.select(*PAGE, "label", "text", normalize(F.col("text")).alias("norm_text"), F.col("score").alias("confidence"), F.lit("ner").alias("source"), "char_start", "char_end")


def _results_of(tokens: DataFrame, texts: DataFrame, keys: tuple[str, ...], offset: Column | None = None) -> DataFrame:
    entities = filter_false_positives(finalize(group_tokens(tokens, keys), texts, keys))
    # entities are sorted by page several times: they carry what the merges look at, and meet the page's text again at the end
    placed = expand_addresses(entities)
    before = _behind(F.col("page_text"), F.col("char_start"))
    merged = merge_persons(merge_addresses(placed.withColumn("before", before).drop("page_text", "text"), keys), keys)
    met = merged.join(texts.select(*keys, F.col("text").alias("page_text")), list(keys))
    return to_results(met.withColumn("text", cut("page_text")), offset)


def predict(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """All steps from token probabilities to deduplicated results."""
    return deduplicate_results(_results_of(decide_labels(tokens), pages, PAGE))


#: A chunk is known by its page and where it starts there.
CHUNK_KEYS = (*PAGE, "start")


def decode(tokens: DataFrame, labels: Column) -> DataFrame:
    """Adds ``bio_tag`` and PROBS from a token's ``logits``, one for each of ``labels``."""
    scored = tokens.withColumn("_probs", softmax(F.col("logits")))
    return scored.select("*", winning_tag(F.col("_probs"), labels).alias("bio_tag"), base_probabilities(F.col("_probs"), labels).alias("_base")).select(*tokens.columns, "bio_tag", "_base.*")


def chunk_entities_of(text: Column, tokens: Column, labels: Column) -> Column:
    """A chunk's entities as an array, from its text and its model's tokens; non-deterministic for the reason of ``token_starts``."""
    return F.arrow_udf(chunk_entities(align_tokens, THRESHOLDS), f"array<{ENTITY}>").asNondeterministic()(text, tokens, labels)


def _chunk_results(text: Column, entities: Column, offset: Column) -> Column:
    """The steps of ``_results_of`` in a chunk's row."""
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    sure = lambda e: F.when(e["base"] == "PER", e["p_per"]).when(e["base"] == "ORG", e["p_org"]).otherwise(e["p_loc"])
    kept = F.filter(entities, lambda e: ~is_false_positive(piece(e["char_start"], e["char_end"]), e["base"], sure(e)))
    start = lambda e: let(_behind(text, e["char_start"]), lambda b: let(_street_number(b, e["base"]), lambda n: _address_start(e["char_start"], b, n)))
    placed = F.transform(kept, lambda e: F.struct(*[(F.when(e["base"] == "LOC", start(e)).otherwise(e[f]) if f == "char_start" else e[f]).alias(f) for f in _ENTITY_FIELDS]))
    merged = merged_items(merged_items(placed, text, "LOC", _bridges_addresses), text, "PER", _bridges_persons)
    label = lambda e: F.when(e["base"] == "PER", LABEL_OF["PER"]).when(e["base"] == "ORG", LABEL_OF["ORG"]).otherwise(LABEL_OF["LOC"])
    result = lambda e: F.struct((e["char_start"] + offset).alias("char_start"), (e["char_end"] + offset).alias("char_end"), label(e).alias("label"), piece(e["char_start"], e["char_end"]).alias("text"), sure(e).alias("score"))
    return F.transform(merged, result).cast(f"array<{RESULT}>")


def predict_pages(pages: DataFrame, model: Callable[[Column], Column], labels: Column) -> DataFrame:
    """All steps from whole pages to deduplicated results: chunks, model, places, entities by chunk, places on the page.

    ``model`` gives for a chunk's text its tokens in order, as
    array<struct<word,is_word_start,logits>>. Chunks overlap; what two of them
    find comes once. An empty or null text has no results. Tokens and entities stay
    in their chunk's row, and a page's chunks where it is read: nothing is shuffled.
    """
    chunks = split_into_chunks(pages).drop("chunk")
    seen = chunks.select(*CHUNK_KEYS, "text", chunk_entities_of(F.col("text"), model(F.col("text")), labels).alias("entities"))
    return seen.select(*CHUNK_KEYS, _chunk_results(F.col("text"), F.col("entities"), F.col("start")).alias("results")).mapInArrow(swept_pages, RESULT_ROWS)


def strip_markdown(text: Column) -> Column:
    """Text without formatting marks, for a model that reads plain text; the order of the steps counts."""
    for pattern, by in ((r"\*\*", ""), (r"\*", ""), ("__", ""), (r"#{1,6}\s*", ""), ("---+", " "), (r"\*\*\*+", " "), (r"(?m)^[-*+]\s+", ""), (r"\s*:\s*", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def normalize_for_match(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, PUNCTUATION + "+", " ")))


def loose_pattern(entity: Column) -> Column:
    """A pattern for a normalised entity with punctuation and space allowed between all its characters."""
    characters = F.filter(F.split(normalize_for_match(entity), ""), lambda c: (c != " ") & (c != ""))
    escaped = F.transform(characters, lambda c: F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.concat(F.lit("(?iu)"), F.array_join(escaped, PUNCTUATION + "*"))


def remap(predictions: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans of cleaned text (doc_id, page_index, label, span_text, score, start, stop) at their places in the page.

    Exact first, then without letter case, then without punctuation; the
    model's own place only if cleaning changed nothing; else the span goes.
    """
    met = predictions.join(pages.select(*PAGE, F.col("text").alias("page_text")), list(PAGE))
    page, entity = F.col("page_text"), F.col("span_text")
    exact, cased = F.instr(page, entity), F.instr(F.lower(page), F.lower(entity))
    pattern = loose_pattern(entity)
    loose = F.when(F.length(normalize_for_match(entity)) > 0, F.regexp_instr(page, pattern)).otherwise(0)
    start = F.when(exact > 0, exact - 1).when(cased > 0, cased - 1).when(loose > 0, loose - 1).when(strip_markdown(page) == page, F.col("start"))
    size = F.when((exact > 0) | (cased > 0), F.length(entity)).when(loose > 0, F.length(F.call_function("regexp_extract", page, pattern, F.lit(0)))).otherwise(F.col("stop") - F.col("start"))
    placed = met.withColumn("char_start", start).where("char_start is not null").withColumn("char_end", F.col("char_start") + size)
    return placed.select(*PAGE, "label", cut("page_text").alias("text"), "char_start", "char_end", "score")


def prompt_label(prompt: Column) -> Column:
    """A model's prompt word as a label; unknown ones are persons."""
    return F.coalesce(*[F.when(F.lower(prompt) == k, v) for k, v in PROMPTS.items()], F.lit("PERSON"))


def keep_plausible(results: DataFrame) -> DataFrame:
    return results.where((F.col("score") >= SCORE_FLOOR) & ~excluded(F.col("text"), F.col("label")))
