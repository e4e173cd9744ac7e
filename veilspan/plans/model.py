"""Catalogue: post-processing of token classification.

Token probabilities are integers over 100 that follow from a token's place and
length, so both engines start from the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, table_functions
from ..operators import ner as op
from ..sources.tables import conversation_pages, document_pages, read, spread, tokens
from . import duck

TAGS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation tokens with probabilities, tags and word starts."""
    t = tokens(conversation_pages(spark, sf_dir))
    n, k = F.col("char_end") - F.col("char_start"), F.col("token_idx")
    p = {"p_per": (n * 37 + k * 3) % 101, "p_org": (n * 11 + k * 7) % 83, "p_loc": (n * 23 + k * 5) % 97, "p_misc": (n + k) % 40, "p_o": (n * 3 + k) % 60}
    bio = F.element_at(F.array(*map(F.lit, ("B-PER", "I-PER", "O", "I-LOC"))), (k % 4 + 1).cast("int"))
    return t.withColumns({c: (v / 100.0) for c, v in p.items()}).withColumn("bio_tag", bio).withColumn("is_word_start", k % 5 != 2)


def ner01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_into_chunks(document_pages(spark, sf_dir)).select("doc_id", "chunk", "start", F.length("text").alias("n_chars"))


def ner01_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks by the table function, in SQL."""
    table_functions.register(spark)
    document_pages(spark, sf_dir).createOrReplaceTempView("pages_to_chunk")
    return spark.sql("select doc_id, chunk, start, length(text) as n_chars from chunks(table(pages_to_chunk))")


def ner22_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words by a detector that is registered for SQL."""
    table_functions.register_detector(spark, "capitalised", lambda text: [("PERSON", 0.5, m.start(), m.end()) for m in re.finditer(duck.NAMES_PATTERN, text)])
    conversation_pages(spark, sf_dir).createOrReplaceTempView("pages_to_read")
    return spark.sql("select doc_id, page_index, ord, text, char_start, char_end from capitalised(table(pages_to_read))")


def _logits() -> Column:
    return F.array(*[((F.col("o_orderkey") * (3 + k) + k * k) % 7).cast("double") for k in range(len(TAGS))])





def ner02_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = op.softmax(_logits())
    return read(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(p).alias("k", "p")).withColumn("p", F.round("p", 6))


def ner03_base_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, TAGS))
    b = op.base_probabilities(_logits(), labels)
    return read(spark, sf_dir, "orders").select("o_orderkey", b.alias("b")).select("o_orderkey", "b.*")


def ner04_winning_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", op.winning_tag(_logits(), F.array(*map(F.lit, TAGS))).alias("tag"))


def ner05_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation tokens cut in two subwords each, found again in their pages."""
    t = tokens(conversation_pages(spark, sf_dir))
    half = F.ceil(F.length("text") / 2).cast("int")
    parts = F.filter(F.array(F.struct(F.substring(F.col("text"), F.lit(1), half).alias("word"), F.lit(True).alias("is_word_start")), F.struct(F.substring(F.col("text"), half + 1, F.length("text")).alias("word"), F.lit(False).alias("is_word_start"))), lambda p: F.length(p["word"]) > 0)
    sub = t.select("doc_id", "page_index", "token_idx", F.posexplode(parts).alias("half", "p")).select("doc_id", "page_index", (F.col("token_idx") * 2 + F.col("half")).alias("token_idx"), "p.word", "p.is_word_start")
    return op.align(sub, conversation_pages(spark, sf_dir)).withColumn("token_idx", F.col("token_idx").cast("int"))


def ner06_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.decide_labels(_scored(spark, sf_dir)).select("doc_id", "page_index", "token_idx", "winner", "winner_p")


def ner07_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.group_tokens(op.decide_labels(_scored(spark, sf_dir))).select("doc_id", "page_index", "char_start", "char_end", "base", "n_tokens")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.finalize(op.group_tokens(op.decide_labels(_scored(spark, sf_dir))), conversation_pages(spark, sf_dir))


def ner08_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("doc_id", "page_index", "char_start", "char_end", "base", "text", F.round(op.max_probability(), 6).alias("p"))


def ner09_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the middle of each text to the word around it."""
    p = document_pages(spark, sf_dir).withColumn("middle", F.floor(F.length("text") / 2).cast("int"))
    a, b = op.expand_to_words(F.col("text"), F.col("middle"), F.col("middle"))
    return p.select("doc_id", a.alias("char_start"), b.alias("char_end"))


def ner10_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_false_positives(_entities(spark, sf_dir)).select("doc_id", "page_index", "char_start", "char_end", "base")


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and persons in texts that name streets, dates and people, one text per customer."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Le 15 mars 2024, vu au "), k, F.when(F.col("c_custkey") % 2 == 0, " bis, ").otherwise(", "), F.lit("rue des Lilas, 75012 Paris chez Jean - Marie Dupont, le 3 mai 2023 Rochepot"))
    c = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), text.alias("page_text"), (F.lit(23) + F.length(k) + F.when(F.col("c_custkey") % 2 == 0, 6).otherwise(2)).alias("o"))
    at = lambda a, b, base, n: F.struct((F.col("o") + a).alias("char_start"), (F.col("o") + b).alias("char_end"), F.lit(base).alias("base"), F.lit(n).alias("n_tokens"))
    items = F.array(at(0, 3, "LOC", 1), at(8, 13, "LOC", 2), at(21, 26, "LOC", 1), at(32, 36, "PER", 1), at(39, 44, "PER", 2), at(45, 51, "PER", 1), at(68, 76, "LOC", 1))
    each = c.select("doc_id", "page_index", "page_text", F.posexplode(items).alias("i", "e")).select("doc_id", "page_index", "page_text", "i", "e.*")
    return each.withColumns({"p_per": (F.col("i") + 3) / 10.0, "p_org": F.lit(0.05), "p_loc": (F.col("i") + 4) / 10.0, "p_misc": F.lit(0.0), "p_o": F.lit(0.1)}).withColumn("n_tokens", F.col("n_tokens").cast("long")).withColumn("text", op.cut("page_text")).drop("i")


_SHOWN = ("doc_id", "char_start", "char_end", "base", "text")


def ner11_expand_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.expand_addresses(_addressed(spark, sf_dir)).select(*_SHOWN)


def ner12_merge_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_addresses(_addressed(spark, sf_dir)).select(*_SHOWN, "n_tokens", F.round("p_loc", 6).alias("p_loc"))


def ner13_merge_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_persons(_addressed(spark, sf_dir)).select(*_SHOWN, "n_tokens", F.round("p_per", 6).alias("p_per"))


def ner14_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third entity as MISC, which takes the best other type or goes."""
    e = _entities(spark, sf_dir).withColumn("base", F.when(F.col("char_start") % 3 == 0, "MISC").otherwise(F.col("base")))
    return op.to_results(e, F.lit(100)).withColumn("score", F.round("score", 6)).select("doc_id", "page_index", "label", "char_start", "char_end", "score")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.to_results(op.filter_false_positives(_entities(spark, sf_dir)))


def ner15_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    # each result and, of every second place, a longer and surer one: from one row, so that the results are computed once
    longer = F.when(F.col("char_start") % 2 == 0, F.struct((F.col("char_end") + 2).alias("char_end"), (F.col("score") + 0.01).alias("score")))
    every = r.withColumn("e", F.explode(F.array_compact(F.array(F.struct("char_end", "score"), longer)))).select(*[F.col(f"e.{c}" if c in ("char_end", "score") else c).alias(c) for c in r.columns])
    return op.deduplicate_results(every).withColumn("score", F.round("score", 6)).select("doc_id", "page_index", "char_start", "char_end", "label", "score")


def ner16_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.predict(_scored(spark, sf_dir), conversation_pages(spark, sf_dir)).withColumn("score", F.round("score", 6))


def halves(text: Column) -> Column:
    """A stand-in for a model: words cut in two, with logits that follow from a token's place and length."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")

    def cut_in_two(w: Column, k: Column) -> Column:
        half = F.ceil(F.length(w) / 2).cast("int")
        logits = F.array(*[((F.length(w) * (3 + j) + k * (j % 4) + j * j) % 7 * 1.5).cast("double") for j in range(len(TAGS))])
        part = lambda t, starts: F.struct(t.alias("word"), F.lit(starts).alias("is_word_start"), logits.alias("logits"))
        return F.array(part(F.substring(w, F.lit(1), half), True), part(F.substring(w, half + 1, F.length(w)), False))

    return F.filter(F.flatten(F.transform(words, cut_in_two)), lambda t: t["word"] != "")


def ner16_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through chunks, stand-in model, alignment, entities and deduplication."""
    results = op.predict_pages(document_pages(spark, sf_dir), halves, F.array(*map(F.lit, TAGS)))
    return results.withColumn("score", F.round("score", 6))


def ner17_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.results_to_spans(_results(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def ner18_strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## Titre: **gras**\n- point\n---\n"), "text")
    return document_pages(spark, sf_dir).select("doc_id", cleaning.strip_markdown(text).alias("plain"))


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    text = F.concat(F.lit("Vu **Société « "), "c_name", F.lit(" »**, à\nParis (75)."))
    pages = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), text.alias("text"))
    m = F.col("c_custkey") % 4
    span = F.when(m == 0, F.col("c_name")).when(m == 1, F.upper("c_name")).when(m == 2, F.lit("Paris 75")).otherwise(F.lit("Absent"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("PERSON").alias("label"), span.alias("span_text"), (F.col("c_custkey") % 10 / 10.0).alias("score"), F.lit(1).alias("start"), F.lit(4).alias("stop")), pages


def ner19_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.remap(*_predictions(spark, sf_dir)).select("doc_id", "text", "char_start", "char_end", "score")


def ner20_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", cleaning.normalize_for_match(F.col("text")).alias("norm"))


def ner21_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("Person name and surname", "organization and company", "address and location", "misc"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", op.prompt_label(word).alias("label"))


def ner22_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results at or above the floor that are no document ids."""
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ABCD-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).otherwise(F.col("c_name"))
    r = read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.lit("PERSON").alias("label"), (F.col("c_custkey") % 20 / 100.0).alias("score"))
    return op.keep_plausible(r)


def ner23_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results at or above the floor."""
    return read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 20 / 100.0).alias("score")).where(F.col("score") >= op.SCORE_FLOOR)


QUERIES = {k: v for k, v in globals().items() if callable(v) and k.startswith("ner")}

_N = "(char_end - char_start)"
_SC = f"scored as (select *, ({_N} * 37 + token_idx * 3) % 101 / 100.0::double as p_per, ({_N} * 11 + token_idx * 7) % 83 / 100.0::double as p_org, ({_N} * 23 + token_idx * 5) % 97 / 100.0::double as p_loc, ({_N} + token_idx) % 40 / 100.0::double as p_misc, ({_N} * 3 + token_idx) % 60 / 100.0::double as p_o, ['B-PER', 'I-PER', 'O', 'I-LOC'][token_idx % 4 + 1] as bio_tag, token_idx % 5 <> 2 as is_word_start from tokens)"
_DEC = """best as (select *, greatest(p_per, p_org, p_loc) as b from scored),
named as (select *, case when b <= 0 then 'O' when p_per = b then 'PER' when p_org = b then 'ORG' else 'LOC' end as l from best),
decided as (select *, case when l <> 'O' and b >= case l when 'ORG' then 0.7::double else 0.6::double end then l else 'O' end as winner from named)"""
_GRP = """steps as (select *, lag(winner) over w as before, char_start - lag(char_end) over w as gap from decided window w as (partition by doc_id, page_index order by token_idx)),
runs as (select *, sum(case when winner = before and (bio_tag like 'I-%' or not is_word_start and bio_tag not like 'B-%' or not is_word_start and gap <= 1 or winner = 'PER' and gap <= 2) then 0 else 1 end) over (partition by doc_id, page_index order by token_idx) as run from steps),
grouped as (select doc_id, page_index, run, min(char_start) as s, max(char_end) as e, min(winner) as base, count(*)::bigint as n_tokens, avg(p_per) as p_per, avg(p_org) as p_org, avg(p_loc) as p_loc from runs where winner <> 'O' group by all)"""
_DELIMS = r"\s.,;:!?()\[\]{}\"«»–—/\\-"
_FIN = rf"""final as (select g.*, c.text as page, s - length(regexp_extract(c.text[1:s], '[^{_DELIMS}]*$')) as char_start, e + length(regexp_extract(c.text[e + 1:], '^[^{_DELIMS}]*')) as char_end from grouped g join convs c using (doc_id, page_index)),
entities as (select *, page[char_start + 1:char_end] as text, case base when 'PER' then p_per when 'ORG' then p_org else p_loc end as p from final)"""
_BASE = duck.with_ctes(duck.CONVERSATIONS, duck.TOKENS, _SC, _DEC, _GRP, _FIN)
_STOP = ", ".join("'" + w + "'" for w in op.STOP_WORDS)
_MONTHS = ", ".join(f"'{m}'" for m in ("janvier", "février", "fevrier", "mars", "avril", "mai", "juin", "juillet", "août", "aout", "septembre", "octobre", "novembre", "décembre", "decembre"))
_T = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_KEPT = rf", clean as (select * from entities where not (length({_T}) <= 1 or lower({_T}) in ({_STOP}) or regexp_matches({_T}, '^[\d\s.,;:!?\x27\x22()-]+$') or length({_T}) <= 2 and p < 0.9::double or base = 'PER' and (lower({_T}) in ({_MONTHS}) or regexp_matches({_T}, '^(19|20)[0-9]{{2}}$'))))"
_RESULTS = _KEPT + ", results as (select doc_id, page_index, case base when 'PER' then 'PERSON' when 'ORG' then 'ORGANIZATION' else 'ADDRESS' end as label, text, char_start::int as char_start, char_end::int as char_end, p as score from clean)"
_LOGITS = "logits as (select o_orderkey, [" + ", ".join(f"((o_orderkey * {3 + k} + {k * k}) % 7)::double" for k in range(len(TAGS))) + "] as l from orders)"
_TEXT = "'Le 15 mars 2024, vu au ' || c_custkey || case c_custkey % 2 when 0 then ' bis, ' else ', ' end || 'rue des Lilas, 75012 Paris chez Jean - Marie Dupont, le 3 mai 2023 Rochepot'"
_ADDR = f"""with c as (select c_custkey as doc_id, {_TEXT} as page, 23 + length(c_custkey::varchar) + case c_custkey % 2 when 0 then 6 else 2 end as o from customer),
e as (select c.*, i, (o + [0, 8, 21, 32, 39, 45, 68][i + 1])::int as char_start, (o + [3, 13, 26, 36, 44, 51, 76][i + 1])::int as char_end, ['LOC', 'LOC', 'LOC', 'PER', 'PER', 'PER', 'LOC'][i + 1] as base, [1, 2, 1, 1, 2, 1, 1][i + 1] as n from c, generate_series(0, 6) as g(i))
"""


def _merged(group: str, column: str, offset: str) -> str:
    return f", g as (select *, case when i in ({group}) then {group.split(',')[0]} else i end as r from e) select doc_id, min(char_start)::int as char_start, max(char_end)::int as char_end, min(base) as base, min(page)[min(char_start) + 1:max(char_end)] as text, sum(n)::bigint as n_tokens, round(sum((i + {offset}) / 10.0::double * n) / sum(n), 6) as {column} from g group by doc_id, r"


ORACLES = {
    "ner22_sql": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES) + "select doc_id, page_index, row_number() over (partition by doc_id, page_index order by char_start) - 1 as ord, text, char_start, char_end from names",
    "ner02_softmax": "with " + _LOGITS + " select o_orderkey, (k - 1)::int as k, round(exp(l[k] - list_max(l)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 6) as p from (select *, unnest(generate_series(1, 9)) as k from logits)",
    "ner03_base_sums": "with " + _LOGITS + " select o_orderkey, l[2] + l[3] as p_per, l[4] + l[5] as p_org, l[6] + l[7] as p_loc, l[8] + l[9] as p_misc, l[1] as p_o from logits",
    "ner04_winning_tag": "with " + _LOGITS + " select o_orderkey, [" + ", ".join(f"'{t}'" for t in TAGS) + "][list_position(l, list_max(l))] as tag from logits",
    "ner05_align": _BASE + "select doc_id, page_index, (token_idx * 2 + h)::int as token_idx, case h when 0 then text[1:k] else text[k + 1:] end as word, (case h when 0 then char_start else char_start + k end)::int as char_start, (case h when 0 then char_start + k else char_end end)::int as char_end from (select *, ceil(length(text) / 2.0)::int as k, unnest([0, 1]) as h from tokens) where h = 0 or length(text) > 1",
    "ner06_decide": _BASE + "select doc_id, page_index, token_idx, winner, case winner when 'O' then p_o else b end as winner_p from decided",
    "ner07_group": _BASE + "select doc_id, page_index, s as char_start, e as char_end, base, n_tokens from grouped",
    "ner08_finalize": _BASE + "select doc_id, page_index, char_start::int as char_start, char_end::int as char_end, base, text, round(p, 6) as p from entities",
    "ner09_expand": duck.with_ctes(duck.DOCUMENTS) + rf"select doc_id, (m - length(regexp_extract(text[1:m], '[^{_DELIMS}]*$')))::int as char_start, (m + length(regexp_extract(text[m + 1:], '^[^{_DELIMS}]*')))::int as char_end from (select *, length(text) // 2 as m from docs)",
    "ner10_filter": _BASE + _KEPT[2:].replace("clean as", ", clean as", 1) + " select doc_id, page_index, char_start::int as char_start, char_end::int as char_end, base from clean",
    "ner11_expand_addresses": _ADDR + "select doc_id, a::int as char_start, char_end, base, page[a + 1:char_end] as text from (select *, case i when 0 then 23 when 2 then o + 15 else char_start end as a from e)",
    "ner12_merge_addresses": _ADDR + _merged("0,1,2", "p_loc", "4"),
    "ner13_merge_persons": _ADDR + _merged("3,4,5", "p_per", "3"),
    "ner14_results": _BASE
    + ", m as (select *, case when p_per >= 0.6::double then p_per else 0 end as a, case when p_org >= 0.7::double then p_org else 0 end as b, case when p_loc >= 0.6::double then p_loc else 0 end as c, char_start % 3 = 0 as misc from entities), s as (select *, case when not misc then base when greatest(a, b, c) <= 0 then null when a = greatest(a, b, c) then 'PER' when b = greatest(a, b, c) then 'ORG' else 'LOC' end as k from m) select doc_id, page_index, case k when 'PER' then 'PERSON' when 'ORG' then 'ORGANIZATION' else 'ADDRESS' end as label, (char_start + 100)::int as char_start, (char_end + 100)::int as char_end, round(case k when 'PER' then p_per when 'ORG' then p_org else p_loc end, 6) as score from s where k is not null",
    "ner15_deduplicate": _BASE + _RESULTS
    + ", every as (select * from results union all select doc_id, page_index, label, text, char_start, char_end + 2, score + 0.01::double from results where char_start % 2 = 0), swept as (select doc_id, page_index, list_reduce(list([{'s': char_start, 'e': char_end, 'l': label, 't': lower(text), 'p': score}] order by char_start, char_end, label, text, score), lambda acc, x: case when not (acc[-1].e > x[1].s or acc[-1].t = x[1].t) then list_concat(acc, x) when x[1].p > acc[-1].p then list_concat(acc[1:-2], x) else acc end) as kept from every group by all) select doc_id, page_index, k.s as char_start, k.e as char_end, k.l as label, round(k.p, 6) as score from (select doc_id, page_index, unnest(kept) as k from swept)",
    "ner17_spans": _BASE + _RESULTS + f" select doc_id, page_index, label, text, {duck.norm('text')} as norm_text, round(score, 6) as confidence, 'ner' as source, char_start, char_end from results",
    "ner18_strip_markdown": duck.with_ctes(duck.DOCUMENTS)
    + r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace('## Titre: **gras**' || chr(10) || '- point' || chr(10) || '---' || chr(10) || text, '**', ''), '*', ''), '__', ''), '#{1,6}\s*', '', 'g'), '---+', ' ', 'g'), '\*\*\*+', ' ', 'g'), '(?m)^[-*+]\s+', '', 'g'), '\s*:\s*', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as plain from docs",
    "ner19_remap": "with t as (select c_custkey, c_name, 'Vu **Société « ' || c_name || ' »**, à' || chr(10) || 'Paris (75).' as text from customer) select c_custkey as doc_id, case c_custkey % 4 when 2 then 'Paris (75' else c_name end as text, (case c_custkey % 4 when 2 then instr(text, 'Paris') else instr(text, c_name) end - 1)::int as char_start, (case c_custkey % 4 when 2 then instr(text, 'Paris') + 8 else instr(text, c_name) - 1 + length(c_name) end)::int as char_end, c_custkey % 10 / 10.0::double as score from t where c_custkey % 4 < 3",
    "ner20_normalize": duck.with_ctes(duck.DOCUMENTS) + r"select doc_id, lower(regexp_replace(regexp_replace(text, '[.,;:!?\x27\x22()\[\]«»\s–—-]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) as norm from docs",
    "ner21_prompts": "select o_orderkey, ['PERSON', 'ORGANIZATION', 'ADDRESS', 'PERSON'][o_orderkey % 4 + 1] as label from orders",
    "ner23_floor": "select c_custkey, c_custkey % 20 / 100.0::double as score from customer where c_custkey % 20 >= 5",
    "ner22_plausible": "select c_custkey, c_name as text, 'PERSON' as label, c_custkey % 20 / 100.0::double as score from customer where c_custkey % 3 <> 0 and c_custkey % 20 >= 5",
}
