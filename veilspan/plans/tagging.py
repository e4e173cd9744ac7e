"""Catalogue: tags, rewriting, summaries, exports, redaction plans, and the flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as det
from ..operators import legacy, redaction
from ..operators import tagging as op
from ..schema import LABELS
from ..sources.tables import contract_pages, conversation_pages, document_pages, read
from . import duck
from .inputs import contract_spans, conversation_tokens, names


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents anonymised end to end: detect, resolve, tag, rewrite; a row for every document."""
    pages = document_pages(spark, sf_dir)
    spans = det.detect_resolved(pages)
    return op.anonymize(pages, op.tag_spans(spans)).drop("page_index", "text")


def contract_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the contracts, where every detector finds something."""
    pages, spans = contract_pages(spark, sf_dir), contract_spans(spark, sf_dir)
    return op.anonymize(pages, op.tag_spans(spans)).drop("page_index", "text")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tag_map(names(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = names(spark, sf_dir)
    return op.with_tags(spans, op.tag_map(spans))


def tag01_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", op.tag(label, F.col("o_orderkey")).alias("tag"), op.tag(label, F.col("o_orderkey"), brackets=False).alias("plain"))


def tag02_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("[PERSON_"), k, F.lit("]"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("[EMAIL_"), k, F.lit("]"))).otherwise(F.concat(F.lit("[person_"), k))
    label, number = op.parse_tag(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), number.alias("number"))


def tag03_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).withColumn("original_texts", F.concat_ws("|", "original_texts"))


def tag04_stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = names(spark, sf_dir).withColumn("ord", -F.col("ord"))
    return op.tag_map(spans, by_position=False, brackets=False).select("doc_id", "norm_text", "tag", "label", "n")


def tag05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = names(spark, sf_dir)
    return op.with_tags(spans, op.tag_map(spans.where("ord % 2 = 0"))).select("doc_id", "ord", "tag")


def tag06_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.anonymize(conversation_pages(spark, sf_dir), _tagged(spark, sf_dir)).drop("text")


def tag07_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entity_summary(_tags(spark, sf_dir))


def tag08_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unique_entities(_tags(spark, sf_dir))


def tag09_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tag_objects(_tags(spark, sf_dir)).select("doc_id", F.to_json("tag_map").alias("json"))


def tag10_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reverse_tags(_tags(spark, sf_dir)).withColumn("originals", F.concat_ws("|", "originals"))


def tag11_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.annotate_tokens(conversation_tokens(spark, sf_dir), _tagged(spark, sf_dir))


def tag12_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.by_confidence(names(spark, sf_dir), 0.7).select("doc_id", "ord", "text")


def tag13_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.by_confidence(names(spark, sf_dir).where("page_index = 1"), 0.6).select("doc_id", "ord", "text")


def tag14_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grouped_entities(names(spark, sf_dir)).withColumn("pages", F.concat_ws(",", F.transform("pages", lambda p: p.cast("string"))))


def tag15_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).groupBy("doc_id", "label").agg(F.count_distinct("norm_text").alias("texts"), F.count(F.lit(1)).alias("n"))


def tag16_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).groupBy("doc_id", "norm_text").agg(F.count(F.lit(1)).alias("n"))


def tag17_page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("p"))
    return pages.select("doc_id", op.page_list(F.col("p")).alias("shown"))


def tag19_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature regions with their rank by page."""
    from pyspark.sql import Window

    from .detection import src08_annotations

    return src08_annotations(spark, sf_dir).select("doc_id", "id", F.row_number().over(Window.partitionBy("label", "doc_id").orderBy("page_index", "id")).alias("rank"))


def tag20_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.next_occurrence(names(spark, sf_dir)).select("doc_id", "ord", "next_ord")


def tag21_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir).withColumn("ready", F.length("text") > 100)
    return pages.groupBy("doc_id").agg(F.count_if("ready").alias("done"), F.count(F.lit(1)).alias("pages"), F.bool_and("ready").alias("finished"))


def tag24_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by strategy (here: the label's source page parity): total, mean score, counts by type."""
    n = names(spark, sf_dir).withColumn("strategy", F.when(F.col("page_index") % 2 == 0, "simple").otherwise("first"))
    return n.groupBy("strategy").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("confidence"), 6).alias("mean"), *[F.count_if(F.col("label") == k).alias(k.lower()) for k in ("PERSON", "ORGANIZATION", "ADDRESS")])


def tag25_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for which two strategies (all names, sure names) list different texts."""
    listed = lambda df, c: df.groupBy("doc_id", "page_index").agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias(c))
    n = names(spark, sf_dir)
    met = listed(n, "a").join(listed(n.where("confidence >= 0.7"), "b"), ["doc_id", "page_index"], "full")
    return met.where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "page_index", "a", F.coalesce("b", F.lit("")).alias("b"))


def tag26_first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_tokens(spark, sf_dir).where("token_idx < 100").select("doc_id", "page_index", "token_idx", "text")


def tag27_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within one of page 2."""
    return conversation_pages(spark, sf_dir).where(F.col("page_index").between(1, 3)).select("doc_id", "page_index")


def snk01_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, pages = names(spark, sf_dir), conversation_pages(spark, sf_dir)
    tags = op.tag_map(spans)
    out = op.export_documents(pages, conversation_tokens(spark, sf_dir), op.with_tags(spans, tags), tags, F.lit("conversation.pdf"))
    j = F.col("json")
    return out.select("doc_id", "page_count", F.get_json_object(j, "$.pages[0].anonymized_text").alias("first"), F.get_json_object(j, "$.entity_summary.PERSON").cast("long").alias("persons"), F.get_json_object(j, "$.pages[0].spans[0].tag").alias("first_tag"))


def geo12_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redaction.drawings(_tagged(spark, sf_dir), conversation_tokens(spark, sf_dir))
    return d.select("doc_id", "page_index", "ord", "own_width", F.round("first.width", 6).alias("width"), "first.x", "first.y", F.size("lines").alias("n_lines"))


def _uncollided(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = conversation_tokens(spark, sf_dir), _tagged(spark, sf_dir)
    return redaction.without_collisions(redaction.drawings(s, t), redaction.free_tokens(s, t))


def geo13_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uncollided(spark, sf_dir).select("doc_id", "page_index", "ord", F.round("first.width", 6).alias("width"))


def geo14_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.text_layer(redaction.free_tokens(_tagged(spark, sf_dir), conversation_tokens(spark, sf_dir)))


def snk02_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.rectangles(_uncollided(spark, sf_dir)).select("doc_id", "page_index", "ord", "part", "tag", "bbox.x", F.round("bbox.width", 6).alias("width"))


def _page_key() -> Column:
    return F.col("doc_id") * 100 + F.col("page_index")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping entities, a page as a text of its own: names, and stretches of text around some."""
    n = names(spark, sf_dir).withColumn("doc_id", _page_key())
    base = n.select("doc_id", "ord", "char_start", "char_end", F.col("text").alias("original"), F.when(F.col("label") == "ADDRESS", "LIEU").otherwise("PERSONNE").alias("type"), F.when(F.col("ord") % 3 == 0, "high").when(F.col("ord") % 3 == 1, "medium").otherwise("low").alias("confidence"), F.lit("ml").alias("source"), F.col("confidence").alias("score"))
    pages = _texts(spark, sf_dir).withColumnRenamed("text", "page")
    wide = base.where("ord % 2 = 0").join(pages, "doc_id").withColumn("char_end", F.least(F.col("char_end") + 9, F.length("page"))).withColumn("original", F.substring(F.col("page"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("page")
    return base.unionByName(wide.select("doc_id", (F.col("ord") + 1000).alias("ord"), "char_start", "char_end", "original", "type", F.lit("medium").alias("confidence"), F.lit("regex").alias("source"), F.lit(None).cast("double").alias("score")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir).select(_page_key().alias("doc_id"), "text")


def leg01_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.detect_addresses(contract_pages(spark, sf_dir))


def leg02_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.merge_entities(_entities(spark, sf_dir), _texts(spark, sf_dir)).select("doc_id", "char_start", "char_end", "original", "type", "confidence")


def leg03_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second entity without its place, every seventh of another type."""
    e = _entities(spark, sf_dir)
    lost = F.when(F.col("ord") % 2 == 0, F.lit(None).cast("int"))
    e = e.withColumn("type", F.when(F.col("ord") % 7 == 0, "AUTRE").otherwise(F.col("type"))).withColumn("char_start", F.when(F.col("ord") % 2 == 0, lost).otherwise(F.col("char_start"))).withColumn("char_end", F.when(F.col("ord") % 2 == 0, lost).otherwise(F.col("char_end") - 2))
    return legacy.clean_model_entities(e, _texts(spark, sf_dir)).select("doc_id", "ord", "char_start", "char_end", "original")


def leg04_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return legacy.without_ignored(e, e.where("original like 'E%'").select(F.concat(F.lit(" "), F.lower("original")).alias("original"))).select("doc_id", "ord", "original")


def leg05_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.first_of_each(_entities(spark, sf_dir)).select("doc_id", "ord", "original")


def leg06_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = legacy.numbered(_entities(spark, sf_dir)).select("doc_id", "char_start", "char_end", "replacement")
    return legacy.earliest(occ).select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.*")


def leg07_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = legacy.numbered(_entities(spark, sf_dir)).select("doc_id", "char_start", "char_end", "replacement")
    return legacy.rewrite(legacy.earliest(occ), _texts(spark, sf_dir))


def leg08_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual entities in place of some, others removed."""
    e = _entities(spark, sf_dir)
    added = e.where("ord % 5 = 0").withColumn("ord", F.col("ord") + 5000).withColumn("type", F.lit("DATE"))
    return legacy.edited(e, added, e.where("ord % 5 = 1").select("doc_id", "ord")).select("doc_id", "ord", "type", "confidence")


def leg09_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir).withColumn("type", F.when(F.col("ord") % 4 == 0, "EMAIL").otherwise(F.col("type")))
    return legacy.numbered(e).select("doc_id", "ord", "replacement")


QUERIES = {"flagship_documents": flagship, "flagship_contracts": contract_flagship} | {k: v for k, v in globals().items() if callable(v) and k[:3] in ("tag", "geo", "snk", "leg") and k[3:5].isdigit()}

_N = duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, duck.TOKENS, duck.BOXED, duck.tag_map("names"))
_TAGGED = ", tagged as (select n.*, t.tag from names n join tags t using (doc_id, norm_text))"
_REWRITE = """select p.doc_id, {extra} coalesce(list_reduce(list_prepend({{'a': 0, 'b': 0, 'tag': p.text}}, s.items), lambda acc, x: {{'a': 0, 'b': 0, 'tag': acc.tag[1:x.a] || x.tag || acc.tag[x.b + 1:]}}).tag, p.text) as anonymized_text, coalesce(s.n, 0)::bigint as n_spans
from {pages} p left join (select doc_id, page_index, list(distinct {{'a': char_start, 'b': char_end, 'tag': tag}} order by {{'a': char_start, 'b': char_end, 'tag': tag}} desc) as items, count(*) as n from tagged group by all) s using (doc_id, page_index)"""
_DRAWN = """, lined as (select g.doc_id, g.page_index, g.ord, g.tag, p.y, min(p.x) as x, max(p.x + p.w) - min(p.x) as w from tagged g join boxed p on g.doc_id = p.doc_id and g.page_index = p.page_index and p.char_end > g.char_start and p.char_start < g.char_end group by all),
drawn as (select doc_id, page_index, ord, tag, max_by(x, y) as x, max(y) - 2 as y, max_by(w, y) as own, greatest(max_by(w, y), length(tag) * (7.0::double * 0.6::double) + 4) as wide, count(*) as n_lines from lined group by doc_id, page_index, ord, tag)"""
_FREE = ", free as (select * from boxed p where not exists (select 1 from tagged g where g.doc_id = p.doc_id and g.page_index = p.page_index and p.char_end > g.char_start and p.char_start < g.char_end))"
_CUT = _FREE + """, others as (select doc_id, page_index, ord as o, x, y, 14.0::double as h from drawn union all select doc_id, page_index, null, x, y, h from free),
cut as (select d.doc_id, d.page_index, d.ord, d.tag, d.x, d.y, d.own, case when d.wide > d.own and min(o.x) is not null then greatest(d.own, least(d.x + d.wide, min(o.x) - 1) - d.x) else d.wide end as width
  from drawn d left join others o on d.wide > d.own and d.doc_id = o.doc_id and d.page_index = o.page_index and (o.o is null or o.x > d.x or o.x = d.x and o.o > d.ord) and (o.o is null or o.o <> d.ord)
    and o.x >= d.x + d.own and abs(o.y + o.h / 2 - (d.y + 7)) <= 7 and o.x < d.x + d.wide and d.y < o.y + o.h and d.y + 14 > o.y group by d.doc_id, d.page_index, d.ord, d.tag, d.x, d.y, d.own, d.wide)"""
_LEG = duck.with_ctes(
    duck.CONVERSATIONS, duck.NAMES, "texts as (select doc_id * 100 + page_index as doc_id, text from convs)",
    "base as (select doc_id * 100 + page_index as doc_id, ord, char_start, char_end, text as original, case label when 'ADDRESS' then 'LIEU' else 'PERSONNE' end as type, case ord % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, 'ml' as source, confidence as score from names)",
    "entities as (select * from base union all select b.doc_id, ord + 1000, char_start, least(char_end + 9, length(text)), text[char_start + 1:least(char_end + 9, length(text))], type, 'medium', 'regex', null from base b join texts using (doc_id) where ord % 2 = 0)",
)
_PRIORITY = "(case {0}.confidence when 'manual' then 100 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end * 1000 + coalesce({0}.score, 0.5::double) * 100 + ({0}.e - {0}.s) + case when {0}.source = 'regex' and {0}.type = 'LIEU' then 500 else 0 end)"
_NUMBERED = ", numbered as (select *, '[' || type || '_' || row_number() over (partition by doc_id, type order by char_start, ord) || ']' as replacement from entities)"
_EARLIEST = _NUMBERED + ", swept as (select doc_id, list_reduce(list([{'char_start': char_start, 'char_end': char_end, 'replacement': replacement}] order by char_start, char_end, replacement), lambda acc, x: case when x[1].char_start >= acc[-1].char_end then list_concat(acc, x) else acc end) as kept from numbered group by 1)"
_FULL = legacy.ADDRESS.replace("(?iu)", "(?i)")
_SIMPLE = legacy.ADDRESS_SIMPLE.replace("(?iu)", "(?i)")

ORACLES = {
    "flagship_documents": duck.with_ctes(duck.DOCUMENTS, duck.detected("docs"), duck.resolved(), duck.tag_map(), "tagged as (select s.*, t.tag from spans s join tags t using (doc_id, norm_text))") + _REWRITE.format(extra="", pages="docs"),
    "flagship_contracts": duck.with_ctes(duck.CONTRACTS, duck.detected(), duck.resolved(), duck.tag_map(), "tagged as (select s.*, t.tag from spans s join tags t using (doc_id, norm_text))") + _REWRITE.format(extra="", pages="contracts"),
    "tag01_tags": "select o_orderkey, '[' || l || '_' || o_orderkey || ']' as tag, l || '_' || o_orderkey as plain from (select o_orderkey, ['PERSON', 'ORGANIZATION', 'ADDRESS', 'DATE', 'IDENTIFIER'][o_orderkey % 5 + 1] as l from orders)",
    "tag02_parse": "select o_orderkey, case o_orderkey % 3 when 0 then 'PERSON' when 1 then 'IDENTIFIER' end as label, case when o_orderkey % 3 < 2 then o_orderkey end as number from orders",
    "tag03_tag_map": _N + "select doc_id, norm_text, tag, label, array_to_string(original_texts, '|') as original_texts, n from tags",
    "tag04_stored_order": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, duck.tag_map("names", order="-ord", brackets=False)) + "select doc_id, norm_text, tag, label, n from tags",
    "tag05_lookup": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, "half as (select * from names where ord % 2 = 0)", duck.tag_map("half")) + "select doc_id, ord, coalesce(tag, '[LABEL_UNKNOWN]') as tag from names left join tags using (doc_id, norm_text)",
    "tag06_anonymize": _N + _TAGGED + _REWRITE.format(extra="p.page_index,", pages="convs"),
    "tag07_summary": _N + "select doc_id, label, sum(n)::bigint as n from tags group by all",
    "tag08_unique": _N + "select doc_id, label, count(*)::bigint as n from tags group by all",
    "tag09_objects": _N + """select doc_id, '{' || string_agg('"' || norm_text || '":{"tag":"' || tag || '","label":"' || label || '","n":' || n || '}', ',' order by norm_text) || '}' as json from tags group by 1""",
    "tag10_reverse": _N + "select doc_id, tag, array_to_string(original_texts, '|') as originals from tags",
    "tag11_annotate": _N + _TAGGED + ", found as (select t.doc_id, t.page_index, t.token_idx, min_by(g.tag, g.ord) as tag, min_by(g.label, g.ord) as label from tokens t join tagged g on t.doc_id = g.doc_id and t.page_index = g.page_index and t.char_start >= g.char_start and t.char_end <= g.char_end group by all) select t.doc_id, t.page_index, t.token_idx, t.text, coalesce(f.tag, t.text) as anonymized_text, f.tag is not null as is_entity, f.label as entity_label from tokens t left join found f using (doc_id, page_index, token_idx)",
    "tag12_confidence": _N + "select doc_id, ord, text from names where confidence >= 0.7::double",
    "tag13_page_spans": _N + "select doc_id, ord, text from names where confidence >= 0.6::double and page_index = 1",
    "tag14_groups": _N + "select doc_id, label, norm_text, min_by(text, ord) as text, count(*)::bigint as n, array_to_string(list_sort(list_distinct(list(page_index))), ',') as pages, list_position(['PERSON', 'ORGANIZATION', 'ADDRESS', 'DATE', 'IDENTIFIER'], label)::int as label_ord from names group by doc_id, label, norm_text",
    "tag15_distinct": _N + "select doc_id, label, count(distinct norm_text)::bigint as texts, count(*)::bigint as n from names group by all",
    "tag16_instances": _N + "select doc_id, norm_text, count(*)::bigint as n from names group by all",
    "tag17_page_list": _N + "select doc_id, 'p' || array_to_string(list_transform(p[1:5], lambda x: x + 1), ',') || case when len(p) > 5 then '...' else '' end as shown from (select doc_id, list_sort(list_distinct(list(page_index))) as p from convs group by 1)",
    "tag19_regions": "select * from (select doc_id, id, row_number() over (partition by doc_id order by page_index, id)::int as rank from (REGIONS))",
    "tag20_next": _N + "select doc_id, ord, coalesce(lead(ord) over w, first_value(ord) over w) as next_ord from names window w as (partition by doc_id, norm_text order by page_index, char_start, ord)",
    "tag21_progress": _N + "select doc_id, count(*) filter (where length(text) > 100)::bigint as done, count(*)::bigint as pages, bool_and(length(text) > 100) as finished from convs group by 1",
    "tag24_strategies": _N + "select case page_index % 2 when 0 then 'simple' else 'first' end as strategy, count(*)::bigint as total, round(avg(confidence), 6) as mean, count(*) filter (where label = 'PERSON')::bigint as person, count(*) filter (where label = 'ORGANIZATION')::bigint as organization, count(*) filter (where label = 'ADDRESS')::bigint as address from names group by 1",
    "tag25_difference": _N + ", a as (select doc_id, page_index, string_agg(text, ', ' order by text) as a, coalesce(string_agg(text, ', ' order by text) filter (where confidence >= 0.7::double), '') as b from names group by all) select * from a where a <> b",
    "tag26_first_tokens": _N + "select doc_id, page_index, token_idx, text from tokens where token_idx < 100",
    "tag27_visible": _N + "select doc_id, page_index from convs where page_index between 1 and 3",
    "snk01_export": _N + _TAGGED + ", rewritten as (" + _REWRITE.format(extra="p.page_index,", pages="convs") + ") select r.doc_id, (select count(*) from convs c where c.doc_id = r.doc_id)::bigint as page_count, anonymized_text as first, (select sum(n) from tags t where t.doc_id = r.doc_id and label = 'PERSON')::bigint as persons, (select min_by(tag, ord) from tagged g where g.doc_id = r.doc_id and page_index = 0) as first_tag from rewritten r where page_index = 0",
    "geo12_drawings": _N + _TAGGED + _DRAWN + " select doc_id, page_index, ord, own as own_width, round(wide, 6) as width, x, y, n_lines::int as n_lines from drawn",
    "geo13_collisions": _N + _TAGGED + _DRAWN + _CUT + " select doc_id, page_index, ord, round(width, 6) as width from cut",
    "geo14_text_layer": _N + _TAGGED + _FREE + r" select doc_id, page_index, token_idx, t as text, 8.0::double as font_size from (select *, regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), '[^\x20-\x7E\x{A0}-\x{FF}]', '?', 'g') as t from free) where length(trim(t)) > 0",
    "snk02_plan": _N + _TAGGED + _DRAWN + _CUT + " select doc_id, page_index, ord, 0 as part, tag, x, round(width, 6) as width from cut union all select doc_id, page_index, ord, (k - 1)::int, null, x, round(w, 6) from (select *, row_number() over (partition by doc_id, page_index, ord order by y desc) as k from lined) where k > 1",
    "leg01_addresses": duck.with_ctes(duck.CONTRACTS, f"full_ as ({duck.matches('contracts', _FULL)})", f"simple as ({duck.matches('contracts', _SIMPLE)})") + "select doc_id, (row_number() over (partition by doc_id order by q, n) - 1)::int as ord, char_start, char_end, trim(text) as original, case q when 0 then 'high' else 'medium' end as confidence, 'ADRESSE' as type, 'regex' as source from (select 0 as q, * from full_ union all select 1, * from simple s where not exists (select 1 from full_ f where f.doc_id = s.doc_id and (s.char_start >= f.char_start and s.char_start < f.char_end or s.char_end > f.char_start and s.char_end <= f.char_end)))",
    "leg02_merge": _LEG
    + ", ranked as (select doc_id, text, list([{'s': char_start, 'e': char_end, 'original': original, 'type': type, 'confidence': confidence, 'source': source, 'score': score}] order by char_start, case confidence when 'manual' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, ord) as items from entities join texts using (doc_id) group by all),\n"
    + "folded as (select doc_id, list_reduce(items, lambda acc, x: case when x[1].s >= acc[-1].e then list_concat(acc, x) else list_concat(acc[1:-2], list_transform([case when " + _PRIORITY.format("x[1]") + " > " + _PRIORITY.format("acc[-1]") + " then x[1] else acc[-1] end], lambda won: case when x[1].e > won.e and x[1].type = won.type then {'s': won.s, 'e': x[1].e, 'original': text[won.s + 1:x[1].e], 'type': won.type, 'confidence': won.confidence, 'source': won.source, 'score': won.score} else won end)) end) as kept from ranked)\n"
    + "select doc_id, k.s as char_start, k.e as char_end, k.original as original, k.type as type, k.confidence as confidence from (select doc_id, unnest(kept) as k from folded)",
    "leg03_clean": _LEG
    + ", placed as (select b.doc_id, ord, text, type, case when ord % 2 = 0 then instr(lower(text), lower(original)) - 1 else char_start end as a, case when ord % 2 = 0 then instr(lower(text), lower(original)) - 1 + length(original) else char_end - 2 end as b from entities b join texts using (doc_id) where ord % 7 <> 0),\n"
    + r"wide as (select *, a - length(regexp_extract(text[1:a], '[^\s.,;:!?()\[\]{}\"«»–—/\\-]*$')) as a2, b + length(regexp_extract(text[b + 1:], '^[^\s.,;:!?()\[\]{}\"«»–—/\\-]*')) as b2 from placed where a >= 0), "
    + r"num as (select *, case type when 'LIEU' then length(regexp_extract(text[greatest(a2 - 9, 1):a2], '[0-9]{2,5}\s*$')) else 0 end as k from wide) select doc_id, ord, (a2 - k)::int as char_start, b2::int as char_end, text[a2 - k + 1:b2] as original from num",
    "leg04_ignored": _LEG + "select doc_id, ord, original from entities where original not like 'E%' and not exists (select 1 from entities x where x.original like 'E%' and lower(trim(x.original)) = lower(trim(entities.original)))",
    "leg05_first": _LEG + "select doc_id, ord, original from entities qualify row_number() over (partition by doc_id, lower(trim(original)) order by char_start, ord) = 1",
    "leg06_occurrences": _LEG + _EARLIEST + " select doc_id, k.char_start as char_start, k.char_end as char_end, k.replacement as replacement from (select doc_id, unnest(kept) as k from swept)",
    "leg07_rewrite": _LEG + _EARLIEST + " select t.doc_id, coalesce(list_reduce(list_prepend({'char_start': 0, 'char_end': 0, 'replacement': t.text}, list_reverse(kept)), lambda acc, x: {'char_start': 0, 'char_end': 0, 'replacement': acc.replacement[1:x.char_start] || x.replacement || acc.replacement[x.char_end + 1:]}).replacement, t.text) as anonymized_text from texts t left join swept using (doc_id)",
    "leg08_manual": _LEG + ", added as (select doc_id, ord + 5000 as ord, char_start, char_end, 'DATE' as type from entities where ord % 5 = 0) select doc_id, ord, type, confidence from entities e where ord % 5 <> 1 and not exists (select 1 from added a where a.doc_id = e.doc_id and a.char_start = e.char_start and a.char_end = e.char_end) union all select doc_id, ord, type, 'manual' from added",
    "leg09_numbered": _LEG + ", typed as (select * replace (case when ord % 4 = 0 then 'EMAIL' else type end as type) from entities) select doc_id, ord, case type when 'EMAIL' then '[EMAIL]' else '[' || type || '_' || row_number() over (partition by doc_id, type order by char_start, ord) || ']' end as replacement from typed",
}


def _with_regions() -> None:
    from .detection import ORACLES as detection

    ORACLES["tag19_regions"] = ORACLES["tag19_regions"].replace("REGIONS", detection["src08_annotations"])


_with_regions()
assert set(ORACLES) == set(QUERIES), set(QUERIES) ^ set(ORACLES)
