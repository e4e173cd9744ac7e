"""Catalogue: sources, detectors, signature rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import siren_checksum
from ..operators import detect as op
from ..operators import signatures
from ..sources import document_store, readers, sinks
from ..sources.tables import contract_pages, conversation_pages, document_pages, read, tokens
from . import duck
from .inputs import RULES_SQL, conversation_tokens, names, rules, shared_path

_IDS = ("det01_email", "det02_phone_fr", "det03_phone_intl", "det04_iban", "det05_siret", "det06_siren", "det07_capital", "det08_docusign", "det09_date_numeric", "det10_date_written", "det11_address", "det12_postal_city")
_OUT = ("doc_id", "n", "text", "char_start", "char_end")


def _detector_query(d: op.Detector):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.run_detector(contract_pages(spark, sf_dir), d).select(*_OUT)

    return query


def src02_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir).where("page_index = 1")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations as positioned items whose heights waver by up to three."""
    t = conversation_tokens(spark, sf_dir)
    return t.select("doc_id", "page_index", F.col("token_idx").alias("idx"), F.col("text").alias("str"), (480.0 - F.col("bbox.x")).alias("x"), (F.col("bbox.y") + F.col("token_idx") % 4).alias("y"), F.lit(800.0).alias("page_height"))


def src03_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.extract_pages(_items(spark, sf_dir))
    return found.select("doc_id", "page_index", "text", F.size("places").alias("n"), F.element_at("places", -1)["start"].alias("last_start"))


def src04_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "str"))).alias("items"), F.first("page_height").alias("h"))
    return items.select("doc_id", "page_index", F.array_join(F.transform(readers.reading_order(F.col("items"), F.col("h")), lambda o: o["str"]), " ").alias("ordered"))


def src05_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_discount"), F.lit(0.0), F.lit(0.0), -F.col("l_tax"), F.col("l_quantity"), F.col("l_extendedprice")).alias("t"), "l_quantity")
    b = readers.transform_box(F.col("t"), F.col("l_quantity"), F.col("l_linenumber") % 2 * 10.0)
    return li.withColumn("b", b).select("l_orderkey", "l_linenumber", "b.x", "b.y", F.round("b.width", 6).alias("width"), F.round("b.height", 6).alias("height"))


def src06_needs_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir)
    n = F.regexp_count("text", F.lit(r"\S+"))
    return pages.select("doc_id", readers.needs_recognition(F.col("text"), n).alias("needed"))


def src07_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(conversation_pages(spark, sf_dir))


def src07_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_tokens(spark, sf_dir)
    words = t.select("doc_id", "page_index", F.col("token_idx").alias("idx"), F.col("text").alias("word"), (F.col("bbox.x") * 2).alias("x0"), (1600 - (F.col("bbox.y") + 10) * 2).alias("y0"), ((F.col("bbox.x") + F.col("bbox.width")) * 2).alias("x1"), (1600 - F.col("bbox.y") * 2).alias("y1"), F.lit(800.0).alias("page_height"))
    return readers.recognised_tokens(words, 2.0).select("doc_id", "page_index", "id", "char_start", "char_end", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    field = F.when(k % 5 == 0, "Signature1").when(k % 5 == 1, "date").otherwise("")
    return o.select(
        k.alias("doc_id"), (k % 3).cast("int").alias("page_index"), (k % 7).cast("int").alias("idx"), F.when(k % 2 == 0, "Widget").otherwise("Text").alias("subtype"), F.when(k % 3 == 0, "Sig").otherwise("Tx").alias("field_type"),
        field.alias("field_name"), F.when(k % 11 == 0, "Signed with DocuSign").alias("contents"), F.array((k % 100).cast("double"), (k % 50).cast("double"), (k % 90).cast("double"), (k % 70).cast("double") + 0.5).alias("rect"),
    )


def src08_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.annotation_regions(_annotations(spark, sf_dir)).select("doc_id", "page_index", "id", "bbox.x", "bbox.y", "bbox.width", "bbox.height", "label", "kind")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stored documents, with a page out of range, a repeated one, and old labels."""
    pages = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_index").alias("pageIndex"), "text"))).alias("p"), F.max("page_index").alias("top"))
    old = F.when(F.length("text") % 2 == 0, "EMAIL").otherwise(F.col("label"))
    ents = names(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("page_index").alias("pageIndex"), old.alias("label"), "text", F.col("char_start").alias("charStart"), F.col("char_end").alias("charEnd")))).alias("e"))
    met = pages.join(ents, "doc_id", "left")
    return met.select(F.col("doc_id").alias("id"), F.greatest("top", F.lit(1)).alias("num_pages"), F.to_json(F.concat("p", F.slice("p", 1, 1))).alias("pages_json"), F.to_json(F.coalesce("e", F.array().cast(met.schema["e"].dataType.simpleString()))).alias("entities_json"))


def src09_stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.stored_pages(_stored(spark, sf_dir))


def src09_stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.stored_entities(_stored(spark, sf_dir)).drop("ord")


def src10_share_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.stored_pages(_stored(spark, sf_dir).withColumn("num_pages", F.lit(6)), fill_blank=True)


def src13_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct(F.col("event_type").alias("key"), F.length("event_type").cast("string").alias("value"))))).alias("state"))
    return e.select("user_id", F.explode(readers.revived(F.col("state"))).alias("key", "value"))


def src11_read_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents written to a table and read back by key; the key's filter reaches the files."""
    path = shared_path(spark)
    sinks.write_table(_stored(spark, sf_dir).select("id", "num_pages"), path)
    return spark.read.parquet(path).where("id between 10 and 60")


def _kept(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The stored documents written through the data source, in two jobs."""
    document_store.register(spark)
    stored = _stored(spark, sf_dir)
    for rows in (stored.where("id % 2 = 0"), stored.where("id % 2 = 1")):
        rows.write.format(document_store.FORMAT).mode("append").save(path)


def src09_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents that the data source keeps; the entities' column isn't read."""
    path = shared_path(spark)
    _kept(spark, sf_dir, path)
    return readers.stored_pages(spark.read.format(document_store.FORMAT).schema("id bigint, num_pages int, pages_json string").load(path))


def src11_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of some documents, without their contents."""
    path = shared_path(spark)
    _kept(spark, sf_dir, path)
    return spark.read.format(document_store.FORMAT).schema("id bigint, num_pages int").load(path).where("id between 10 and 60")


def snk05_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole store written anew from what it held, with old labels mapped; its entities."""
    path = shared_path(spark)
    _kept(spark, sf_dir, path)
    held = spark.read.format(document_store.FORMAT).load(path)
    held.withColumn("num_pages", F.lit(3)).write.format(document_store.FORMAT).mode("overwrite").save(path)
    return readers.stored_entities(spark.read.format(document_store.FORMAT).load(path)).drop("ord")


def src14_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("event_id") % 3 == 0, "application/pdf").otherwise("image/png")
    return readers.accepted_uploads(read(spark, sf_dir, "events").select("event_id", mime.alias("mime"), (F.col("event_id") * 9001).alias("size")))


def snk04_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules saved twice: the second version is what is read."""
    path = shared_path(spark)
    sinks.write_table(rules(spark, sf_dir), path)
    sinks.write_table(rules(spark, sf_dir).where("kind <> 'override'"), path)
    return spark.read.parquet(path)


def snk05_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans exported by label, then one label read: other labels' files aren't."""
    path = shared_path(spark)
    sinks.write_table(names(spark, sf_dir), path, "label")
    return spark.read.parquet(path).where("label = 'PERSON'").select("doc_id", "ord", "text")


def det13_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.detect(contract_pages(spark, sf_dir))


def det14_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 8 to 15 digits, every second one in groups."""
    k = F.col("o_orderkey")
    digits = F.concat(F.lpad(((k * 7919 + 100000007) % 1000000000).cast("string"), 9, "0"), F.lit("00074123"))
    number = F.substring(digits, F.lit(1), (8 + k % 8).cast("int"))
    number = F.when(k % 2 == 0, F.concat_ws(" ", F.substring(number, 1, 3), F.substring(number, F.lit(4), F.length(number)))).otherwise(number)
    return read(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"), siren_checksum(number).alias("valid"))


def det15_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("B."), F.lpad(k.cast("string"), 6, "0"))).when(k % 6 == 1, F.lit("732 829 320")).when(k % 6 == 2, F.upper(F.concat(F.lit("id-"), F.lpad(k.cast("string"), 8, "0")))).when(k % 6 == 3, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 6 == 4, F.concat(F.lit("see reference "), k.cast("string"))).otherwise(F.concat(F.lit("1A2B3C4D-00aa-11BB-22CC-"), F.lpad(k.cast("string"), 12, "0")))
    label = F.when(k % 2 == 0, "ADDRESS").otherwise("PERSON")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), op.excluded(text, label).alias("excluded"))


def det16_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.element_at(F.array(*[F.lit(f"  {t.upper()} ") for t in op.KNOWN_FALSE_POSITIVES], F.lit("Autre"), F.lit("filiale")), (F.col("c_custkey") % 10 + 1).cast("int"))
    from ..functions.text import normalize

    spans = read(spark, sf_dir, "customer").select("c_custkey", normalize(known).alias("norm_text"))
    return op.without_false_positives(spans)


def _signed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per supplier with a signature block: heading, name, id, and a line far below."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    words = ["Bon", "pour", "accord", "DocuSigned", "by:", "Jean", "Dupont", None, "Fin"]
    place = [(0, 760), (40, 761), (80, 759), (0, 700), (60, 701), (0, 690), (40, 689), (0, 676), (0, 500)]
    items = F.array(*[F.struct(F.lit(n).alias("token_idx"), (F.concat(F.lit("A1B2C3D4E5"), k.cast("string")) if w is None else F.lit(w)).alias("text"), F.lit(float(x)).alias("x"), (F.lit(float(y)) - k % 3).alias("y")) for n, (w, (x, y)) in enumerate(zip(words, place, strict=True))])
    t = s.select(k.alias("doc_id"), F.lit(0).alias("page_index"), F.inline(items))
    return t.select("doc_id", "page_index", "token_idx", "text", (F.col("token_idx") * 20).alias("char_start"), (F.col("token_idx") * 20 + F.length("text")).alias("char_end"), F.struct("x", "y", (F.length("text") * 6.0).alias("width"), F.lit(10.0).alias("height")).alias("bbox"))


def dsg01_token_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(conversation_pages(spark, sf_dir)).select("doc_id", "page_index", "token_idx", signatures.token_key(F.col("text")).alias("key"))


def dsg02_median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_tokens(spark, sf_dir).withColumn("bbox", F.col("bbox").withField("height", (F.col("token_idx") % 5 * 3).cast("double")))
    return signatures.median_heights(t)


def dsg03_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.token_lines(_signed_pages(spark, sf_dir))


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.lined(_signed_pages(spark, sf_dir))


def dsg04_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.heading_lines(_lined(spark, sf_dir))


def dsg05_likely_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("AB-"), F.lpad(k.cast("string"), 7, "0"))).when(k % 3 == 1, F.lit("Signature")).otherwise(k.cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), signatures.looks_like_id(text).alias("likely"))


def dsg06_id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.id_lines(_lined(spark, sf_dir))


def dsg07_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.band_tokens(_lined(spark, sf_dir)).select("doc_id", "page_index", "head", "token_idx", "text")


def dsg08_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.detect_signatures(_signed_pages(spark, sf_dir))


QUERIES = {
    "src02_page": src02_page, "src03_page_text": src03_page_text, "src04_reading_order": src04_reading_order, "src05_box": src05_box, "src06_needs_recognition": src06_needs_recognition,
    "src07_tokens": src07_tokens, "src07_recognised": src07_recognised, "src08_annotations": src08_annotations, "src09_stored_pages": src09_stored_pages, "src09_stored_entities": src09_stored_entities,
    "src10_share_pages": src10_share_pages, "src11_read_store": src11_read_store, "src09_source": src09_source, "src11_source": src11_source, "snk05_source": snk05_source, "src13_state": src13_state, "src14_uploads": src14_uploads, "snk04_rules": snk04_rules, "snk05_export": snk05_export, **{i: _detector_query(d) for i, d in zip(_IDS, op.DETECTORS, strict=True)}, "det13_spans": det13_spans, "det14_checksum": det14_checksum,
    "det15_excluded": det15_excluded, "det16_false_positives": det16_false_positives, "dsg01_token_key": dsg01_token_key, "dsg02_median_height": dsg02_median_height, "dsg03_lines": dsg03_lines, "dsg04_headings": dsg04_headings,
    "dsg05_likely_id": dsg05_likely_id, "dsg06_id_lines": dsg06_id_lines, "dsg07_band": dsg07_band, "dsg08_signatures": dsg08_signatures,
}

_CONVS = duck.with_ctes(duck.CONVERSATIONS)
_TOKENS = duck.with_ctes(duck.CONVERSATIONS, duck.TOKENS, duck.BOXED)
_NAMES = duck.with_ctes(duck.CONVERSATIONS, duck.NAMES)
_CONTRACTS = duck.with_ctes(duck.CONTRACTS)
# items by line, where a line begins with the first item that is no nearer than 5 to an earlier line's first
_ORDERED = duck.with_ctes(
    duck.CONVERSATIONS, duck.TOKENS, duck.BOXED,
    "items as (select doc_id, page_index, token_idx as idx, text as str, 480.0::double - x as x, 800.0::double - (y + token_idx % 4) as y from boxed)",
    "folded as (select doc_id, page_index, list_reduce(list([{'line': y, 'x': x, 'i': idx, 'str': str}] order by idx), lambda acc, n: list_append(acc, {'line': coalesce(list_filter(list_transform(acc, lambda o: o.line), lambda h: abs(n[1].line - h) < 5)[1], n[1].line), 'x': n[1].x, 'i': n[1].i, 'str': n[1].str})) as o from items group by all)",
    "flat as (select doc_id, page_index, unnest(o) as s from folded)",
)
_SIGNED = duck.with_ctes(
    """signed as (select s_suppkey as doc_id, 0 as page_index, (i - 1)::int as token_idx, case when i = 8 then 'A1B2C3D4E5' || s_suppkey else ['Bon', 'pour', 'accord', 'DocuSigned', 'by:', 'Jean', 'Dupont', '', 'Fin'][i] end as text,
  [0, 40, 80, 0, 60, 0, 40, 0, 0][i]::double as x, ([760, 761, 759, 700, 701, 690, 689, 676, 500][i] - s_suppkey % 3)::double as y from supplier, generate_series(1, 9) as g(i))"""
)
_STORED_ENTS = "ents as (select doc_id as id, page_index, case when length(text) % 2 = 0 or label not in ('PERSON', 'ORGANIZATION', 'ADDRESS', 'DATE', 'IDENTIFIER') then 'IDENTIFIER' else label end as label, text, char_start, char_end from names)"
_TOPS = "tops as (select doc_id, greatest(max(page_index), 1) as top from convs group by 1)"
_K = "case o_orderkey % 6 when 0 then 'B.' || lpad(o_orderkey::varchar, 6, '0') when 1 then '732 829 320' when 2 then 'ID-' || lpad(o_orderkey::varchar, 8, '0') when 3 then ' ' || o_orderkey || ' ' when 4 then 'see reference ' || o_orderkey else '1A2B3C4D-00aa-11BB-22CC-' || lpad(o_orderkey::varchar, 12, '0') end"

ORACLES = {
    "src02_page": _CONVS + "select * from convs where page_index = 1",
    "src03_page_text": _ORDERED + ", lined as (select doc_id, page_index, string_agg(s.str, ' ' order by s.line, s.x, s.i) as text, count(*)::int as n, max_by(length(s.str), [s.line, s.x, s.i]) as last_size from flat group by all) select doc_id, page_index, text, n, (length(text) - last_size)::int as last_start from lined",
    "src04_reading_order": _ORDERED + "select doc_id, page_index, string_agg(s.str, ' ' order by s.line, s.x, s.i) as ordered from flat group by all",
    "src05_box": "select l_orderkey, l_linenumber, l_quantity::double as x, l_extendedprice::double as y, round(l_quantity * abs(l_discount), 6)::double as width, round(case when l_linenumber % 2 * 10 > 0 then l_linenumber % 2 * 10.0 else abs(-l_tax) end, 6)::double as height from lineitem",
    "src06_needs_recognition": duck.with_ctes(duck.DOCUMENTS) + r"select doc_id, length(t) < 10 or length(regexp_replace(t, '[^\x20-\x7EÀ-ɏ\s]', '', 'g')) / greatest(length(t), 1)::double < 0.7::double or len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) < 5 as needed from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from docs)",
    "src07_tokens": _TOKENS + "select doc_id, page_index, token_idx, text, char_start, char_end from tokens",
    "src07_recognised": _TOKENS + "select doc_id, page_index, 'ocr-' || page_index || '-' || token_idx as id, s::int as char_start, (s + length(text))::int as char_end, x, y, w as width, h as height from (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page_index order by token_idx rows between unbounded preceding and 1 preceding), 0) as s from boxed)",
    "src08_annotations": """with a as (select o_orderkey as k, o_orderkey % 3 as p, o_orderkey % 7 as i, abs(o_orderkey % 100 - o_orderkey % 90)::double as w, abs(o_orderkey % 50 - (o_orderkey % 70 + 0.5))::double as h, least(o_orderkey % 100, o_orderkey % 90)::double as x, least(o_orderkey % 50, o_orderkey % 70 + 0.5)::double as y from orders)
select k as doc_id, p::int as page_index, concat_ws('-', 'region', p, i, floor(x + 0.5)::bigint, floor(y + 0.5)::bigint, floor(w + 0.5)::bigint, floor(h + 0.5)::bigint) as id, x, y, w as width, h as height, 'IDENTIFIER' as label, 'signature' as kind from a where (k % 2 = 0 and (k % 3 = 0 or k % 5 = 0) or k % 11 = 0) and w > 0 and h > 0""",
    "src09_stored_pages": duck.with_ctes(duck.CONVERSATIONS, _TOPS) + "select doc_id as id, page_index, text from convs join tops using (doc_id) where page_index < top",
    "src09_stored_entities": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, _STORED_ENTS, _TOPS) + "select ents.* from ents join tops on id = doc_id where page_index < top",
    "src09_source": duck.with_ctes(duck.CONVERSATIONS, _TOPS) + "select doc_id as id, page_index, text from convs join tops using (doc_id) where page_index < top",
    "src11_source": duck.with_ctes(duck.CONVERSATIONS, _TOPS) + "select doc_id as id, top::int as num_pages from tops where doc_id between 10 and 60",
    "snk05_source": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, _STORED_ENTS) + "select * from ents where page_index < 3",
    "src10_share_pages": duck.with_ctes(duck.CONVERSATIONS) + "select d.doc_id as id, i::int as page_index, coalesce(c.text, '') as text from (select distinct doc_id from convs) d cross join generate_series(0, 5) as g(i) left join convs c on c.doc_id = d.doc_id and c.page_index = i",
    "src11_read_store": duck.with_ctes(duck.CONVERSATIONS, _TOPS) + "select doc_id as id, top::int as num_pages from tops where doc_id between 10 and 60",
    "src14_uploads": "select event_id, 'application/pdf' as mime, event_id * 9001 as size from events where event_id % 3 = 0 and event_id * 9001 <= 52428800",
    "snk04_rules": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES, f"rules as ({RULES_SQL})") + "select * from rules where kind <> 'override'",
    "snk05_export": duck.with_ctes(duck.CONVERSATIONS, duck.NAMES) + "select doc_id, ord, text from names where label = 'PERSON'",
    "src13_state": "select distinct user_id, event_type as key, length(event_type)::varchar as value from events",
    **{i: _CONTRACTS + f"select doc_id, n, text, char_start, char_end from ({duck.detector(d)})" for i, d in zip(_IDS, op.DETECTORS, strict=True)},
    "det13_spans": duck.with_ctes(duck.CONTRACTS, duck.detected()) + "select * from raw",
    "det14_checksum": f"select o_orderkey, text as number, case when length({duck.DIGITS}) in (9, 14) then {duck.LUHN} else false end as valid from (select o_orderkey, case when o_orderkey % 2 = 0 then d[1:3] || ' ' || d[4:] else d end as text from (select o_orderkey, (lpad(((o_orderkey * 7919 + 100000007) % 1000000000)::varchar, 9, '0') || '00074123')[1:8 + o_orderkey % 8] as d from orders))",
    "det15_excluded": rf"""select o_orderkey, text, regexp_matches(t, '(?i)[A-F0-9]{{8}}-[A-F0-9]{{4}}-[0-9A-F]{{4}}-[A-F0-9]{{4}}-[A-F0-9]{{12}}') or regexp_matches(t, '(?i)\b(docusign|envelope|signature|id:|ref:|reference)\b')
  or o_orderkey % 2 = 0 and (regexp_matches(t, '^[A-Z]\.[0-9]{{5,7}}$') or regexp_matches(t, '^[0-9]{{3}}\s+[0-9]{{3}}\s+[0-9]{{3}}$')) or o_orderkey % 2 = 1 and (regexp_matches(t, '^[0-9]+$') or regexp_matches(t, '^[A-Z0-9-]{{8,}}$')) as excluded
from (select o_orderkey, {_K} as text, trim({_K}) as t from orders)""",
    "det16_false_positives": "select c_custkey, case c_custkey % 10 when 8 then 'autre' else 'filiale' end as norm_text from customer where c_custkey % 10 >= 8",
    "dsg01_token_key": _TOKENS + "select doc_id, page_index, token_idx, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as key from tokens",
    "dsg02_median_height": _TOKENS + "select doc_id, page_index, median(token_idx % 5 * 3)::double as median_height from tokens where token_idx % 5 > 0 group by all",
    "dsg03_lines": _SIGNED + "select doc_id, page_index, token_idx, case when token_idx < 3 then 0 when token_idx < 5 then 1 when token_idx < 7 then 2 when token_idx = 7 then 3 else 4 end as line from signed",
    "dsg04_headings": "select s_suppkey as doc_id, 0 as page_index, 1 as line from supplier",
    "dsg05_likely_id": "select o_orderkey, text, length(p) >= 8 and regexp_matches(p, '[0-9]') as likely from (select *, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') as p from (select o_orderkey, case o_orderkey % 3 when 0 then 'AB-' || lpad(o_orderkey::varchar, 7, '0') when 1 then 'Signature' else o_orderkey::varchar end as text from orders))",
    "dsg06_id_lines": "select s_suppkey as doc_id, 0 as page_index, 1 as head, (700 - s_suppkey % 3)::double as band_top, 3 as id_line, (676 - s_suppkey % 3)::double as band_bottom from supplier",
    "dsg07_band": _SIGNED + "select doc_id, page_index, 1 as head, token_idx, text from signed where token_idx between 5 and 7",
    "dsg08_signatures": "select s_suppkey as doc_id, 0 as page_index, 'IDENTIFIER' as label, 'Jean Dupont A1B2C3D4E5' || s_suppkey as text, 'jean dupont a1b2c3d4e5' || s_suppkey as norm_text, 0.85::double as confidence, 'regex' as source, 100 as char_start, (140 + 10 + length(s_suppkey::varchar))::int as char_end from supplier",
}
