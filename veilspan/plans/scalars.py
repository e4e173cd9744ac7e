"""Catalogue: scalar functions, geometry, sinks' names and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as fn
from ..operators import cleaning, name_pairs, redaction
from ..operators.spans import overlap_ratio, overlaps, score
from ..schema import LABELS, LEGACY_LABELS
from ..sources import sinks
from ..sources.tables import document_pages, read
from . import duck
from .inputs import conversation_tokens


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders")


def fn01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", fn.normalize(F.concat(F.lit(" \n"), "text", F.lit("\t "))).alias("norm"))


def fn02_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", fn.normalize_whitespace(F.concat(F.lit(" \n"), "text")).alias("norm"))


def fn03_texts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("\n"))).otherwise(F.lit("Customer"))
    return c.select("c_custkey", fn.texts_match(F.col("c_name"), other).alias("same"))


def fn04_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", cleaning.remove_diacritics(F.col("text")).alias("plain"))


def fn05_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", cleaning.normalize_fuzzy(F.col("text")).alias("fuzzy"))


def _pairs(spark: SparkSession, sf_dir: str, *, similar: bool) -> DataFrame:
    """Each customer's name against those of all suppliers of its nation."""
    customers, suppliers = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    c_name, s_name = F.col("c_name"), F.col("s_name")
    if similar:  # fuzzy forms are made once a name, not once a pair
        c_name, s_name = fn.normalize_fuzzy(c_name).alias("c_fuzzy"), fn.normalize_fuzzy(s_name).alias("s_fuzzy")
    met = name_pairs.pairs(customers.select("c_nationkey", "c_custkey", c_name), suppliers.select("s_nationkey", "s_suppkey", s_name), similar=similar)
    return met.select(F.col("left_key").alias("c_custkey"), F.col("right_key").alias("s_suppkey"), "value")


def fn06_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, similar=True).withColumnRenamed("value", "similarity")


def fn07_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, similar=False).withColumnRenamed("value", "distance")


_ALL_LABELS = (*LABELS, *LEGACY_LABELS, "OTHER")


def fn08_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.element_at(F.array(*map(F.lit, _ALL_LABELS)), (F.col("o_orderkey") % len(_ALL_LABELS) + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", fn.entity_label(stored).alias("label"))


_DATES = ("12/03/2024", "janvier", "2024", "le 3 Février 2024", "3 mars", "décembre 2024, ", "lot 12-12-1999", "rue 75001", "août 1850")


def fn09_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, _DATES)), (F.col("o_orderkey") % len(_DATES) + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", fn.looks_like_date_part(t).alias("part"), fn.looks_like_date(t).alias("date"), fn.ends_with_date(t).alias("ends"))


def fn10_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", fn.digits(F.concat("c_name", F.lit(" +33 1."))).alias("digits"))


def fn11_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", fn.escape_regex(F.col("text")).alias("escaped"))


def fn12_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.confidence_band(F.col("l_discount") * 10).alias("band"))


def fn13_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.stable_id(F.lit("span"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))


def fn14_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def fn15_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    back = F.from_json(text, "id bigint, name string")
    return read(spark, sf_dir, "customer").select("c_custkey", text.alias("json"), back["name"].alias("name"))


def fn16_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", fn.clamp(F.col("o_orderkey") % 40 / 10.0, 0.25, 3.0).alias("zoom"))


def fn17_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", fn.rounded((F.col("o_orderkey") % 9 - 4) / 2.0).cast("long").alias("n"))


def fn18_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") % 50000000 + F.col("o_orderkey") % 2
    return _orders(spark, sf_dir).select("o_orderkey", fn.format_bytes(n * 2 + 1).alias("size"))


def fn19_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("shown"))


def tag18_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", fn.shortened(F.col("text")).alias("shown"))


def tag22_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_discount") * 10
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.confidence_band(p).alias("band"), fn.rounded(F.round(p * 100, 6)).cast("long").alias("percent"))


def tag23_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("doc_id", fn.sanitized(F.concat("text", F.lit("€\u0007 日"))).alias("clean"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    a = geo.box(F.col("l_partkey") % 50, F.col("l_suppkey") % 40, F.col("l_quantity"), F.col("l_linenumber") * 5)
    b = geo.box(F.col("l_orderkey") % 60, F.col("l_partkey") % 30, F.lit(20), F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


_A_B = """with boxes as (select l_orderkey, l_linenumber, (l_partkey % 50)::double as ax, (l_suppkey % 40)::double as ay, l_quantity::double as aw, (l_linenumber * 5)::double as ah,
  (l_orderkey % 60)::double as bx, (l_partkey % 30)::double as by_, 20.0::double as bw, l_quantity::double as bh from lineitem),
met as (select *, greatest(ax, bx) as ix, greatest(ay, by_) as iy, least(ax + aw, bx + bw) as ix2, least(ay + ah, by_ + bh) as iy2 from boxes)
"""
_KEYS = ("l_orderkey", "l_linenumber")


def geo01_to_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).withColumn("s", geo.to_screen(F.col("a"), F.lit(800.0), F.lit(1.5))).select(*_KEYS, "s.*")


def geo02_to_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).withColumn("s", geo.to_pdf(F.col("a"), F.lit(800.0), F.lit(2.0))).select(*_KEYS, "s.*")


def geo03_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*_KEYS, geo.contains_point(F.col("a"), F.col("b.x"), F.col("b.y")).alias("inside"))


def geo04_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*_KEYS, geo.overlap(F.col("a"), F.col("b")).alias("meets"))


def geo05_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).groupBy("l_orderkey").agg(geo.hull(F.collect_list("a")).alias("h")).select("l_orderkey", "h.*")


def geo06_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).withColumn("i", geo.intersection(F.col("a"), F.col("b"))).select(*_KEYS, "i.*")


def geo07_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*_KEYS, geo.area(F.col("a")).alias("area"))


def geo08_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*_KEYS, F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


def _page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_tokens(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("token_idx", "bbox"))).alias("t")).withColumn("boxes", F.transform("t", lambda t: t["bbox"]))


def geo09_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _page_boxes(spark, sf_dir).select("doc_id", "page_index", F.posexplode(geo.lines(F.col("boxes"), 5.0)).alias("line", "b"))
    return found.select("doc_id", "page_index", "line", F.size("b").alias("n"), F.get("b", 0)["x"].alias("x"))


def geo10_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_boxes(spark, sf_dir).select("doc_id", "page_index", F.posexplode(geo.line_boxes(F.col("boxes"), 5.0)).alias("line", "b")).select("doc_id", "page_index", "line", "b.*")


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_tokens(spark, sf_dir)
    n = F.col("char_end") - F.col("char_start")
    a, b = F.col("char_start") + F.col("token_idx") % 3 - 1, F.col("char_end") - F.col("token_idx") % 4 + 1
    wide = F.col("bbox").withField("width", F.col("bbox.width") * F.when(n % 2 == 0, 1.0).otherwise(4.0))
    return t.withColumn("p", geo.partial(wide, F.col("char_start"), F.col("char_end"), a, b))


def geo11_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partial(spark, sf_dir).select("doc_id", "page_index", "token_idx", F.round("p.x", 6).alias("x"), F.round("p.width", 6).alias("width"))


def geo15_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the parts of its tokens, by line, on screen."""
    pages = _partial(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("token_idx", "p")).alias("t")).withColumn("boxes", F.transform(F.array_sort("t"), lambda t: t["p"]))
    found = pages.select("doc_id", "page_index", F.posexplode(F.transform(geo.line_boxes(F.col("boxes")), lambda b: geo.to_screen(b, F.lit(800.0), F.lit(2.0)))).alias("line", "b"))
    return found.select("doc_id", "page_index", "line", F.round("b.x", 6).alias("x"), F.round("b.y", 6).alias("y"), F.round("b.width", 6).alias("width"))


def geo16_recognised_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    pdf = geo.box(b["x"] / 2, 800.0 - (b["y"] + b["height"]) / 2, b["width"] / 2, b["height"] / 2)
    return _boxes(spark, sf_dir).withColumn("p", pdf).select(*_KEYS, "p.*")


def geo17_drawn_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    r = redaction.drawn_region(a["x"], a["y"], b["x"], b["y"], F.lit(800.0), F.lit(2.0), 8.0)
    return _boxes(spark, sf_dir).withColumn("r", r).where("r is not null").select(*_KEYS, "r.*")


def _span_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda a, n: F.struct(a.cast("int").alias("char_start"), (a + n).cast("int").alias("char_end"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_linenumber") == 1, "ner").when(F.col("l_linenumber") == 2, "user").otherwise("regex").alias("source"))
    return read(spark, sf_dir, "lineitem").select(*_KEYS, span(F.col("l_partkey") % 60, F.col("l_quantity")).alias("a"), span(F.col("l_suppkey") % 60, F.lit(12)).alias("b"))


_SPAN_PAIR = "with pair as (select l_orderkey, l_linenumber, l_partkey % 60 as s, l_partkey % 60 + l_quantity::int as e, l_suppkey % 60 as s2, l_suppkey % 60 + 12 as e2, l_discount::double * 10 as confidence from lineitem) "


def spn01_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_pair(spark, sf_dir).select(*_KEYS, overlaps(F.col("a"), F.col("b")).alias("meets"))


def spn02_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_pair(spark, sf_dir).select(*_KEYS, F.round(overlap_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def spn03_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_pair(spark, sf_dir).select(*_KEYS, F.round(score(F.col("a")), 6).alias("score"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_anonymized.PDF").when(F.col("c_custkey") % 3 == 1, ".pdf").otherwise(".pdf.txt"))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


_FILES = "with files as (select c_custkey, c_name || case c_custkey % 3 when 0 then '_anonymized.PDF' when 1 then '.pdf' else '.pdf.txt' end as name from customer) "


def snk01_json_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("c_custkey", sinks.anonymized_json_name(F.col("name")).alias("name"))


def snk06_object_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("c_custkey", sinks.object_key((F.col("c_custkey") % 5).cast("string"), F.col("name")).alias("key"))


def snk07_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "questionnaire").when(F.col("event_id") % 4 == 1, "false_positives").when(F.col("event_id") % 4 == 2, "pdf")
    up = e.select("event_id", (F.col("user_id")).cast("string").alias("session_id"), kind.alias("type"), F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string")).alias("data_id"), F.col("props").alias("data"))
    return sinks.route_uploads(up).select("event_id", "status", "key")


def snk08_shared_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("c_custkey", sinks.shared_name(F.col("name")).alias("name"))


def snk09_dropped_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("c_custkey", sinks.dropped_name(F.col("c_custkey") % 200, F.col("name")).alias("name"))


def snk10_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_set(F.struct("event_type", F.length("event_type")))).alias("m"))
    return m.select("user_id", sinks.as_entries(F.col("m")).alias("json"))


def snk11_pdf_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("c_custkey", sinks.anonymized_pdf_name(F.col("name")).alias("name"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:3] in ("fn0", "fn1", "geo", "snk", "spn", "tag") and k[3].isalnum()}

_D = duck.with_ctes(duck.DOCUMENTS)
_T = duck.with_ctes(duck.CONVERSATIONS, duck.TOKENS, duck.BOXED)
_FUZZY = r"regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({})), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_MONTHS = "(?:" + "|".join(fn.MONTHS) + ")"
_PAIRED = "from customer join supplier on c_nationkey = s_nationkey"
_PARTIAL = """parts as (select *, char_end - char_start as n, char_start + token_idx % 3 - 1 as a, char_end - token_idx % 4 + 1 as b, w * case when (char_end - char_start) % 2 = 0 then 1 else 4 end as ww from boxed),
cut as (select *, case when ww / n <= h * 1.2::double then ww / n else h * 0.55::double end as each, greatest(a, char_start) - char_start as o1, least(b, char_end) - char_start as o2, a <= char_start and b >= char_end as whole from parts),
placed as (select *, case when whole then x else greatest(x, least(x + o1 * each, x + ww)) end as px from cut),
part as (select *, case when whole then ww else greatest(0, least((o2 - o1) * each + h * 0.15::double, x + ww - px)) end as pw from placed)"""

ORACLES = {
    "fn01_normalize": _D + f"select doc_id, {duck.norm("' ' || chr(10) || text || chr(9) || ' '")} as norm from docs",
    "fn02_whitespace": _D + rf"select doc_id, regexp_replace(regexp_replace(' ' || chr(10) || text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as norm from docs",
    "fn03_texts_match": "select c_custkey, c_custkey % 3 = 0 as same from customer",
    "fn04_diacritics": _D + "select doc_id, strip_accents(text) as plain from docs",
    "fn05_fuzzy": _D + f"select doc_id, {_FUZZY.format('text')} as fuzzy from docs",
    "fn06_similarity": f"select c_custkey, s_suppkey, round(case when a = b then 1 else 1 - levenshtein(a, b) / greatest(length(a), length(b), 1)::double end, 6)::double as similarity from (select c_custkey, s_suppkey, {_FUZZY.format('c_name')} as a, {_FUZZY.format('s_name')} as b {_PAIRED})",
    "fn07_levenshtein": f"select c_custkey, s_suppkey, levenshtein(c_name, s_name)::int as distance {_PAIRED}",
    "fn08_label": "select o_orderkey, case when o_orderkey % 12 < 5 then ['PERSON', 'ORGANIZATION', 'ADDRESS', 'DATE', 'IDENTIFIER'][o_orderkey % 12 + 1] else 'IDENTIFIER' end as label from orders",
    "fn09_dates": rf"""with t as (select o_orderkey, [{", ".join(f"'{d}'" for d in _DATES)}][o_orderkey % {len(_DATES)} + 1] as t from orders)
select o_orderkey, lower(trim(t)) in ({", ".join(f"'{m}'" for m in (*fn.MONTHS, *fn.MONTHS_PLAIN))}) or regexp_matches(trim(t), '^(19|20)[0-9]{{2}}$') as part,
  regexp_matches(trim(t), '\b{fn.DATE_NUMERIC}\b') or regexp_matches(trim(t), '(?i)\b{fn.DATE_WRITTEN}\b') as date, regexp_matches(t, '(?i){_MONTHS}\s+[0-9]{{4}}[,\s]*$') or regexp_matches(t, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-](19|20)[0-9]{{2}}[,\s]*$') as ends from t""",
    "fn10_digits": "select c_custkey, regexp_replace(c_name || ' +33 1.', '[^0-9]', '', 'g') as digits from customer",
    "fn11_escape": _D + r"select doc_id, regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') as escaped from docs",
    "fn12_band": "select l_orderkey, l_linenumber, case when l_discount::double * 10 >= 0.8::double then 'high' when l_discount::double * 10 >= 0.5::double then 'medium' else 'low' end as band from lineitem",
    "fn13_id": "select l_orderkey, l_linenumber, 'span-' || l_orderkey || '-' || l_linenumber as id from lineitem",
    "fn14_iso": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events",
    "fn15_json": "select c_custkey, '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' as json, c_name as name from customer",
    "fn16_clamp": "select o_orderkey, least(greatest(o_orderkey % 40 / 10.0::double, 0.25::double), 3.0::double) as zoom from orders",
    "fn17_rounded": "select o_orderkey, floor((o_orderkey % 9 - 4) / 2.0::double + 0.5::double)::bigint as n from orders",
    "fn18_bytes": "with s as (select o_orderkey, (o_orderkey * o_orderkey % 50000000 + o_orderkey % 2) * 2 + 1 as n from orders) select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then round(n / 1024.0::double)::bigint || ' KB' else printf('%.1f', n / 1048576.0::double) || ' MB' end as size from s",
    "fn19_date_text": "select event_id, strftime(ts, '%d/%m/%Y %H:%M') as shown from events",
    "tag18_shortened": _D + "select doc_id, case when length(text) > 32 then text[1:22] || '…' || right(text, 10) else text end as shown from docs",
    "tag22_percent": "select l_orderkey, l_linenumber, case when l_discount::double * 10 >= 0.8::double then 'high' when l_discount::double * 10 >= 0.5::double then 'medium' else 'low' end as band, floor(round(l_discount::double * 10 * 100, 6) + 0.5::double)::bigint as percent from lineitem",
    "tag23_sanitized": _D + r"select doc_id, regexp_replace(regexp_replace(text || '€' || chr(7) || ' 日', '[\x00-\x1F\x7F]', '', 'g'), '[^\x20-\x7E\x{A0}-\x{FF}]', '?', 'g') as clean from docs",
    "geo01_to_screen": _A_B + "select l_orderkey, l_linenumber, ax * 1.5::double as x, (800.0::double - ay - ah) * 1.5::double as y, aw * 1.5::double as width, ah * 1.5::double as height from boxes",
    "geo02_to_pdf": _A_B + "select l_orderkey, l_linenumber, ax / 2 as x, 800.0::double - ay / 2 - ah / 2 as y, aw / 2 as width, ah / 2 as height from boxes",
    "geo03_point": _A_B + "select l_orderkey, l_linenumber, bx between ax and ax + aw and by_ between ay and ay + ah as inside from boxes",
    "geo04_overlap": _A_B + "select l_orderkey, l_linenumber, ix2 > ix and iy2 > iy as meets from met",
    "geo05_hull": _A_B + "select l_orderkey, min(ax) as x, min(ay) as y, max(ax + aw) - min(ax) as width, max(ay + ah) - min(ay) as height from boxes group by 1",
    "geo06_intersection": _A_B + "select l_orderkey, l_linenumber, " + ", ".join(f"case when ix2 > ix and iy2 > iy then {e} end as {n}" for e, n in (("ix", "x"), ("iy", "y"), ("ix2 - ix", "width"), ("iy2 - iy", "height"))) + " from met",
    "geo07_area": _A_B + "select l_orderkey, l_linenumber, aw * ah as area from boxes",
    "geo08_iou": _A_B + "select l_orderkey, l_linenumber, round(i / (aw * ah + bw * bh - i), 6)::double as iou from (select *, case when ix2 > ix and iy2 > iy then (ix2 - ix) * (iy2 - iy) else 0 end as i from met)",
    "geo09_lines": _T + ", lined as (select *, dense_rank() over (partition by doc_id, page_index order by y desc) - 1 as line from boxed) select doc_id, page_index, line::int as line, count(*)::int as n, min(x) as x from lined group by all",
    "geo10_line_boxes": _T + ", lined as (select *, dense_rank() over (partition by doc_id, page_index order by y desc) - 1 as line from boxed) select doc_id, page_index, line::int as line, min(x) as x, min(y) as y, max(x + w) - min(x) as width, max(y + h) - min(y) as height from lined group by all",
    "geo11_partial": _T + ", " + _PARTIAL + " select doc_id, page_index, token_idx, round(px, 6) as x, round(pw, 6) as width from part",
    "geo15_highlights": _T + ", " + _PARTIAL + ", lined as (select *, dense_rank() over (partition by doc_id, page_index order by y desc) - 1 as line from part) select doc_id, page_index, line::int as line, round(min(px) * 2, 6) as x, round((800.0::double - min(y) - (max(y + h) - min(y))) * 2, 6) as y, round((max(px + pw) - min(px)) * 2, 6) as width from lined group by all",
    "geo16_recognised_box": _A_B + "select l_orderkey, l_linenumber, bx / 2 as x, 800.0::double - (by_ + bh) / 2 as y, bw / 2 as width, bh / 2 as height from boxes",
    "geo17_drawn_region": _A_B + "select l_orderkey, l_linenumber, least(ax, bx) / 2 as x, 800.0::double - least(ay, by_) / 2 - abs(by_ - ay) / 2 as y, abs(bx - ax) / 2 as width, abs(by_ - ay) / 2 as height from boxes where abs(bx - ax) >= 8 and abs(by_ - ay) >= 8",
    "spn01_overlap": _SPAN_PAIR + "select l_orderkey, l_linenumber, e > s2 and s < e2 as meets from pair",
    "spn02_ratio": _SPAN_PAIR + "select l_orderkey, l_linenumber, round(greatest(least(e, e2) - greatest(s, s2), 0) / least(e - s, 12)::double, 6)::double as ratio from pair",
    "spn03_score": _SPAN_PAIR + "select l_orderkey, l_linenumber, round(confidence * 100 + case l_linenumber when 1 then 10 when 2 then 1000 else 0 end + (e - s) * 0.1::double, 6)::double as score from pair",
    "snk01_json_name": _FILES + r"select c_custkey, regexp_replace(name, '(?i)\.pdf$', '_anonymized.json') as name from files",
    "snk06_object_key": _FILES + "select c_custkey, (c_custkey % 5) || '/' || name as key from files",
    "snk07_uploads": "select event_id, case when key is null then 400 else 200 end::int as status, key from (select event_id, case event_id % 4 when 0 then user_id || '/questionnaire.json' when 1 then case when event_id % 3 > 0 then 'false_positives/' || event_id || '.json' end end as key from events)",
    "snk08_shared_name": _FILES + r"select c_custkey, regexp_replace(regexp_replace(name, '(?i)\.pdf$', ''), '(?i)_anonymized$', '') || '_anonymized.pdf' as name from files",
    "snk09_dropped_name": _FILES + "select c_custkey, lpad((c_custkey % 200)::varchar, greatest(2, length((c_custkey % 200)::varchar))::int, '0') || '_' || name as name from files",
    "snk10_entries": """select user_id, '[' || string_agg('{"key":"' || event_type || '","value":' || length(event_type) || '}', ',' order by event_type) || ']' as json from (select distinct user_id, event_type from events) group by 1""",
    "snk11_pdf_name": _FILES + r"select c_custkey, regexp_replace(name, '(?i)\.pdf$', '_anonymized.pdf') as name from files",
}
assert set(ORACLES) == set(QUERIES)
