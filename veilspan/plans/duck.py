"""Pieces of the checking SQL: the logical inputs and the detectors as common table expressions."""

from __future__ import annotations

from ..operators.detect import DETECTORS, Detector
from ..sources.tables import CONTRACT

CONTRACTS = f"""contracts as (
  select k as doc_id, 0 as page_index, {CONTRACT} as text from (
    select o_orderkey as k, c_custkey as c, c_name, s_name, strftime(o_orderdate, '%d/%m/%Y') as d
    from orders join customer on o_custkey = c_custkey join supplier on s_suppkey = o_orderkey % 10))"""
CONVERSATIONS = "convs as (select conv_id as doc_id, turn::int as page_index, coalesce(text, '') as text from conversations)"
DOCUMENTS = "docs as (select doc_id, 0 as page_index, coalesce(text, '') as text from documents)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(source: str, pattern: str) -> str:
    """Rows (doc_id, page_index, n, text, char_start, char_end) of a pattern's matches."""
    p = quoted(pattern)
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    return f"""select doc_id, page_index, (i - 1)::int as n, m[i] as text, ({size('g[1:i]')} + {size('m[1:i-1]')})::int as char_start, ({size('g[1:i]')} + {size('m[1:i]')})::int as char_end
  from (select doc_id, page_index, m, g, unnest(generate_series(1, len(m))) as i from
    (select doc_id, page_index, regexp_extract_all(text, {p}) as m, regexp_split_to_array(text, {p}) as g from {source}))"""


def duck_pattern(d: Detector) -> str:
    return ("(?i)" if d.ignore_case else "") + d.pattern.replace("{B}", r"\b")


DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
LUHN = f"(list_sum(list_transform(generate_series(1, 9), lambda i: case when i % 2 = 1 then substr({DIGITS}, i, 1)::int when substr({DIGITS}, i, 1)::int > 4 then 2 * substr({DIGITS}, i, 1)::int - 9 else 2 * substr({DIGITS}, i, 1)::int end)) % 10 = 0)"
VALID = {"phone_fr": f"length({DIGITS}) >= 10", "phone_intl": f"length({DIGITS}) >= 10", "siret": LUHN, "siren": LUHN}


def detector(d: Detector, source: str = "contracts") -> str:
    return f"select * from ({matches(source, duck_pattern(d))}) where {VALID.get(d.name, 'true')}"


def norm(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def detected(source: str = "contracts") -> str:
    """CTEs up to ``raw``: all detectors' spans, without repeats of a place and matches inside longer ones."""
    union = " union all ".join(f"select {k} as d, * from ({detector(d, source)})" for k, d in enumerate(DETECTORS))
    label = "case d " + " ".join(f"when {k} then '{d.label}'" for k, d in enumerate(DETECTORS)) + " end"
    conf = "(case d " + " ".join(f"when {k} then {d.confidence}" for k, d in enumerate(DETECTORS)) + " end)::double"
    siren = next(k for k, d in enumerate(DETECTORS) if d.within_longer)
    return f"""hits as ({union}),
clear as (select * from hits h where not exists (select 1 from hits o where o.doc_id = h.doc_id and o.page_index = h.page_index and o.d < h.d
  and (o.char_start = h.char_start and o.char_end = h.char_end or h.d = {siren} and o.char_start <= h.char_start and o.char_end >= h.char_end and o.char_end - o.char_start > h.char_end - h.char_start))),
raw as (select doc_id, page_index, row_number() over (partition by doc_id, page_index order by d, n) - 1 as ord, {label} as label, text, {norm('text')} as norm_text, {conf} as confidence, 'regex' as source, char_start, char_end from clear)"""


def resolved(raw: str = "raw", out: str = "spans") -> str:
    """CTEs for the deduplicated and greedily resolved spans of ``raw``."""
    conflict = "(y.char_end > x[1].char_start and y.char_start < x[1].char_end and (least(y.char_end, x[1].char_end) - greatest(y.char_start, x[1].char_start)) / least(y.char_end - y.char_start, x[1].char_end - x[1].char_start)::double > 0.5::double)"
    return f"""{out}_once as (select * from {raw} qualify row_number() over (partition by doc_id, page_index, char_start, char_end, label order by ord) = 1),
{out}_scored as (select *, confidence * 100::double + (case source when 'ner' then 10 when 'user' then 1000 else 0 end)::double + (char_end - char_start) * 0.1::double as score from {out}_once),
{out}_folded as (select doc_id, page_index, list_reduce(list([{{'ord': ord, 'label': label, 'text': text, 'norm_text': norm_text, 'confidence': confidence, 'source': source, 'char_start': char_start, 'char_end': char_end, 'score': score}}] order by char_start, score desc, ord),
  lambda acc, x: case when len(list_filter(acc, lambda y: {conflict} and y.score >= x[1].score)) > 0 then acc else list_concat(list_filter(acc, lambda y: not {conflict}), x) end) as kept from {out}_scored group by doc_id, page_index),
{out} as (select doc_id, page_index, s.ord as ord, s.label as label, s.text as text, s.norm_text as norm_text, s.confidence as confidence, s.source as source, s.char_start as char_start, s.char_end as char_end from (select doc_id, page_index, unnest(kept) as s from {out}_folded))"""


def tag_map(spans: str = "spans", out: str = "tags", order: str = "page_index, char_start, ord", brackets: bool = True) -> str:
    left, right = ("'['", "']'") if brackets else ("''", "''")
    return f"""{out}_n as (select *, row_number() over (partition by doc_id order by {order}) as k from {spans}),
{out}_e as (select doc_id, norm_text, min_by(label, k) as label, min(k) as first_k, list_sort(list_distinct(list(text))) as original_texts, count(*)::bigint as n from {out}_n group by doc_id, norm_text),
{out} as (select doc_id, norm_text, {left} || label || '_' || row_number() over (partition by doc_id, label order by first_k) || {right} as tag, label, original_texts, n from {out}_e)"""


TOKENS = f"tokens as ({matches('convs', '[^ \t\n\x0b\f\r]+').replace('(i - 1)::int as n', '(i - 1)::int as token_idx')})"
BOXED = "boxed as (select *, (char_start % 80) * 6.0::double as x, 780.0::double - 14.0::double * floor(char_start / 80) as y, (char_end - char_start) * 6.0::double as w, 10.0::double as h from tokens)"
#: Capitalised words of conversations, as a model's spans would be.
NAMES_PATTERN = r"[A-Z][a-z]{5,}"
NAMES = f"names as (select doc_id, page_index, row_number() over (partition by doc_id order by page_index, char_start) - 1 as ord, case length(text) % 3 when 0 then 'PERSON' when 1 then 'ORGANIZATION' else 'ADDRESS' end as label, text, {norm('text')} as norm_text, (0.5 + (length(text) % 5) / 10.0)::double as confidence, 'ner' as source, char_start, char_end from ({matches('convs', NAMES_PATTERN)}))"


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
