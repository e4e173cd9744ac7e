"""A document's pages one after the other, as if each came in a batch of its own: the body of an Arrow function over documents.

A page is searched for the texts of all pages before it (and its own) that the rules leave; what it brings counts for the
pages after it. Clusters grow with the pages, so that a document costs what its pages and clusters cost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence

import pyarrow as pa

from .leaders import Leaders
from .places import Taken, fuzzy, normalize, variant_places

BROUGHT = "struct<page_index:int,label:string,text:string,norm_text:string,confidence:double,source:string,char_start:int,char_end:int>"
_BROUGHT = pa.struct([("page_index", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("norm_text", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_ORDER = ("page_index", "char_start", "char_end", "label", "text", "norm_text", "confidence", "source")


def _ordered(spans: list[dict]) -> list[dict]:
    """In page order, missing values first as Spark has them."""
    return sorted(spans, key=lambda s: [(s[f] is not None, s[f]) if s[f] is not None else (False,) for f in _ORDER])


def _take_in(known: Leaders, spans: list[dict]) -> Leaders:
    for s in _ordered(spans):
        known.add(s["text"], s["norm_text"], None if s["text"] is None else fuzzy(s["text"]), s["label"], s["confidence"], s["source"])
    return known


def _on_page(index: int, texts: Sequence[str], clusters: list[dict], taken: list[dict], suppressed: Collection[str], labels: Mapping[str, Sequence[str | None]], flexible: bool, decay: float) -> list[dict]:
    """What the clusters bring to a page; a page that is there twice has it twice."""
    places = set()
    covered = Taken((s["char_start"], s["char_end"]) for s in taken)
    for text in texts:
        seen = set()
        for k, n, a, b in variant_places((c["variants"] for c in clusters), text, flexible):
            if (k, a, b) not in seen:
                seen.add((k, a, b))
                places.add((k, n, a, b, text[a:b]))
    brought = []
    for k, _, a, b, text in sorted(places):
        norm = normalize(text)
        if norm not in suppressed and covered.take(a, b):
            c = clusters[k]
            sure = None if c["confidence"] is None else c["confidence"] * decay
            for label in labels.get(norm, (None,)):
                brought += [{"page_index": index, "label": c["label"] if label is None else label, "text": text, "norm_text": norm, "confidence": sure, "source": c["source"], "char_start": a, "char_end": b}] * len(texts)
    return brought


def document_steps(pages: list[dict], spans: list[dict], suppressed: Collection[str], labels: Mapping[str, Sequence[str | None]], flexible: bool, decay: float) -> Iterator[dict]:
    """The spans that a document's new pages (page_index, text) get from its spans, of which those of the new pages are ``fresh``."""
    texts, own = defaultdict(list), defaultdict(list)
    for p in pages:
        texts[p["page_index"]].append(p["text"] or "")
    everything = []
    for s in spans:
        (own[s["page_index"]] if s["fresh"] and s["page_index"] is not None else everything).append(s)
    known, stale = _take_in(Leaders(), everything), False
    reach = max((s["page_index"] for s in everything if s["page_index"] is not None), default=None)
    for index in sorted(texts.keys() | own.keys()):
        here = own[index]
        if reach is not None and index <= reach:  # a late page: its spans stand before those of pages that are known
            found, stale = _take_in(Leaders(), everything + here), True
            brought = _on_page(index, texts[index], found.clusters, here + [s for s in everything if s["page_index"] == index], suppressed, labels, flexible, decay)
        else:
            if stale:
                known, stale = _take_in(Leaders(), everything), False
            # the page's own spans count in the search; what it leaves behind is told in order of place, with what the search brings
            known.begin()
            brought = _on_page(index, texts[index], _take_in(known, here).clusters, here, suppressed, labels, flexible, decay)
            known.undo()
            _take_in(known, here + brought)
            reach = index
        everything += here + brought
        yield from brought


def stepper(rules: Callable[[], tuple[Collection[str], Mapping[str, Sequence[str | None]]]], flexible: bool, decay: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Lists of the spans that documents (lists of pages, lists of spans) get; ``rules`` gives the suppressed texts and the labels of others."""

    def run(pages: pa.Array, spans: pa.Array) -> pa.Array:
        suppressed, labels = rules()
        columns: tuple[list, ...] = tuple([] for _ in _BROUGHT)
        ends = [0]
        for come, held in zip(pages, spans, strict=True):
            for s in document_steps(come.as_py() or [], held.as_py() or [], suppressed, labels, flexible, decay):
                for column, field in zip(columns, _BROUGHT, strict=True):
                    column.append(s[field.name])
            ends.append(len(columns[0]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BROUGHT, strict=True)], fields=list(_BROUGHT)))

    return run
