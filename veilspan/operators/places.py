"""Places of a document's texts on a page, and which of them are free: bodies of Arrow functions over batches of pages.

What a page needs (its text, its document's clusters, its spans) stands in its row; exact places first, flexible ones where
there is none. The fuzzy and normal forms equal those of ``functions.text``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa

from ..functions.text import SPACES
from .leaders import within

# Formatting characters.
MARKDOWN = r"[*_~`#\[\](){}|\\<>]"
TRAILING = r"[*_~`#\[\](){}|\\<>,.;:!?]"
#: A place, as a type of Spark's and of Arrow's.
PLACE = "struct<cluster:int,variant_no:int,char_start:int,char_end:int,text:string,norm_text:string>"
_PLACE = pa.struct([("cluster", pa.int32()), ("variant_no", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string()), ("norm_text", pa.string())])
#: The same with its page's index.
PAGE_PLACE = PLACE.replace("struct<", "struct<page_index:int,")
_PAGE_PLACE = pa.struct([("page_index", pa.int32()), *_PLACE])

# as the Column functions of the same names; ASCII leaves \s the white space that Java's has
_SPACE, _OUTER = re.compile(f"[{SPACES}]+", re.ASCII), re.compile(f"^[{SPACES}]+|[{SPACES}]+$", re.ASCII)
_FUZZY = re.compile(f"[^A-Za-z0-9_{SPACES}]", re.ASCII)
_MARKS, _BARE = re.compile(MARKDOWN), re.compile(r"[*_~`\s]", re.ASCII)
_LEAD, _TRAIL = re.compile(f"^(?:{MARKDOWN})+"), re.compile(f"(?:{TRAILING})+$")


def normalize(text: str) -> str:
    return _SPACE.sub(" ", _OUTER.sub("", text)).lower()


@lru_cache(maxsize=1 << 16)
def fuzzy(text: str) -> str:
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text)).lower()
    return _OUTER.sub("", _SPACE.sub(" ", _FUZZY.sub("", bare)))


def _alike(a: str, b: str) -> bool:
    """Whether the similarity is 0.85 or more."""
    return a == b or within(a, b, max(len(a), len(b)) * 15 // 100)


def _exact(low: str, needle: str) -> Iterator[int]:
    at = low.find(needle)
    while at >= 0:
        yield at
        at = low.find(needle, at + 1)


@lru_cache(maxsize=1 << 16)
def _needles(variant: str) -> tuple[str, str | None]:
    """A variant in lower case, and without marks and spaces (a blank one: none)."""
    return variant.lower(), _BARE.sub("", variant).lower() if _OUTER.sub("", variant) else None


@lru_cache(maxsize=1 << 12)
def _spelled(variant: str) -> tuple[re.Pattern[str], str]:
    """A variant's pattern with marks between its characters, and its fuzzy form."""
    spell = lambda w: "[*_~`]*".join(map(re.escape, w))
    words = [spell(w) for w in re.split(r"\s+", _OUTER.sub("", variant), flags=re.ASCII)]
    return re.compile(r"[*_~`]*[ \t\n\x0b\f\r]+[*_~`]*".join(words), re.IGNORECASE), fuzzy(_MARKS.sub("", variant))


def _flexible(text: str, variant: str) -> Iterator[tuple[int, int]]:
    """Places of a text that formatting marks interrupt, without outer marks and trailing punctuation."""
    pattern, plain = _spelled(variant)
    for m in pattern.finditer(text):
        found = m.group()
        if _alike(fuzzy(_MARKS.sub("", found)), plain):
            start = len(found) - len(_LEAD.sub("", found))
            stop = max(start, len(_TRAIL.sub("", found)))
            if stop - start < len(variant) * 0.5:
                start, stop = 0, len(found)
            yield m.start() + start, m.start() + stop


def variant_places(clusters: Iterable[Iterable[str | None]], text: str, flexible: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """(cluster, variant, start, end) in that order, of clusters given as lists of variants."""
    low = text.lower()
    bare = _BARE.sub("", text).lower() if flexible else ""
    for k, variants in enumerate(clusters):
        for n, variant in enumerate(variants or ()):
            if not variant:
                continue
            needle, plain = _needles(variant)
            if needle in low:
                for at in _exact(low, needle):
                    yield k, n, at, at + len(variant)
            elif flexible and plain is not None and plain in bare:
                for a, b in sorted(_flexible(text, variant)):
                    yield k, n, a, b


class Taken:
    """What spans and taken places cover of a page; a question costs a search among sorted places."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self._starts, self._reach, self._kept = [], [], []
        for a, b in sorted(spans):
            self._starts.append(a)
            self._reach.append(max(b, self._reach[-1]) if self._reach else b)

    def overlaps_spans(self, a: int, b: int) -> bool:
        i = bisect_left(self._starts, b)
        return i > 0 and self._reach[i - 1] > a

    def take(self, a: int, b: int) -> bool:
        """Takes a place that nothing overlaps. Taken places are apart, so only the last that begins before ``b`` can reach it."""
        i = bisect_left(self._kept, (b,))
        if self.overlaps_spans(a, b) or (i and self._kept[i - 1][1] > a):
            return False
        insort(self._kept, (a, b))
        return True


def _open(text: str | None, clusters: Sequence[Iterable[str | None]], spans: Iterable[tuple[int, int]], flexible: bool, chosen: bool) -> Iterator[tuple[int, int, int, int, str, str]]:
    """Places on a page that no span overlaps, once for a cluster; ``chosen``: that no earlier place overlaps either."""
    text, seen, taken = text or "", set(), Taken(spans)
    for k, n, a, b in variant_places(clusters, text, flexible):
        if (k, a, b) in seen:
            continue
        seen.add((k, a, b))
        if taken.take(a, b) if chosen else not taken.overlaps_spans(a, b):
            found = text[a:b]
            yield k, n, a, b, found, normalize(found)


def _listed(rows: list[list[tuple]], struct: pa.StructType) -> pa.Array:
    """Lists of tuples as lists of structs."""
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    columns = zip(*(x for row in rows for x in row), strict=True) if ends[-1] else ((),) * len(struct)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, struct, strict=True)], fields=list(struct)))


def page_places(flexible: bool = True, chosen: bool = False) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """Lists of the places of pages (texts, variants of their documents' clusters, spans) that no span overlaps, once for a cluster.

    ``chosen`` leaves those that no earlier place overlaps either.
    """

    def run(texts: pa.Array, clusters: pa.Array, spans: pa.Array) -> pa.Array:
        met = zip(texts, clusters, spans, strict=True)
        return _listed([list(_open(t.as_py(), c.as_py() or [], [(s["char_start"], s["char_end"]) for s in own.as_py() or ()], flexible, chosen)) for t, c, own in met], _PLACE)

    return run


def document_places(flexible: bool = True, chosen: bool = False) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """The same for lists of pages (page_index, text) of one document, with all their spans (page_index, char_start, char_end) in a list; places have their page's index."""

    def run(pages: pa.Array, clusters: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for come, held, taken in zip(pages, clusters, spans, strict=True):
            variants, on = held.as_py() or [], defaultdict(list)
            for s in taken.as_py() or ():
                on[s["page_index"]].append((s["char_start"], s["char_end"]))
            rows.append([(p["page_index"], *place) for p in come.as_py() or () for place in _open(p["text"], variants, on[p["page_index"]], flexible, chosen)])
        return _listed(rows, _PAGE_PLACE)

    return run


def uncovered(lists: pa.Array) -> pa.Array:
    """Of lists of spans (cluster below 0) and places (cluster, variant_no, char_start, char_end): in that order the places that no span and no place before them overlaps."""
    flat = lists.flatten()
    cluster, variant, start, stop = (flat.field(f).to_pylist() for f in ("cluster", "variant_no", "char_start", "char_end"))
    left: list[int] = []
    ends, at = [0], 0
    for n in lists.value_lengths().to_pylist():
        here = range(at, at := at + (n or 0))
        taken = Taken((start[i], stop[i]) for i in here if cluster[i] < 0)
        places: Sequence[int] = sorted((i for i in here if cluster[i] >= 0), key=lambda i: (cluster[i], variant[i], start[i], stop[i]))
        left += [i for i in places if taken.take(start[i], stop[i])]
        ends.append(len(left))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(left, pa.int64())))
