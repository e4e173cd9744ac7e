"""Leader clustering with a candidate index: the fold of ``propagate.leader_clusters`` for documents of many texts.

Two fuzzy texts are alike from a similarity of 95 %: their edit distance d is at most a twentieth of the longer
one's length. So texts of different length are only compared within that bound; equal texts meet by a dictionary;
and an edit spoils at most ``GRAM`` grams of a text, so that two alike texts share one of the first
``GRAM * d + 1`` grams of each in any fixed order. Those prefixes are the index; candidates are then measured. The
result is the plain fold's, in its order.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Row

GRAM = 3
#: Alike from this many twentieths of the longer length in common.
_PARTS, _COMMON = 20, 19


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: only cells that near the diagonal are looked at."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[j] = i
            else:
                row[j] = min(before.get(j, far) + 1, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != b[j - 1]))
        if min(row.values()) > most:
            return False
        before = row
    return before.get(len(b), far) <= most


def most_edits(a: str, b: str) -> int:
    """The largest distance of alike texts: 1 - d / longer >= 0.95."""
    return max(len(a), len(b)) * (_PARTS - _COMMON) // _PARTS


def alike(a: str, b: str) -> bool:
    return a == b or within(a, b, most_edits(a, b))


def _prefix(text: str) -> list[tuple[int, str, int]]:
    """The first grams of a text by their hash, each with its number among equals, as many as its alike texts can spoil and one."""
    # an alike text is at most a nineteenth longer
    most = (len(text) * _PARTS // _COMMON + 1) * (_PARTS - _COMMON) // _PARTS
    seen: Counter[str] = Counter()
    grams = []
    for k in range(len(text) - GRAM + 1):
        g = text[k : k + GRAM]
        seen[g] += 1
        grams.append((int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"), g, seen[g]))
    return sorted(grams)[: GRAM * most + 1]


class Leaders:
    """Clusters in order of their first text; ``add`` joins a text to the first whose present text is alike, else starts one."""

    def __init__(self, clusters: Iterable[dict] = ()) -> None:
        self.clusters: list[dict] = []
        self._equal: dict[str, list[int]] = defaultdict(list)
        self._grams: dict[tuple, list[int]] = defaultdict(list)
        self._undo: list[Callable[[], object]] | None = None
        for c in clusters:
            self.clusters.append(dict(c))
            self._index(len(self.clusters) - 1)

    def begin(self) -> None:
        """What is added from here on can be taken back by ``undo``, at a cost of what was added."""
        self._undo = []

    def undo(self) -> None:
        for step in reversed(self._undo or ()):
            step()
        self._undo = None

    def _put(self, held: list, value: object) -> None:
        held.append(value)
        if self._undo is not None:
            self._undo.append(held.pop)

    def _index(self, at: int) -> None:
        text = self.clusters[at]["fuzzy"]
        self._put(self._equal[text], at)
        if most_edits(text, text + " "):
            for g in _prefix(text):
                self._put(self._grams[g], at)

    def find(self, fuzzy: str) -> int | None:
        """The first cluster whose present text is alike. Entries of texts that a cluster had before are passed over by the test."""
        first = min((k for k in self._equal.get(fuzzy, ()) if self.clusters[k]["fuzzy"] == fuzzy), default=None)
        if most_edits(fuzzy, fuzzy + " "):
            for k in sorted({k for g in _prefix(fuzzy) for k in self._grams.get(g, ())}):
                if first is not None and k >= first:
                    break
                if alike(self.clusters[k]["fuzzy"], fuzzy):
                    return k
        return first

    def add(self, text: str, norm_text: str, fuzzy: str, label: str, confidence: float, source: str) -> int:
        at = None if fuzzy is None else self.find(fuzzy)
        if at is None:
            self._put(self.clusters, {"text": text, "norm_text": norm_text, "fuzzy": fuzzy, "variants": [text], "label": label, "confidence": confidence, "source": source})
            if fuzzy is not None:  # a missing text is like no other
                self._index(len(self.clusters) - 1)
            return len(self.clusters) - 1
        c = self.clusters[at]
        if text not in c["variants"]:
            self._put(c["variants"], text)
        if None not in (confidence, c["confidence"]) and confidence > c["confidence"]:
            moved = fuzzy != c["fuzzy"]
            if self._undo is not None:
                self._undo.append(partial(c.update, {f: c[f] for f in ("text", "norm_text", "fuzzy", "confidence")}))
            c.update(text=text, norm_text=norm_text, fuzzy=fuzzy, confidence=confidence)
            if moved:
                self._index(at)
        return at


def clusters_of(items: list[Row] | list[dict] | None) -> list[dict] | None:
    """The clusters of a document's spans, given in order."""
    if items is None:
        return None
    found = Leaders()
    for s in items:
        found.add(s["text"], s["norm_text"], s["fuzzy"], s["label"], s["confidence"], s["source"])
    return found.clusters
