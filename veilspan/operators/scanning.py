"""Batches of texts scanned by patterns with Arrow, and batches of span lists resolved with numpy.

These are the bodies of Arrow functions: a batch's texts are one byte buffer, on which all
places are numbers. Arrow's patterns run in time linear in the text, and their ``\\b`` is the
ASCII one. Marks are bytes that no UTF-8 text holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import SPACES, spaced

#: Bytes of text that are scanned at a time, and spans that are worked on at a time: a worker holds some 30 times as many bytes of text.
BLOCK_BYTES, BLOCK_SPANS = 1 << 20, 1 << 14
SPAN = pa.struct([("ord", pa.int64()), ("label", pa.string()), ("text", pa.string()), ("norm_text", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
#: A pattern, the test of its matches' digits (see ``passing``), and whether matches inside a strictly longer earlier one are dropped.
Scanner = tuple[str, str, bool]


def arrow_pattern(pattern: str) -> str:
    """A pattern in Arrow's spelling: code points in braces, and a vertical tab is white space."""
    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern).replace(r"\s", r"\s\x0B")


_SPACES = arrow_pattern(SPACES)
_OUTER, _RUN = f"^[{_SPACES}]+|[{_SPACES}]+$", arrow_pattern(spaced(r"\s+"))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of large strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets - offsets[0], np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _pieces(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(stop - start)])
    return _strings(offsets, data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], stop - start)])


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case; Arrow does it up to U+00FF, beyond a letter's place can matter (final sigma)."""
    if (_buffers(texts)[1] < 0xC4).all():
        return pc.utf8_lower(texts)
    return pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())


def _matches(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of all matches; every mark before a place has moved it by one."""
    marked = _buffers(pc.replace_substring_regex(texts, pattern, b"\xff\\0\xfe"))[1]
    at = np.flatnonzero(marked >= 0xFE)
    at = at - np.arange(len(at))
    return at[::2], at[1::2]


def passing(test: str, digits: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which matches pass: ``ten`` for ten digits or more, ``siren`` for nine or fourteen whose first nine pass the Luhn sum."""
    n = last - first
    if test == "ten":
        return n >= 10
    out = np.isin(n, (9, 14))
    nine = digits[first[out][:, None] + np.arange(9)].astype(np.int64)
    nine[:, 1::2] *= 2
    out[out] = (nine - 9 * (nine > 9)).sum(axis=1) % 10 == 0
    return out


def _scan(texts: pa.Array, scanners: Sequence[Scanner], labels: Sequence[str], confidences: Sequence[float], resolved: bool) -> tuple[np.ndarray, pa.Array]:
    offsets, data = _buffers(texts)
    if (data >= 0xFE).any():  # no UTF-8: such a byte is part of no match
        data = np.where(data >= 0xFE, 0, data).astype(np.uint8)
        texts = _strings(offsets, data)
    is_digit = (data >= 48) & (data <= 57)
    digits, before = data[is_digit] - 48, np.concatenate([[0], np.cumsum(is_digit)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    found = []
    for k, (pattern, test, _) in enumerate(scanners):
        a, z = _matches(texts, pattern)
        if test:
            good = passing(test, digits, before[a], before[z])
            a, z = a[good], z[good]
        found.append((a, z, np.full(len(a), k)))
    start, stop, kind = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    # longest first at each place: an equal place is the neighbour before, and what reaches furthest of all before holds a match if anything does
    order = np.lexsort((kind, -stop, start))
    start, stop, kind = start[order], stop[order], kind[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    for k, (_, _, within_longer) in enumerate(scanners):
        if within_longer and len(start):
            reach = np.concatenate([[-1], np.maximum.accumulate(np.where(kind < k, stop, -1))[:-1]])
            keep &= ~((kind == k) & (reach >= stop))
    start, stop, kind = start[keep], stop[keep], kind[keep]
    row = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((start, kind, row))
    start, stop, kind, row = start[order], stop[order], kind[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    a, z = points[start] - points[offsets[row]], points[stop] - points[offsets[row]]
    if resolved:
        left = np.sort(greedy(row, a, z, scores(np.array(confidences)[kind], np.zeros(len(kind)), z - a), number))
        start, stop, kind, row, number, a, z = (c[left] for c in (start, stop, kind, row, number, a, z))
    text = _pieces(data, start, stop)
    norm = _lower(pc.replace_substring_regex(pc.replace_substring_regex(text, _OUTER, ""), _RUN, " "))
    source = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(kind), np.int32)), pa.array(["regex"])).cast(pa.string())
    fields = [pa.array(number, pa.int64()), pa.array(list(labels), pa.string()).take(pa.array(kind)), text.cast(pa.string()), norm.cast(pa.string()), pa.array(np.array(confidences, float)[kind]), source, pa.array(a, pa.int32()), pa.array(z, pa.int32())]
    return np.bincount(row, minlength=len(texts)), pa.StructArray.from_arrays(fields, fields=list(SPAN))


def _blocks(offsets: np.ndarray, most: int) -> list[int]:
    """Where blocks of rows begin and end: a block has one row, or at most as many bytes or spans."""
    cuts = [0]
    while cuts[-1] < len(offsets) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + most, "right")) - 1))
    return cuts


def scanner(scanners: Sequence[Scanner], labels: Sequence[str], confidences: Sequence[float], resolved: bool) -> Callable[[pa.Array], pa.Array]:
    """Lists of the raw (or resolved) spans of texts."""

    def spans(text: pa.Array) -> pa.Array:
        texts = pc.fill_null(text.cast(pa.large_string()), "")
        cuts = _blocks(_buffers(texts)[0], BLOCK_BYTES)
        parts = [_scan(texts[i:j], scanners, labels, confidences, resolved) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        counts = np.concatenate([np.zeros(1, np.int64), *[p[0] for p in parts]])
        flat = pa.concat_arrays([p[1] for p in parts]) if parts else pa.array([], SPAN)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), flat)

    return spans


def scores(confidence: np.ndarray, bonus: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``spans.score`` of columns."""
    return confidence * 100 + bonus + length * 0.1


def greedy(row: np.ndarray, start: np.ndarray, stop: np.ndarray, score: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Indexes of the spans that the greedy resolution of each row keeps (``spans.resolved_items``).

    Spans that touch no other are kept at once; the others are swept run by run, and a step
    looks only at the kept spans that reach its place.
    """
    order = np.lexsort((number, -score, start, row))
    if not len(order):
        return order
    r, a, z = row[order], start[order], stop[order]
    width = int(max(z.max(), a.max())) + 1
    reach = np.maximum.accumulate(r * width + np.maximum(a, z))
    begins = np.concatenate([[True], (r[1:] != r[:-1]) | (reach[:-1] <= r[1:] * width + a[1:])])
    cuts = np.append(np.flatnonzero(begins), len(order))
    alone = np.diff(cuts) == 1
    kept = [order[cuts[:-1][alone]]]
    a, z, s, at = a.tolist(), z.tolist(), score[order].tolist(), order.tolist()
    out: list[int] = []
    for i, j in zip(cuts[:-1][~alone].tolist(), cuts[1:][~alone].tolist(), strict=True):
        active: list[int] = []
        for x in range(i, j):
            out += [at[y] for y in active if z[y] <= a[x]]
            active = [y for y in active if z[y] > a[x]]
            against = [y for y in active if a[y] < z[x] and (min(z[y], z[x]) - max(a[y], a[x])) / max(min(z[y] - a[y], z[x] - a[x]), 1) > 0.5]
            if not any(s[y] >= s[x] for y in against):
                active = [y for y in active if y not in against] + [x]
        out += [at[y] for y in active]
    return np.concatenate([*kept, np.array(out, np.int64)])


_BONUS = {"ner": 10.0, "user": 1000.0}


def _numbers(spans: pa.StructArray, name: str, dtype: type) -> np.ndarray:
    return spans.field(name).to_numpy(zero_copy_only=False).astype(dtype)


def processed(unique: bool, resolved: bool) -> Callable[[pa.Array], pa.Array]:
    """Lists of span structs: only the first (by ``ord``) of each place and label, and resolved, as asked."""

    def every(lists: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        cuts = _blocks(ends, BLOCK_SPANS)
        return pa.concat_arrays([run(lists.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] or [run(lists)])

    def run(lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        number, a, z = _numbers(flat, "ord", np.int64), _numbers(flat, "char_start", np.int64), _numbers(flat, "char_end", np.int64)
        left = np.arange(len(row))
        if unique:
            codes = flat.field("label").dictionary_encode().indices
            label = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
            order = np.lexsort((number, label, z, a, row))
            same = np.ones(max(len(order) - 1, 0), bool)
            for c in (row, a, z, label):
                same &= c[order][1:] == c[order][:-1]
            left = order[np.concatenate([np.ones(min(len(order), 1), bool), ~same])]
        if resolved:
            source = flat.field("source").dictionary_encode()
            bonus = np.array([_BONUS.get(x, 0.0) for x in source.dictionary.to_pylist()] + [0.0])[pc.fill_null(source.indices, -1).to_numpy(zero_copy_only=False)]
            score = scores(_numbers(flat, "confidence", float), bonus, z - a)
            left = left[greedy(row[left], a[left], z[left], score[left], number[left])]
        left = np.sort(left)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=len(counts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(left)))

    return every


def word_numbers(texts: pa.Array, lists: pa.Array) -> pa.Array:
    """For each span of each text the numbers of the words (runs without ASCII white space) that it touches."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets, data = _buffers(texts)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.ones(len(data), bool)  # also the first of its text
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, stops = points[np.flatnonzero(inside & first)], points[np.flatnonzero(inside & last) + 1]
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    base = points[offsets[np.repeat(np.arange(len(counts)), counts)]]
    a, z = _numbers(flat, "char_start", np.int64) + base, _numbers(flat, "char_end", np.int64) + base
    begin = np.searchsorted(stops, a, "right")
    end = np.maximum(np.searchsorted(starts, z, "left"), begin)
    number = begin - np.searchsorted(starts, base)
    ids = np.repeat(number - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(int((end - begin).sum()))
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]), pa.int32()), pa.array(ids, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), inner)
