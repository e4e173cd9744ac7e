"""Operator 7: document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its s-mers (by hash,
leftmost of equals) is its first or its last. Whether a k-mer is chosen depends
on itself alone, so an edit elsewhere never moves an anchor. A fingerprint is
all of a text's syncmers, each with the place where it first occurs: text that is
added anywhere leaves every anchor where it was. The likeness of two
fingerprints is the share of their anchors that both have and that lie on a
diagonal with others: equal stretches keep their distance, chance matches don't, and a
text that moves on by an insertion counts on both of its diagonals.

The string of a fingerprint is the number of anchors and, in base64, the anchors in order of place: the distances as bytes (255: go on
by 255 and read the next), then the hashes, 32 bits each: about 7 characters an anchor, of which a
text has one in five or six characters.

The next document in id order is found without a global sort in one task: ids
are cut into ranges of like size, each range is one sorted stream, and the first
document of every range is also sent to the end of the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

K = 16
S = 6
#: Rows of an id range, about, and the most ranges (a range is a stream, so its size is no limit of memory).
RANGE_ROWS = 5_000
MAX_RANGES = 200_000
#: Difference of shifts that still counts as one diagonal.
DRIFT = 8

_SMALLEST = -(1 << 63)


def _hash(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``width`` codes."""
    n = len(codes) - width + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Fingerprint(NamedTuple):
    """Hashes (32 bits, ascending) and the first place of each."""

    hashes: np.ndarray
    places: np.ndarray


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending, 32 bits) and first places of all closed syncmers; a text shorter than K is one anchor."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < K:
        return (_hash(codes, len(codes)) >> np.uint64(32), np.zeros(1, np.int64)) if len(codes) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    s = _hash(codes, S)
    span = K - S + 1
    n = len(codes) - K + 1
    # least s-mer of each k-mer by doubling: windows of 1, 2, 4, 8, then two that overlap
    least, size = s, 1
    while 2 * size <= span:
        least, size = np.minimum(least[: len(least) - size], least[size:]), 2 * size
    least = np.minimum(least[:n], least[span - size : span - size + n])
    places = np.flatnonzero((s[:n] == least) | (s[span - 1 : span - 1 + n] == least))
    # k-mer hashes only where they are needed
    with np.errstate(over="ignore"):
        h = np.zeros(len(places), np.uint64)
        for k in range(0, K - S + 1, S // 2):
            h = (h ^ s[places + k]) * np.uint64(0xA24BAED4963EE407)
            h ^= h >> np.uint64(31)
        h = (h ^ s[places + K - S]) * np.uint64(0x9FB21C651E98DF25)
    h >>= np.uint64(32)
    hashes, first = np.unique(h, return_index=True)
    return hashes, places[first]


def anchors(text: str) -> Fingerprint:
    """The text's fingerprint."""
    return Fingerprint(*syncmers(text))


def to_string(f: Fingerprint) -> str:
    order = np.argsort(f.places, kind="stable")
    steps = np.diff(f.places[order], prepend=0)
    many = steps // 255
    ends = np.cumsum(many + 1) - 1
    distances = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    distances[ends] = steps % 255
    return f"{len(f.hashes):x}." + base64.b64encode(distances.tobytes() + f.hashes[order].astype("<u4").tobytes()).decode()


def from_string(text: str) -> Fingerprint:
    """The fingerprint that a string stands for."""
    number, _, packed = text.partition(".")
    raw = np.frombuffer(base64.b64decode(packed), np.uint8)
    cut = len(raw) - 4 * int(number, 16)
    distances = raw[:cut].astype(np.int64)
    places, hashes = np.cumsum(distances)[distances < 255], raw[cut:].view("<u4").astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    return Fingerprint(hashes[order], places[order])


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1; two empty fingerprints are alike."""
    i, j = len(a.hashes), len(b.hashes)
    if not i or not j:
        return float(i == j)
    shared, at, other = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    shift = np.sort(a.places[at] - b.places[other])
    runs = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(shift) > DRIFT) + 1, [len(shift)]]))
    # a diagonal counts from two anchors on; the best one always does
    counted = max(int(runs[runs > 1].sum()), int(runs.max()))
    return float(counted) / (i + j - len(shared))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_id_order(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (doc_id, text) as sorted streams by ``span``; the last of each (``tail``) is the row that follows it.

    Order: doc_id, nulls first, then the text's hash. The row after the last is the first.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(_SMALLEST)))
    n, ids = keyed.count(), keyed.select("k")
    spans = int(min(MAX_RANGES, max(1, n // range_rows)))
    cuts = (ids.agg(F.percentile_approx("k", [i / spans for i in range(1, spans)], max(10_000, 10 * spans))).first()[0] or []) if spans > 1 else []
    bounds = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)))

    @F.arrow_udf("int")
    def span_of(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds.value, k.to_numpy(), side="right").astype(np.int32))

    spanned = keyed.withColumn("span", span_of("k"))
    # the first row of each span, at most MAX_RANGES of them
    least = F.broadcast(ids.withColumn("span", span_of("k")).groupBy("span").agg(F.min("k").alias("k")))
    firsts = keyed.join(least, "k").withColumn("h", F.xxhash64("text")).groupBy("span").agg(F.min_by(F.struct("doc_id", "text", "k", "h"), "h").alias("row"))
    order = Window.orderBy("span")
    after = least.select("span").withColumn("before", F.lag("span").over(order)).withColumn("before", F.coalesce("before", F.max("span").over(Window.partitionBy())))
    tails = firsts.join(F.broadcast(after), "span").select(F.col("before").alias("span"), F.lit(1).alias("tail"), "row.*")
    body = spanned.select("span", F.lit(0).alias("tail"), "doc_id", "text", "k", F.xxhash64("text").alias("h"))
    return body.unionByName(tails).repartition("span").sortWithinPartitions("span", "tail", "k", "h").select("span", "tail", "doc_id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out: list[tuple] = []
        for tail, doc_id, text in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
            mark = anchors(text)
            if held is not None:
                before_id, before, own = held
                new = edited(before, text)
                changed = anchors(new)
                out.append((before_id, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_string(own), to_string(changed), likeness(own, changed), likeness(own, mark)))
            held = None if tail else (doc_id, text, mark)
        yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(_RESULT)})


_RESULT = (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (a column of that name is replaced) from its whole ``text`` (null: empty).

    Very long texts are read whole; repeated rows get equal fingerprints; an empty table gives none.
    """

    @F.arrow_udf("string")
    def mark(text: pa.Array) -> pa.Array:
        return pa.array([to_string(anchors(t.as_py() or "")) for t in text], pa.string())

    return docs.withColumn("fingerprint", mark("text"))


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    Null texts are empty; a null doc_id comes first; repeated rows follow each
    other, rows of one id by their text's hash. A single document is its own
    next. An empty table gives none. Very long texts are compared whole. Other
    columns of ``docs`` are left out. A range is one stream of rows, so the rows
    of one id (or without an id) follow each other in one task, a row at a time.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_id_order(docs, range_rows).mapInArrow(_pairs, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
