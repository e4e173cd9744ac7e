"""Operator 12: ranked lexical search by sort-based accumulation.

The items are the queries; they are taken in blocks of bounded size, and each
block's terms, a bounded vocabulary, travel to the texts. One pass over the texts
counts every document's terms and notes how often it holds those of the block;
these short arrays are stored, and document frequencies and lengths are summed
from them. Scoring then reads the arrays alone: each task concatenates, for
a stretch of documents, the impacts of all (item, document) matches, packs item and
document into one key, radix sorts the keys and sums the impacts of equal keys with
``reduceat``; a heap for each item selects what may still be among its best. The
tasks' selections are range-partitioned by item and score, each range keeps
the best of an item, and a window ranks the rest.

No posting is ever shuffled: what moves is, for each task and item, the best ``TOP``.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shared_folder, small_batches, table

TOP = 20
#: Bytes of item texts, and items, of one block of queries.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 1 << 16
#: Impacts that are sorted at a time, about, and the most documents (so that a place among them has 16 bits).
CHUNK_IMPACTS, CHUNK_DOCS = 1 << 20, 1 << 16
#: Bytes of text that are split at a time.
PIECE_BYTES = 1 << 20
#: Terms of UTF-8 text whose A-Z are lower-cased: letters, digits and all beyond ASCII.
_TERM, _BETWEEN = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def term_lists(text: str | None, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists of bounded size; pieces are cut between terms."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes: only A-Z change
    at = 0
    while at < len(raw):
        cut = _BETWEEN.search(raw, at + piece)
        end = cut.start() if cut else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


@dataclass
class Queries:
    """A block of items: terms by number, and for each term the items that have it, how often."""

    first: int  # the number of the block's first item
    ids: list[int | None]
    terms: dict[bytes, int]
    starts: np.ndarray  # (terms + 1): where each term's items begin
    items: np.ndarray  # places of items in the block
    times: np.ndarray


def query_block(first: int, rows: list[tuple[int | None, str | None]]) -> Queries:
    counts = [Counter(t for part in term_lists(text) for t in part) for _, text in rows]
    terms = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
    held = sorted((terms[t], item, n) for item, of in enumerate(counts) for t, n in of.items())
    term, item, times = np.array(held, np.int64).reshape(-1, 3).T
    return Queries(first, [i for i, _ in rows], terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, times)


def query_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> Iterator[Queries]:
    """The items in blocks; the driver holds one partition of them at a time. An item beyond the block's size is a block alone."""
    first, rows, size = 0, [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if rows and (size + n > block_bytes or len(rows) == block_items):
            yield query_block(first, rows)
            first, rows, size = first + len(rows), [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield query_block(first, rows)


def matches(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, counts): every document's number of terms, and which of the queries' it holds, how often.

    The arrays are packed 32-bit numbers.
    """
    held = docs.sparkSession.sparkContext.broadcast(queries.terms)  # at most a block's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        for batch in batches:
            lengths, found, counts = [], [], []
            for text in batch.column(1):
                n, seen = 0, Counter()
                for part in term_lists(text.as_py()):
                    n += len(part)
                    seen.update(filter(terms.__contains__, part))
                lengths.append(n)
                found.append(np.fromiter(map(terms.__getitem__, seen), np.uint32, len(seen)).tobytes())
                counts.append(np.fromiter(seen.values(), np.uint32, len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32) if data is not None else np.empty(0, np.uint32)
    return flat, np.diff(offsets) // 4


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if column.type != pa.binary() else column


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: summed in the tasks, at most ``n_terms`` rows from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(_binary(batch.column(0)))[0], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable ascending order of unsigned 32-bit keys, by their 16-bit digits (numpy radix sorts those)."""
    order = None
    for shift in (0, 16):
        digit = (keys >> np.uint32(shift)).astype(np.uint16)
        if order is not None:
            digit = digit[order]
        if (digit[1:] >= digit[:-1]).all():
            continue
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


class Selection:
    """For each item the best ``top`` of (score, document): higher scores first, then smaller ids, null the smallest."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]

    def offer(self, item: int, scores: np.ndarray, before: np.ndarray) -> None:
        """Documents as ``before`` numbers, of which the greater goes first."""
        heap = self.heaps[item]
        if len(heap) == self.top:
            likely = scores >= heap[0][0]
            scores, before = scores[likely], before[likely]
        if len(scores) > 4 * self.top:
            likely = scores >= np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            scores, before = scores[likely], before[likely]
        for one in zip(scores.tolist(), before.tolist(), strict=True):
            if len(heap) < self.top:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)


#: What stands for a null id while documents are compared; ids are negated bit by bit, so that smaller ids are greater.
_NO_ID = np.iinfo(np.int64).min


def best_of_tasks(found: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item, item_id, doc_id, score): for each item what may be among its best, at most ``top`` of each task."""
    held = found.sparkSession.sparkContext.broadcast((queries.starts, queries.items, queries.times * np.repeat(weights, np.diff(queries.starts)), queries.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items, times, ids = held.value
        fan_out, chosen = np.diff(starts), Selection(len(ids), top)
        for batch in batches:
            doc = batch.column(0)
            missing = doc.is_null().to_numpy(zero_copy_only=False)
            before = ~np.where(missing, _NO_ID, doc.fill_null(0).to_numpy(zero_copy_only=False))
            n = batch.column(1).to_numpy()
            terms, sizes = _numbers(_binary(batch.column(2)))
            tf = _numbers(_binary(batch.column(3)))[0].astype(np.int64)
            row = np.repeat(np.arange(len(n)), sizes)
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            ends, work = np.cumsum(sizes), np.concatenate([[0], np.cumsum(fan_out[terms])])
            begin = 0
            while begin < len(n):
                lo = int(ends[begin] - sizes[begin])
                end = int(np.searchsorted(work[ends], work[lo] + CHUNK_IMPACTS, side="right"))
                end = min(max(end, begin + 1), begin + CHUNK_DOCS, len(n))
                hi = int(ends[end - 1])
                spread = fan_out[terms[lo:hi]]
                if spread.sum():
                    match = np.repeat(np.arange(lo, hi), spread)
                    posting = np.arange(len(match)) - np.repeat(np.cumsum(spread) - spread, spread) + starts[terms[match]]
                    keys = (items[posting].astype(np.uint32) << np.uint32(16)) | (row[match] - begin).astype(np.uint32)
                    order = radix_order(keys)
                    keys = keys[order]
                    first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
                    scores = np.add.reduceat((times[posting] * value[match])[order], first)
                    keys = keys[first]
                    item, place = keys >> np.uint32(16), (keys & np.uint32(0xFFFF)).astype(np.int64) + begin
                    kept = scores > 0
                    item, place, scores = item[kept], place[kept], scores[kept]
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]]) if len(item) else [0]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        chosen.offer(int(item[a]), scores[a:b], before[place[a:b]])
                begin = end
        rows = [(queries_first + k, ids[k], None if ~b == _NO_ID else ~b, s) for k, heap in enumerate(chosen.heaps) for s, b in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["item", "item_id", "doc_id", "score"])

    queries_first = queries.first
    return found.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _first_of_items(top: int):
    """Keeps the first ``top`` rows of each item in a sorted stream whose first column is the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            kept = []
            for k, item in enumerate(batch.column(0).to_pylist()):
                last, seen = item, seen + 1 if item == last else 1
                if seen <= top:
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def ranked(selected: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) from the tasks' selections, which are few and stored."""
    order = ["item", F.desc("score"), F.asc_nulls_first("doc_id")]
    ranges = selected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_of_items(top), selected.schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order[1:]))
    return ranges.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``top`` documents of every row of ``items`` (item_id, text) among ``docs`` (doc_id, text).

    Null and empty texts have no term: such documents are never found, such items find
    none. Every row of ``items`` is a query and every row of ``docs`` a document,
    also where ids repeat or are null (a null doc_id goes first among equal scores, and
    rows that are equal in score and id are interchangeable). Very long texts are
    read whole, in pieces. An empty table on either side gives no row. Other columns
    are left out, whatever their names.

    Items travel in blocks, each with a pass over the texts; 1 MB of items is one block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    results = []
    for queries in query_blocks(items, block_bytes, block_items):
        folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
        matches(docs, queries).write.option("compression", "zstd").parquet(folder)
        found = spark.read.parquet(folder)
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms or not queries.terms:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in document_frequencies(found, len(queries.terms)).tolist()], np.int64)
        results.append(ranked(saved(best_of_tasks(found, queries, weights, n_docs, n_terms, top)), top))
    out = none
    for r in results:
        out = out.unionByName(r)
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, {_TERMS_SQL} as ts from documents),
q as (select row_number() over () as item, item_id, {_TERMS_SQL} as ts from benchmark),
sizes as (select count(*) filter (len(ts) > 0) as n_docs, sum(len(ts)) as n_terms from d),
tf as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by r, term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, sizes group by term, n_docs),
m as (select r, doc_id, 100 - 25 + (25 * len(ts) * n_docs) // n_terms as m from d, sizes where len(ts) > 0),
qt as (select item, item_id, term, count(*) as times from (select item, item_id, unnest(ts) as term from q) group by all),
scores as (
  select item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score
  from qt join w using (term) join tf using (term) join m using (r) group by all)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls first) as rank from scores where score > 0)
where rank <= {TOP}
"""
