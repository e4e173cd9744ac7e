"""Operator 3: drop lines that many documents share.

The distinct line keys of the corpus are counted by two 64-bit hashes (128 bits
together, so lines themselves never travel). Keys that reach ``min_docs`` are
dealt to shards of bounded size. Each shard gets a minimal perfect hash: a
displacement table maps every key to its own slot, and the slot holds a
fingerprint (the second hash) and the document count. Documents probe those
arrays with their keys' hashes; no line is joined. A key below the threshold
is in no shard; its slot holds another key's fingerprint, so the probe answers
"not frequent".

Keys below the threshold are pruned before the arrays are built, which keeps
the probes exact: whatever slot such a key leads to holds another fingerprint.

Two ways of probing give the same rows. An index of at most
``broadcast_bytes`` (measured, not guessed) is broadcast and probed in place.
A larger one stays distributed: the documents' hashes and the shards meet by
(shard, salt), each task keeps one shard's arrays while hashes stream past in
batches, and the keys that hit go back to the documents by a hash of their
text. Documents that a filter of fixed size shows to have no hit are not moved,
nor are copies of a text that very many documents have; no text is stored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, join_per_key, saved, sha256_hex, small_batches, table, with_filter

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of one shard, about; the shard's arrays then take some 20 MB.
SHARD_KEYS = 1_000_000
#: The largest index that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Copies of each shard when it isn't broadcast, so that a hot key's probes spread.
SALTS = 16
_MEAN_BUCKET = 4
_SHARD_SCHEMA = "shard long, size long, displacement binary, fingerprint binary, doc_count binary"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Adds the lines and, for each, its two hashes (0, 0 stands for a key that is too short to count)."""
    keys = F.transform("lines", line_key)
    short = lambda k: F.length(k) < min_chars
    return (
        docs.withColumn("lines", lines_of(F.col("text")))
        .withColumn("keys", keys)
        .withColumn("h1", F.transform("keys", lambda k: F.when(short(k), F.lit(0)).otherwise(F.xxhash64(k))))
        .withColumn("h2", F.transform("keys", lambda k: F.when(short(k), F.lit(0)).otherwise(F.xxhash64(F.lit("fingerprint"), k))))
    )


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser of key and seed (uint64, wrapping)."""
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def build_perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets, and the slot of each key: a bijection to 0..n-1.

    Keys go to buckets by ``h1``. Buckets are placed from the largest down; all
    buckets of one size try a displacement at once, and those whose slots are
    free and distinct stay.
    """
    n = len(h1)
    buckets = max(1, n // _MEAN_BUCKET)
    key = h1.astype(np.uint64) ^ _mix(h2.astype(np.uint64), 7)
    home = (_mix(h1.astype(np.uint64), 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    taken, slot, displacement = np.zeros(n, bool), np.empty(n, np.int64), np.zeros(buckets, np.int32)
    for size in range(int(sizes.max(initial=0)), 0, -1):
        left = np.flatnonzero(sizes == size)
        if not len(left):
            continue
        members = order[starts[left][:, None] + np.arange(size)]
        if size == 1:
            # What is left over is dealt straight: -1 - slot marks a direct slot.
            free = np.flatnonzero(~taken)
            slot[members[:, 0]] = free
            taken[free] = True
            displacement[left] = -1 - free
            continue
        trial = 1
        while len(left):
            place = (_mix(key[members], trial) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(place, axis=1)
            good = ~taken[place].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            # of buckets that want the same slot in this trial, the first keeps it
            rows = np.repeat(np.flatnonzero(good), size)
            first = np.full(n, len(left), np.int64)
            np.minimum.at(first, place[good].ravel(), rows)
            good[good] = (first[place[good]] == np.flatnonzero(good)[:, None]).all(axis=1)
            slot[members[good]] = place[good]
            taken[place[good]] = True
            displacement[left[good]] = trial
            left, members, trial = left[~good], members[~good], trial + 1
    return displacement, slot


def probe_perfect_hash(h1: np.ndarray, h2: np.ndarray, shard: dict[str, np.ndarray]) -> np.ndarray:
    """The document count of each key, 0 for keys that aren't in the shard."""
    n = len(shard["fingerprint"])
    if not n:
        return np.zeros(len(h1), np.int64)
    u1, u2 = h1.astype(np.uint64), h2.astype(np.uint64)
    d = shard["displacement"][(_mix(u1, 1) % np.uint64(len(shard["displacement"]))).astype(np.int64)]
    hashed = (_mix(u1 ^ _mix(u2, 7), np.maximum(d, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    slot = np.where(d < 0, -1 - d, hashed)
    return np.where(shard["fingerprint"][slot] == h2, shard["doc_count"][slot], 0)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    # one key cannot be split: a second key with the same h1 and another h2 is told apart by both hashes
    h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
    displacement, slot = build_perfect_hash(h1, h2)
    fingerprint, doc_count = np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
    fingerprint[slot], doc_count[slot] = h2, pdf["n_docs"].to_numpy()
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "size": [len(h1)], "displacement": [displacement.tobytes()], "fingerprint": [fingerprint.tobytes()], "doc_count": [doc_count.tobytes()]})


def _arrays(displacement: bytes, fingerprint: bytes, doc_count: bytes) -> dict[str, np.ndarray]:
    return {"displacement": np.frombuffer(displacement, np.int32), "fingerprint": np.frombuffer(fingerprint, np.int64), "doc_count": np.frombuffer(doc_count, np.int64)}


def count_line_keys(hashed: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs) of the keys in at least ``min_docs`` documents."""
    once = F.array_distinct(F.arrays_zip("h1", "h2"))
    return (
        hashed.select(F.explode(once).alias("k")).select("k.h1", "k.h2").where("h1 <> 0 or h2 <> 0")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    )


def build_index(keys: DataFrame, n_keys: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row of arrays for each shard, and the number of shards."""
    shards = max(1, -(-n_keys // shard_keys))
    dealt = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_build_shard, _SHARD_SCHEMA), shards


def _probe_broadcast(hashed: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    rows = {r["shard"]: _arrays(r["displacement"], r["fingerprint"], r["doc_count"]) for r in index.collect()}
    held = hashed.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("array<boolean>")
    def frequent(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in (h1, h2))
        out, home = np.zeros(len(a), bool), np.mod(a, shards)
        for shard, arrays in held.value.items():
            mine = np.flatnonzero(home == shard) if shards > 1 else slice(None)
            out[mine] = probe_perfect_hash(a[mine], b[mine], arrays) > 0
        out &= (a != 0) | (b != 0)
        sizes = np.diff(h1.offsets.to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    # as if nondeterministic, else a filter on the result would run it twice
    return hashed.withColumn("drop", frequent.asNondeterministic()("h1", "h2"))


def _probe_dealt(hashed: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Hashes meet the shards' arrays by (shard, salt); the keys that hit go back to the documents by their text's hash."""
    named = hashed.withColumn("content", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("content"), "text").alias("b")))
    empty = {c: F.lit(None).cast("binary") for c in ("displacement", "fingerprint", "doc_count")}
    probes = (
        named.select("content.a", "content.b", F.explode(F.array_distinct(F.arrays_zip("h1", "h2"))).alias("k")).select("a", "b", "k.h1", "k.h2").where("h1 <> 0 or h2 <> 0")
        .select(F.pmod("h1", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("a", "h2"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("kind"), "a", "b", "h1", "h2").withColumns(empty)
    )
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "h1", "h2")], *empty)
    met = copies.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, at = None, None
        for batch in batches:
            place = batch.column("shard").to_numpy() * SALTS + batch.column("salt").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(place)) + 1
            for begin, end in itertools.pairwise([0, *cuts.tolist(), len(place)]):
                part, copies = batch.slice(begin, end - begin), int((kind[begin:end] == 0).sum())
                if copies:  # a shard's arrays come before its probes
                    arrays, at = _arrays(*(part.column(c)[0].as_py() for c in ("displacement", "fingerprint", "doc_count"))), place[begin]
                asked = part.slice(copies)
                if len(asked) and at == place[begin]:
                    h1, h2 = (asked.column(c).to_numpy() for c in ("h1", "h2"))
                    hit = pa.array(probe_perfect_hash(h1, h2, arrays) > 0)
                    yield pa.RecordBatch.from_arrays([asked.column(c).filter(hit) for c in ("a", "b", "h1", "h2")], ["a", "b", "h1", "h2"])

    hits = met.mapInArrow(stream, "a long, b long, h1 long, h2 long")
    # m counts a text's hits in all its copies, so it is at least the number of copies
    per_text = saved(hits.groupBy("a", "b").agg(F.array_distinct(F.collect_set(F.struct("h1", "h2"))).alias("hits"), F.count(F.lit(1)).alias("m")).select(F.struct("a", "b").alias("content"), "hits", "m"))
    n_hits = per_text.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]

    @F.arrow_udf("array<boolean>")
    def frequent(h1: pa.Array, h2: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for a, b, found in zip(h1, h2, hits, strict=True):
            known = {(k["h1"], k["h2"]) for k in found.as_py() or ()}
            out.append([k in known for k in zip(a.as_py(), b.as_py(), strict=True)])
        return pa.array(out, pa.list_(pa.bool_()))

    marked = with_filter(named.withColumn("_a", F.col("content.a")), "_a", per_text.select(F.col("content.a").alias("_a")))
    clear = marked.where("not _near").withColumn("drop", F.transform("h1", lambda _: F.lit(False)))
    joined = join_per_key(marked.where("_near"), per_text, "content", n_hits, "left")
    flagged = joined.withColumn("drop", frequent.asNondeterministic()("h1", "h2", "hits")).drop("hits")
    return clear.unionByName(flagged).drop("content", "_a", "_near")


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drops every line whose key occurs in at least ``min_docs`` documents.

    A text is split at line feeds (null or empty: one empty line). A line's key
    is the line without outer white space, A-Z lower-cased; keys under
    ``min_chars`` code points always stay. Returns all columns of ``docs`` with
    ``text`` rewritten, plus ``n_lines`` and ``n_dropped``. Repeated rows are
    documents of their own, ids play no part. Very long texts and lines are read
    whole. An empty table gives an empty table. Columns of ``docs`` named
    like the results are replaced; those with the helpers' names are kept apart.
    """
    small_batches(docs.sparkSession)
    extra = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in extra]).alias("rest") if extra else F.lit(None).cast("int").alias("rest"), F.col("text"))
    hashed = with_line_hashes(packed, min_chars)
    keys = saved(count_line_keys(hashed, min_docs))
    n_keys = keys.count()
    index, shards = build_index(keys, n_keys, shard_keys)
    size = n_keys * 17 + 256 * shards
    probed = (_probe_broadcast if size <= broadcast_bytes else _probe_dealt)(hashed, index, shards)
    kept = F.filter("lines", lambda _, i: ~F.get("drop", i))
    out = probed.withColumn("kept", kept)
    return out.select(
        *[F.col(f"rest.`{c}`").alias(c) for c in extra],
        F.array_join("kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


_STRIPPED = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

ORACLE = rf"""
with lines as (
  select doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select doc_id, text, row_number() over () as rid from documents)
), keyed as (
  select doc_id, rid, pos, line, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), frequent as (
  select k from keyed where length(k) >= {MIN_CHARS} group by k having count(distinct rid) >= {MIN_DOCS}
)
select doc_id, count(*)::bigint as n_lines, count(f.k)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
from keyed left join frequent f using (k) group by doc_id, rid
"""
