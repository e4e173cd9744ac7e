"""Operator 5: SimHash near duplicates by tiled exact comparison.

Fingerprints are the 64 majority bits of a text's 3-word shingle hashes. Equal
fingerprints meet first (one row each, with the smallest document id). A
fingerprint's tile is the vector of the population counts of its four 16-bit
parts. The Hamming distance of two fingerprints is at least the sum of their
parts' count differences, so a pair of tiles whose counts differ by more than
the radius is skipped and the rest is compared exactly, with numpy exclusive-or
and bit counts. Each tile keeps its own fingerprints in memory (at most
``TILE_ROWS``; larger tiles are split) and its lesser neighbours' fingerprints
stream past it.

A task emits a spanning forest of the links that it finds, never all pairs of a
group; connected components then run over those edges with checkpoints.

``keep_representatives`` (the pipeline's stage) has another measure: texts whose
sets of 5-word shingles have a Jaccard similarity of ``SIMILAR`` or more. Bands
of min-hashes name candidates, and each candidate pair is verified exactly
before it links. Texts of a bucket first meet one pivot; then a bucket whose
texts are still in different components is compared in tiles, as fingerprints
are: overlaps of whole tiles are counted by matrix products inside a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_per_key, saved, small_batches, table, with_filter

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Population counts are taken of so many equal parts of the 64 bits.
PARTS = 4
#: The largest number of fingerprints that one task keeps.
TILE_ROWS = 1 << 17
_BLOCK = 2048
#: The stage's shingles, and its least similarity as a fraction.
SIMILAR_WORDS = 5
SIMILAR = (4, 5)
#: Min-hash bands and rows: a pair of similarity 0.8 meets in a band with probability 1 - (1 - 0.8^4)^20 = 0.99997.
BANDS, BAND_ROWS = 20, 4
#: The most sets, and the most shingles about, of a bucket that one task keeps at a time.
TILE_SETS, TILE_SHINGLES = 2048, 1 << 21
#: So many edges, or candidate pairs, at most may share one node: more are dealt by ``join_per_key``, or with copies of the node.
HUB_EDGES, HUB_PAIRS = 10_000_000, 1_000_000
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def _shingle_hashes(text: str | None, words: int) -> list[int]:
    """Hashes of the word shingles in order; a shorter text is one shingle (no word: none)."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return []
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = max(1, len(split) - words + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[-n:], strict=True)]


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint, as an unsigned 64-bit integer (no word: 0)."""
    hashes = _shingle_hashes(text, words)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([_signed(simhash(t.as_py())) for t in text], pa.int64())


def with_fingerprints(docs: DataFrame, column: str = "fp") -> DataFrame:
    """Adds the SimHash of ``text`` as a signed 64-bit integer."""
    return docs.withColumn(column, F.arrow_udf("long")(_fingerprints)("text"))


def _neighbour_steps(radius: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Count differences of tile pairs within the radius, one of each opposite pair."""
    steps = itertools.product(range(-radius, radius + 1), repeat=parts)
    return [s for s in steps if 0 < sum(map(abs, s)) <= radius and s > (0,) * parts]


class _Forest:
    """Union-find over integers that notes which unions joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _close(own: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(own[:, None] ^ other[None, :]) <= radius)


def _compare_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own, parts = None, np.empty(0, np.uint64), []
        ids, forest = {}, _Forest()

        def links(block: np.ndarray, other: np.ndarray, rep: np.ndarray, own_rep: np.ndarray) -> list[tuple[int, int]]:
            i, j = _close(block, other, radius)
            return [(a, b) for a, b in zip(own_rep[i].tolist(), rep[j].tolist(), strict=True) if a != b and forest.union(a, b)]

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            keys = columns[0] * 1_000_000 + columns[1]
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges: list[tuple[int, int]] = []
            for begin, end in itertools.pairwise([0, *cuts.tolist(), len(keys)]):
                if keys[begin] != task:
                    task, own, own_rep, forest = keys[begin], np.empty(0, np.uint64), np.empty(0, np.int64), _Forest()
                side = columns[2][begin:end]
                fp, rep = columns[3][begin:end].astype(np.uint64), columns[4][begin:end]
                mine = side == 0
                for k in range(0, int(mine.sum()), _BLOCK):
                    new, new_rep = fp[mine][k : k + _BLOCK], rep[mine][k : k + _BLOCK]
                    for at in range(0, len(own), _BLOCK):
                        edges += links(own[at : at + _BLOCK], new, new_rep, own_rep[at : at + _BLOCK])
                    edges += links(new, new, new_rep, new_rep)
                    own, own_rep = np.concatenate([own, new]), np.concatenate([own_rep, new_rep])
                for k in range(0, int((~mine).sum()), _BLOCK):
                    for at in range(0, len(own), _BLOCK):
                        edges += links(own[at : at + _BLOCK], fp[~mine][k : k + _BLOCK], rep[~mine][k : k + _BLOCK], own_rep[at : at + _BLOCK])
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def tile_links(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between representatives that connect all fingerprints within ``radius``.

    ``classes`` has one row per fingerprint: (fp, rep). An edge is a link or
    joins two ends of a path of links.
    """
    width = 64 // PARTS
    base = width + 1
    count = lambda k: F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(((1 << width) - 1) << (k * width)))))
    counts = [f"c{k}" for k in range(PARTS)]
    weights = [base**k for k in range(PARTS)]
    tile_of = lambda cs: sum(c * w for c, w in zip(cs, weights, strict=True)).cast("long")
    counted = classes.withColumns({c: count(k) for k, c in enumerate(counts)}).withColumn("tile", tile_of([F.col(c) for c in counts]))
    # at most 17^4 tiles whatever the input: broadcast
    tiles = saved(counted.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("splits")))
    steps = [(0,) * PARTS, *_neighbour_steps(radius)]
    targets = F.array(*[F.struct(tile_of([F.col(c) + F.lit(d) for c, d in zip(counts, step, strict=True)]).alias("tile"), F.lit(int(any(step))).alias("side"), ok(step, counts, width).alias("ok")) for step in steps])
    sent = (
        counted.select("fp", "rep", F.explode(F.filter(targets, lambda t: t["ok"])).alias("to")).select("fp", "rep", F.col("to.tile").alias("tile"), F.col("to.side").alias("side"))
        .join(F.broadcast(tiles), "tile")
        .withColumn("home", F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int"))
        # own rows stay in their split and pass by the later ones; others pass by every split
        .withColumn("split", F.explode(F.sequence(F.when(F.col("side") == 0, F.col("home")).otherwise(F.lit(0)), F.col("splits") - 1)))
        .withColumn("side", F.when((F.col("side") == 0) & (F.col("split") == F.col("home")), 0).otherwise(1))
    )
    dealt = sent.select("tile", F.col("split").cast("long").alias("split"), "side", "fp", "rep").repartition("tile", "split").sortWithinPartitions("tile", "split", "side")
    return dealt.mapInArrow(_compare_tiles(radius), "a long, b long")


def ok(step: tuple[int, ...], counts: list[str], width: int):
    """Whether a step leads to counts that exist."""
    tests = [F.col(c).between(-d, width - d) for c, d in zip(counts, step, strict=True) if d]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def connected_components(edges: DataFrame, max_rounds: int = 100, hub_edges: int | None = None) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node with an edge.

    Alternates large-star and small-star contractions until the edges no longer
    change; every round is checkpointed.
    """
    hub_edges = HUB_EDGES if hub_edges is None else hub_edges
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(pairs: DataFrame, larger: bool, n: int) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("m")).withColumn("low", F.least("u", "low"))
        # few edges fit in a task even if all are one hub's; of many, a hub's stay where they are
        joined = both.join(least, "u") if n <= hub_edges else join_per_key(both, least := saved(least), "u", n)
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    state, n = None, e.count()
    for _ in range(max_rounds):
        e = saved(star(star(e, True, n), False, n))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # finished: every node but the roots points at one root, and nothing moved
        if now == state:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``fingerprint`` and ``component_id``.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows and ids stay. A row without an id takes part: its fingerprint links
    others and gets their component, which is null only where no row of it has an id.
    Very long texts are read whole; an empty table gives an empty table; columns
    other than ``doc_id`` and ``text`` are left out, whatever their names.
    """
    small_batches(docs.sparkSession)
    fps = saved(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    n_rows = fps.count()
    # fingerprints themselves are the nodes; ids only name what is found
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")))
    parts = connected_components(tile_links(classes.select("fp", F.col("fp").alias("rep")), radius, tile_rows))
    placed = saved(classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", "m", F.coalesce("component", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = saved(join_per_key(placed.select("fp", "component", F.col("m").alias("rows")), least, "component", placed.count()).select("fp", "component_id", F.col("rows").alias("m")))
    found = join_per_key(fps, named, "fp", n_rows, "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The different 5-word shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.array(_shingle_hashes(text, SIMILAR_WORDS), np.uint64))


def _bands(shingles: np.ndarray) -> list[int]:
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), _BLOCK):
        least = np.minimum(least, ((shingles[None, k : k + _BLOCK] ^ _MASKS[:, None]) * _MULTIPLIERS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [_signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)] if len(shingles) else []


def _classes_and_bands(text: pa.Array) -> pa.Array:
    sets = [shingle_set(t.as_py()) for t in text]
    classes = pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets], pa.int64())
    return pa.StructArray.from_arrays([classes, pa.array([len(x) for x in sets], pa.int32()), pa.array([_bands(x) for x in sets], pa.list_(pa.int64()))], ["cls", "n", "bands"])


def _shingle_sets(text: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t.as_py()).view(np.int64) for t in text], pa.list_(pa.int64()))


def _with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit("again"), "text"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the ``wanted`` (cls, _h1, _h2). Texts that the filter rules out are not shuffled."""
    one = with_filter(docs, "_h1", wanted).where("_near").dropDuplicates(["_h1", "_h2"]).join(wanted, ["_h1", "_h2"])
    return one.select("cls", F.arrow_udf("array<long>")(_shingle_sets)("text").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored pairs (a, b) whose similarity is SIMILAR or more, by counting.

    A set that over a HOT_SHARE-th of all pairs need (a large bucket's pivot) is dealt
    in so many copies that none serves more than that share.
    """
    n, met = max(pairs.count(), 1), pairs
    if n <= HUB_PAIRS:  # a task can serve them all
        for side in ("a", "b"):
            met = met.join(sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"s{side}")), side)
    for side, other in (("a", "b"), ("b", "a")) if n > HUB_PAIRS else ():
        # fewer than HOT_SHARE keys, whatever the input: broadcast
        hot = F.broadcast(saved(pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) * HOT_SHARE / n).cast("int").alias("copies")).where("copies > 1")))
        copies = F.coalesce("copies", F.lit(1))
        copied = sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"s{side}")).join(hot, side, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
        met = met.join(hot, side, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies").join(copied, [side, "copy"]).drop("copy")
    common = F.size(F.array_intersect("sa", "sb"))
    return met.where(SIMILAR[1] * common >= SIMILAR[0] * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each set of ``b``, as a matrix."""
    sides = (a,) if a is b else (a, b)
    tokens, times = np.unique(np.concatenate([x for side in sides for x in side]), return_counts=True)
    tokens = tokens[times > 1]  # others are in one set only
    out = np.zeros((len(a), len(b)), np.float32)

    def cells(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
        hit = tokens[at] == flat if len(tokens) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    marks = [cells(side) for side in sides]
    for begin in range(0, len(tokens), _BLOCK):
        dense = []
        for side, (row, at) in zip(sides, marks, strict=True):
            lo, hi = np.searchsorted(at, (begin, begin + _BLOCK))
            m = np.zeros((len(side), _BLOCK), np.float32)
            m[row[lo:hi], at[lo:hi] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[-1].T
    return out


def _compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of components in streams of (bucket, split, side, component, shingles), as forests."""
    task, own, own_c, forest = None, [], np.empty(0, np.int64), _Forest()

    def links(x: list[np.ndarray], cx: np.ndarray, y: list[np.ndarray], cy: np.ndarray) -> list[tuple[int, int]]:
        if not x or not y or (x is y and (cx == cx[0]).all()):
            return []
        common = _common_counts(x, y)
        sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        i, j = np.nonzero((SIMILAR[1] * common >= SIMILAR[0] * (sizes - common)) & (cx[:, None] != cy[None, :]))
        pairs = np.unique(np.stack([np.minimum(cx[i], cy[j]), np.maximum(cx[i], cy[j])], axis=1), axis=0)
        return [(a, b) for a, b in pairs.tolist() if forest.union(a, b)]

    for batch in batches:
        bucket, split, side, component = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        shingles = batch.column(4)
        offsets, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
        sets = [flat[p:q] for p, q in itertools.pairwise(offsets.tolist())]
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(split) != 0) | (np.diff(side) != 0)) + 1
        edges: list[tuple[int, int]] = []
        for begin, end in itertools.pairwise([0, *cuts.tolist(), len(bucket)]):
            if (bucket[begin], split[begin]) != task:
                task, own, own_c, forest = (bucket[begin], split[begin]), [], np.empty(0, np.int64), _Forest()
            new, new_c = sets[begin:end], component[begin:end]
            edges += links(own, own_c, new, new_c)
            if side[begin] == 0:
                edges += links(new, new_c, new, new_c)
                own, own_c = own + [x.copy() for x in new], np.concatenate([own_c, new_c])
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def bucket_links(rest: DataFrame, sets: DataFrame, tile_sets: int = TILE_SETS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Edges (a, b) between the components of ``rest`` (bucket, cls, c, n) that some similar pair within a bucket links.

    A bucket is compared in tiles of bounded size: a task keeps one tile's sets
    and the bucket's later sets stream past it, so a set is sent once for each
    earlier tile, no pair is ever a row, and pairs of one component are passed over.
    """
    splits = F.ceil(F.greatest(F.count(F.lit(1)) / tile_sets, F.sum("n") / tile_shingles)).cast("int")
    apart = rest.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), splits.alias("splits")).where("lo <> hi").select("bucket", "splits")
    home = F.pmod(F.xxhash64("cls"), F.col("splits")).cast("int")
    sent = (
        rest.join(apart, "bucket").withColumn("home", home).join(sets, "cls")
        .select("bucket", F.explode(F.sequence("home", F.col("splits") - 1)).alias("split"), "home", "c", "shingles")
        .select("bucket", "split", F.when(F.col("split") == F.col("home"), 0).otherwise(1).alias("side"), "c", "shingles")
    )
    return sent.repartition("bucket", "split").sortWithinPartitions("bucket", "split", "side").mapInArrow(_compare_sets, "a long, b long")


def similar_components(docs: DataFrame, *, tile_sets: int = TILE_SETS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, _h1, _h2, component) of every row of ``docs`` (doc_id, text): what 5-word similarity links, also in steps.

    A class is one set of shingles, named by 64 bits of its hash; texts without
    a word are one class. Ids play no part.
    """
    small_batches(docs.sparkSession)
    hashed = _with_text_hash(docs.select("doc_id", "text"))
    marked = saved(hashed.withColumn("_m", F.arrow_udf("struct<cls: long, n: int, bands: array<long>>")(_classes_and_bands)("text")).select("doc_id", "_h1", "_h2", "_m.cls", "_m.n", "_m.bands"))
    classes = saved(marked.dropDuplicates(["cls"]).select("cls", "_h1", "_h2", "n", "bands"))
    entries = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    # another pivot in each bucket, so that a text meets several members of a large group
    pivots = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min_by("cls", F.xxhash64("bucket", "cls")).alias("pivot")).where("m > 1").drop("m")
    shared = saved(entries.join(pivots, "bucket"))
    sets = saved(_sets_of(hashed, classes.select("cls", "_h1", "_h2").join(shared.select("cls").distinct(), "cls")))
    first = saved(shared.where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct())
    links = saved(_verified(first, sets))
    tagged = saved(shared.join(connected_components(links), F.col("cls") == F.col("node"), "left").select("bucket", "cls", F.coalesce("component", "cls").alias("c"), "n"))
    more = saved(bucket_links(tagged, sets, tile_sets, tile_shingles))
    parts = connected_components(links.unionByName(more))
    return marked.join(parts, F.col("cls") == F.col("node"), "left").select("doc_id", "_h1", "_h2", F.coalesce("component", "cls").alias("component"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates (5-word similarity of 0.8): that with the smallest id.

    A row is known by its id and its text, so different texts under one id, or
    without an id, are different documents; within an id the smaller text hash
    goes first. Of rows equal in both one stays. Null ids are only kept where
    no other document of the group has one. Texts without a word are one group.
    Very long texts are compared whole; an empty table gives an empty table;
    other columns stay as they are in the row that is kept.

    Rows that a filter of fixed size shows to be alone are not shuffled.
    """
    names = ["_none", "_id", "_h1", "_h2"]  # a null id is told apart by a flag, so that equality joins and the removal of repeats share a partitioning
    named = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))}
    components = saved(similar_components(docs).withColumns(named))
    groups = saved(components.groupBy("component").agg(F.min(F.struct(*names)).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    grouped = saved(join_per_key(components, groups, "component", components.count()))
    gone = grouped.where(F.struct(*names) != F.col("first")).select(*names).distinct()
    # the input's columns travel as one struct, so that none can clash with these
    hashed = _with_text_hash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")).withColumns(named).select("_doc", *names)
    marked = with_filter(hashed, "_h1", grouped)
    met = marked.where("_near").dropDuplicates(names).join(gone, names, "left_anti")
    return marked.where("not _near").select("_doc.*").unionByName(met.select("_doc.*"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
