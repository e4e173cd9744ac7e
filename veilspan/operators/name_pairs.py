"""Edit distances of all pairs of names of a group, block by block.

Names of either side are packed into rows of at most ``BLOCK`` names; blocks of a group are joined, and a pair of blocks
becomes the rows of its pairs a piece at a time. Distances are Myers' bit-parallel ones for all names of a block at
once; names of the other block come sorted, so that what two neighbours begin with in common is computed once.
A task holds two blocks and a piece of rows, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most names of a block, and most rows that leave at a time.
BLOCK, PIECE = 2048, 1 << 16
#: Longest name, in code points, whose distances are taken for a whole block at once.
WORD = 64
_BLOCK_ROWS = "_group {0}, _part int, {1}_keys array<bigint>, {1}_names array<string>"
_ONE = np.uint64(1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, part, key, name) that come sorted as blocks of one group and part."""
    for batch in batches:
        group, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        at = np.arange(len(group))
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
        first = np.maximum.accumulate(np.where(new, at, 0))
        cuts = np.flatnonzero((at - first) % BLOCK == 0)
        ends = pa.array(np.append(cuts, len(group)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, batch.column(k)) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts)), batch.column(1).take(pa.array(cuts)), *lists], ["_group", "_part", "keys", "names"])


def distance(a: str, b: str) -> int:
    """The edit distance of two texts of any length."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & every, up & xh & every
        ph, mh = (ph << 1 | 1) & every, mh << 1 & every
        up, down = (mh | ~(xv | ph)) & every, ph & xv
    return len(b) + up.bit_count() - down.bit_count()


class Distances:
    """Distances of a block of names to one name after another; states of the last name's beginnings are kept."""

    def __init__(self, names: list[str]) -> None:
        self.names, self._held = names, ""
        self._long = [k for k, n in enumerate(names) if len(n) > WORD]
        short = [n if len(n) <= WORD else "" for n in names]
        sizes = np.array([len(n) for n in short], np.int64)
        self._codes = np.full((len(names), int(sizes.max(initial=0))), -1, np.int64)
        self._codes[np.arange(self._codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._mask = np.array([(1 << int(n)) - 1 for n in sizes], np.uint64)
        self._at: dict[str, np.ndarray] = {}
        self._states = [(np.full(len(names), np.uint64(2**64 - 1)), np.zeros(len(names), np.uint64))]
        self._spare = [np.empty(len(names), np.uint64) for _ in range(3)]

    def _places(self, c: str) -> np.ndarray:
        """Where a character stands in each name, as bits."""
        if c not in self._at:
            bits = _ONE << np.arange(self._codes.shape[1], dtype=np.uint64)
            self._at[c] = np.where(self._codes == ord(c), bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        return self._at[c]

    def _step(self, c: str, depth: int) -> None:
        if depth + 1 == len(self._states):
            self._states.append((np.empty_like(self._mask), np.empty_like(self._mask)))
        (up, down), (to_up, to_down), (xv, mh, ph), eq = self._states[depth], self._states[depth + 1], self._spare, self._places(c)
        np.bitwise_or(eq, down, xv)
        np.bitwise_and(eq, up, mh)
        np.add(mh, up, mh)
        np.bitwise_xor(mh, up, mh)
        np.bitwise_or(mh, eq, mh)
        np.bitwise_or(mh, up, ph)
        np.invert(ph, ph)
        np.bitwise_or(ph, down, ph)
        np.bitwise_and(mh, up, mh)
        np.left_shift(ph, _ONE, ph)
        np.bitwise_or(ph, _ONE, ph)
        np.left_shift(mh, _ONE, mh)
        np.bitwise_or(xv, ph, to_up)
        np.invert(to_up, to_up)
        np.bitwise_or(to_up, mh, to_up)
        np.bitwise_and(ph, xv, to_down)

    def to(self, name: str) -> np.ndarray:
        for k in range(len(commonprefix((self._held, name))), len(name)):
            self._step(name[k], k)
        self._held = name
        up, down = self._states[len(name)]
        # the last column's sum of steps: ups less downs, from the length of the name
        out = np.bitwise_count(up & self._mask).astype(np.int32) - np.bitwise_count(down & self._mask) + np.int32(len(name))
        for k in self._long:
            out[k] = distance(self.names[k], name)
        return out


@lru_cache(maxsize=1 << 12)
def _shares(longest: int) -> np.ndarray:
    """1 - d / longest for each d, rounded to six places as Spark does: half up, of the shortest decimal."""
    return np.array([float(Decimal(repr(1 - d / max(longest, 1))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for d in range(longest + 1)])


def similarities(distances: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    longest, out = np.maximum(sizes, size), np.empty(len(sizes))
    for n in np.unique(longest).tolist():
        here = longest == n
        out[here] = _shares(n)[distances[here]]
    return out


def _pieces(similar: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def levenshtein_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.float64() if similar else pa.int32()
        for batch in batches:
            for r in range(batch.num_rows):
                keys, names, other_keys, others = (batch.column(c)[r].values for c in ("left_keys", "left_names", "right_keys", "right_names"))
                # equal names are computed once, a missing one like an empty one
                codes = names.dictionary_encode()
                found, inverse = Distances(codes.dictionary.to_pylist() or [""]), codes.indices.fill_null(0).to_numpy(zero_copy_only=False)
                sizes = np.array([len(n) for n in found.names])
                missing = names.is_null().to_numpy(zero_copy_only=False)
                keys, other_keys, others = keys.to_numpy(zero_copy_only=False), other_keys.to_numpy(zero_copy_only=False), others.to_pylist()
                rows = max(1, PIECE // len(keys))
                for at in range(0, len(others), rows):
                    some = others[at : at + rows]
                    values, before = [], None
                    for n in some:
                        if not values or n != before:
                            d = found.to(n or "")
                            last = (similarities(d, sizes, len(n or "")) if similar else d)[inverse]
                            before = n
                        values.append(last)
                    null = np.logical_or.outer([n is None for n in some], missing).ravel() if missing.any() or None in some else None
                    columns = [np.tile(keys, len(some)), np.repeat(other_keys[at : at + rows], len(keys)), np.concatenate(values)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], kind, mask=null)], ["left_key", "right_key", "value"])

    return levenshtein_pairs


def pairs(left: DataFrame, right: DataFrame, *, similar: bool = False) -> DataFrame:
    """(left_key, right_key, value) for all pairs of rows (group, key, name) of one group: edit distance, or similarity of normal forms rounded to six places.

    A group is dealt to many tasks by parts of its left rows; the right ones, the fewer, are repeated for each part.
    """
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
    parts = max(tasks // 8, 1)

    def blocks(rows: DataFrame, side: str, part: Column) -> DataFrame:
        group, key, name = rows.columns
        kind = rows.schema[group].dataType.simpleString()
        dealt = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_group"), part.alias("_part"), F.col(key).cast("long").alias("_key"), name)
        ordered = dealt.repartition(tasks, "_group", "_part").sortWithinPartitions("_group", "_part", name)
        return ordered.mapInArrow(_packed, _BLOCK_ROWS.format(kind, side)).repartition(tasks, "_group", "_part")

    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = blocks(left, "left", F.pmod(F.xxhash64(left.columns[1]), F.lit(parts)).cast("int")).join(blocks(right, "right", each_part), ["_group", "_part"])
    rows = met.select("left_keys", "left_names", "right_keys", "right_names")
    return rows.mapInArrow(_pieces(similar), f"left_key long, right_key long, value {'double' if similar else 'int'}")
