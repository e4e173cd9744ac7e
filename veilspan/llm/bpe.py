"""Operator 9: byte-level BPE encoding and decoding by speculate and verify.

A word's proposal is the greedy longest match against the vocabulary. A
sequence of tokens is what the merges give exactly when every token is one that
the merges build and no merge across two neighbours comes before both are
complete. So a batch's proposals are verified with one vectorised test of all
their adjacent pairs, and only the words that fail it are merged exactly.
Verified words stay in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Words, and bytes of words, that a worker remembers before it starts anew.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
_NEVER = np.int64(1) << 40
_NEVER_STEP = 1 << 60


@lru_cache(maxsize=1)
def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, reversed."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Byte-level BPE from the text of a tokenizer file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.longest = max(map(len, self.ids))
        # the merge that builds each token: its rank and its two parts
        self.rank, self.left, self.right = (np.full(size, x, np.int64) for x in (-1, 0, 0))
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[raw(a)], self.ids[raw(b)]
            made = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            merges.setdefault((a, b), (r, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        # rank and result in one integer, so the least is the next merge
        self._steps = {p: (r << 20) | made for p, (r, made) in merges.items()}
        keys = np.array([(a << 32) | b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self._pairs, self._pair_rank = keys[order], np.array([r for r, _ in merges.values()], np.int64)[order]
        merged = np.flatnonzero(self.rank >= 0)
        self.sound = np.zeros(size, bool)
        self.sound[[i for b, i in self.ids.items() if len(b) == 1]] = True
        inner = np.zeros(size, bool)
        inner[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for i in merged[np.argsort(self.rank[merged], kind="stable")].tolist():  # parts come before what is built of them
            self.sound[i] = inner[i] and self.sound[self.left[i]] and self.sound[self.right[i]]
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ids_of: dict[str, str] = {}
        self._decoded_of: dict[str, bytes] = {}
        # the pattern's matches never mix letters with a space that follows them
        self._marked = {content: f"x {content}" for content in self.special}
        self._held = 0
        self._forget()

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair; _NEVER where there is no such merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_rank[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges never join across each pair (until rank ``before``).

        The two sides' last merges are undone from the latest back. While the
        sides are (x, y), the pair (x, y) could be joined from the time that
        both exist until the later of the merges undone so far; a join of lower
        rank than that would have come first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        until = np.full(len(a), _NEVER - 1) if before is None else before.astype(np.int64) - 1
        # equal ranks go left first: a merge undone on the right side of the boundary also excludes joins of its own rank
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            fails = self._rank_of(x, y) <= until[live]
            good[live[fails]] = False
            rx, ry = self.rank[x], self.rank[y]
            ends = (rx < 0) & (ry < 0)
            stay = ~fails & ~ends
            live, x, y, rx, ry = (v[stay] for v in (live, x, y, rx, ry))
            undo_left = rx > ry
            # the left token's merge came later: its right part faced y before; a join of the same rank lies further right and comes after it
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            until[live] = np.where(undo_left, rx - 1, ry)
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """The merges in order: lowest rank first, leftmost of equals."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self._steps.get, _NEVER_STEP
        steps = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while steps and (least := min(steps)) != none:
            i = steps.index(least)
            ids[i : i + 2] = [least & 0xFFFFF]
            del steps[i]
            if i:
                steps[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(steps):
                steps[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        import heapq

        n = len(ids)
        after, prior, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self._steps.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m >> 20, i, ids[i], ids[after[i]], m & 0xFFFFF))

        for i in range(n):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            offer(prior[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Each word's tokens: proposals, one test of all adjacent pairs, exact merges where it fails."""
        proposals = [[i] if (i := self.ids.get(w)) is not None else self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        bad[owner[inside[~good]]] = True
        for k in np.flatnonzero(bad).tolist():
            proposals[k] = self.merge_exactly(words[k])
        return proposals

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: the number of ids, the ids in decimal with commas, and the decoded bytes."""
        ids_of, decoded_of, pieces = self._ids_of, self._decoded_of, []
        for text in texts:
            if not self.split_special or not self.split_special.search(text or ""):
                pieces.append(self.pattern.findall(text) if text else [])
                continue
            found: list[str] = []
            for k, part in enumerate(self.split_special.split(text)):
                # a special token is a word of its own, which no match of the pattern equals
                found += [self._marked[part]] if k % 2 else self.pattern.findall(part)
            pieces.append(found)
        new = set().union(*pieces).difference(ids_of)
        self._held += sum(map(len, new))
        if len(ids_of) + len(new) > CACHE_WORDS or self._held > CACHE_BYTES:
            self._forget()
            new = set().union(*pieces).difference(ids_of)
            self._held = sum(map(len, new))
        ordered = sorted(new)
        for word, ids in zip(ordered, self.encode_words([w.encode() for w in ordered]) if ordered else [], strict=True):
            ids_of[word] = ",".join(map(str, ids))
            decoded_of[word] = b"".join([self.bytes_of[i] for i in ids])
        for found in pieces:
            ids = ",".join(map(ids_of.__getitem__, found))
            yield ids.count(",") + 1 if ids else 0, ids.encode(), b"".join(map(decoded_of.__getitem__, found))

    def _forget(self) -> None:
        """Empties the word cache but for the special tokens."""
        self._ids_of.clear()
        self._decoded_of.clear()
        for content, i in self.special.items():
            self._ids_of[self._marked[content]], self._decoded_of[self._marked[content]] = str(i), self.bytes_of[i]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """The vocabulary of this process, built once from the file's text."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, *, keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every ``text``: ``n_tokens``, digests and, on request, the ids and the decoded text.

    ``tokenizer_path`` is a tokenizer file on the driver; its text (a fixed
    vocabulary of a few MB, whatever the corpus) is broadcast. Null and empty
    texts give no token. All columns of ``docs`` stay but those named like the
    results. Very long texts and words are encoded whole. Repeated rows are coded
    alike; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:string,decoded:string>" if keep_text else ">")

    def encode(text: pa.Array) -> pa.Array:
        v = vocabulary(held.value)
        columns: list[list] = [[], [], [], [], []]
        for at in range(0, len(text), 64):
            for n, ids, decoded in v.encode_batch(text.slice(at, 64).to_pylist()):
                whole = decoded.decode("utf-8", "replace")
                row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(whole.encode()).hexdigest(), ids.decode(), whole)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if keep_text else 3]
        types = [pa.int64(), *[pa.string()] * 4]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False)], names=names)

    coded = F.arrow_udf(kind)(encode).asNondeterministic()  # else a filter on the result would run it twice
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]
    rest = [c for c in docs.columns if c not in results]
    # the input's columns travel as one struct, so that none can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), coded("text").alias("coded"))
    return packed.select("doc.*", *[F.col(f"coded.{c}") for c in results])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, tokenizer_path or default_tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
