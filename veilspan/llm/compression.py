"""Operator 13: quality classifier by compression.

Two zstandard dictionaries are built, one from the labelled good texts and one
from the bad ones. A text is cut into windows of ``WINDOW`` bytes that cover it
whole; each is compressed with either dictionary, and the difference of the two
sizes, bad less good, divided by the text's bytes, says which of the two it is more
like. Windows are compressed apart, so that a long text meets the dictionaries
in every stretch and its own repeats don't hide them. A logistic curve, fitted on
labelled texts that the dictionaries were not built from, turns the difference
into a probability; a text of few bytes is drawn towards the labels' base rate.

Learning takes at most ``SAMPLE_DOCS`` labelled documents of each label, chosen
by hash, with their whole texts; it runs on the driver in about a second, a fixed
cost. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

#: Labelled documents of each label that are learned from, at most (whole texts).
SAMPLE_DOCS = 3000
#: Bytes of a window, of a dictionary, and the compression level.
WINDOW = 256
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: One labelled document in so many calibrates and is no part of a dictionary.
FOLDS = 4
#: A text of so many bytes is drawn half-way to the base rate.
HALF_BYTES = 128
_HELD_OUT = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % _HELD_OUT == 1, F.lit(False))


def windows_of(raw: bytes, size: int = WINDOW) -> list[bytes]:
    return [raw[k : k + size] for k in range(0, len(raw), size)]


@dataclass
class Model:
    """Dictionaries by label (0, 1; none: the base rate alone), the curve and the base rate's log odds."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float
    shift: float
    prior: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in self.dictionaries or ())

    def score(self, difference: float, n_bytes: int) -> float:
        trust = n_bytes / (n_bytes + HALF_BYTES)
        odds = self.prior + trust * (self.slope * difference + self.shift - self.prior) if self.dictionaries else self.prior
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def difference(raw: bytes, compressors: tuple[zstandard.ZstdCompressor, ...]) -> float:
    """Compressed bytes with the bad dictionary less those with the good one, for each byte of the text."""
    bad, good = (c.compress for c in compressors)
    return sum([len(bad(w)) - len(good(w)) for w in windows_of(raw)]) / len(raw) if raw else 0.0


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts' windows; where they are too few to train on, the windows themselves."""
    windows = [w for t in texts for w in windows_of(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, windows, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-DICTIONARY_BYTES:].rjust(8, b" ")  # raw content


def train(sample: list[tuple[int, bytes]], counts: tuple[int, int]) -> Model:
    """Learns from (label, text) in a fixed order; ``counts`` are all labelled documents by label, which weigh the sample."""
    prior = math.log((counts[1] + 1) / (counts[0] + 1))
    texts = [[t for label, t in sample if label == q and t] for q in (0, 1)]
    if not all(len(t) > 1 for t in texts):
        return Model(None, 0.0, 0.0, prior)
    fold = max(2, min(FOLDS, *map(len, texts)))
    model = Model(tuple(dictionary([t for k, t in enumerate(of) if k % fold]) for of in texts), 1.0, 0.0, prior)
    compressors = model.compressors()
    apart = [of[::fold] for of in texts]
    x = np.array([difference(t, compressors) for of in apart for t in of])
    trust = np.array([len(t) / (len(t) + HALF_BYTES) for of in apart for t in of])
    y = np.repeat([0.0, 1.0], [len(of) for of in apart])
    weight = np.repeat([counts[q] / max(1, len(apart[q])) for q in (0, 1)], [len(of) for of in apart])
    weight *= len(y) / weight.sum()
    scale = x.std() or 1.0
    inputs, found = np.stack([trust * x / scale, trust], axis=1), np.zeros(2)
    for _ in range(50):  # Newton steps of the weighted logistic fit, with a light pull to zero
        p = 1 / (1 + np.exp(-np.clip(prior * (1 - trust) + inputs @ found, -50, 50)))
        slope = inputs.T @ (weight * (y - p)) - 0.05 * found
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 0.05 * np.eye(2)
        found += np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.slope, model.shift = float(found[0] / scale), float(found[1])
    return model


def _shuffled(doc_id: int) -> tuple[int, int]:
    """A fixed shuffled order of ids, which deals the folds."""
    return (doc_id * 0x9E3779B97F4A7C15) & (1 << 64) - 1, doc_id


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the labelled rows outside the held-out fold.

    Of a document with several labels the highest counts; of several texts under
    one id one is learned. Ids are drawn first, so only their texts move.
    """
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    labelled = saved(labelled)
    found = dict(labelled.groupBy("label").count().collect())
    drawn = [labelled.where(F.col("label") == q).orderBy(F.xxhash64(F.lit("compression"), "doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)]
    ids = F.broadcast(saved(drawn[0].unionByName(drawn[1])))  # at most 2 * sample_docs
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: _shuffled(r["doc_id"]))
    return train([(r["label"], r["text"].encode("utf-8", "surrogatepass")) for r in rows], (found.get(0, 0), found.get(1, 0)))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted`` from ``text`` alone; columns of those names are replaced, all others stay."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        known = held.value
        compressors = known.compressors()
        out = []
        for t in text:
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            out.append(known.score(difference(raw, compressors) if compressors else 0.0, len(raw)))
        return pa.array(out, pa.float64())

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    # the input's columns travel as one struct, so that none can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), score.asNondeterministic()("text").alias("score"))
    return packed.select("doc.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``held_out``, ``score`` and ``predicted``.

    Null and empty texts score the base rate of the labels; without both labels
    every text does (without any, 0.5). Very long texts are compressed whole, window by
    window. Repeated rows score alike; equal scores need no order. Labels without
    an id or a quality of 0 or 1 count for nothing. An empty table gives an empty
    table. Other columns stay; those named like the results are replaced.
    """
    scored = score_texts(docs, learn(docs, labels, sample_docs))
    return scored.select(*[F.col(f"`{c}`") for c in scored.columns if c != "held_out"], held_out(F.col("doc_id")).alias("held_out"))


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
