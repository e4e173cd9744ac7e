"""Operator 2: language identification with a byte convolutional network.

Text becomes bytes (lower-cased, ASCII non-letters as spaces) in windows
of ``WINDOW`` bytes that cover the whole text. The network embeds bytes, applies
filters of several widths, takes each filter's maximum over the window, and
ends in a softmax; a document's scores are its windows' mean log-probabilities,
weighted by their letters. It is trained in numpy on a bounded sample of labelled text.
At prediction the embedding and the filters are folded into tables over byte
pairs, so a window costs a few table reads and additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled documents of each language that training sees, about (whole texts).
SAMPLE_DOCS = 200
#: Labelled documents of all languages together, about: many languages share it, each with one at least.
SAMPLE_TOTAL = 4_000
FOLDS = 5
UNDETERMINED = "und"
_EPOCHS, _BATCH, _RATE = 10, 64, 0.01
_CHUNK = 32

#: ASCII letters lower-cased, other ASCII as spaces, bytes of other characters as they are.
_NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes that cover the text, padded with spaces."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_NORMAL)
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b" "), np.uint8).reshape(n, size)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, e)
    filters: list[np.ndarray]  # one (width, e, f) per width
    bias: np.ndarray  # (all filters)
    out: np.ndarray  # (all filters + 1, languages)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a byte pair adds at its place (all filters), a third byte, and the pair after."""
        byte = [[self.embedding @ w[k] for k in range(len(w))] for w in self.filters]
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)
        return np.concatenate([pair(t, 0) for t in byte], axis=1).astype(np.float32), byte[1][2].astype(np.float32), pair(byte[2], 2).astype(np.float32)

    def pooled(self, windows: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """(n, all filters): the largest response of each filter in each window."""
        first, third, second = tables
        n, size = windows.shape
        places = size - max(WIDTHS) + 1
        out = np.empty((n, first.shape[1]), np.float32)
        for at in range(0, n, _CHUNK):
            w = windows[at : at + _CHUNK]
            pairs = (w[:, :-1].astype(np.int32) << 8) | w[:, 1:]
            r = first[pairs[:, :places]]
            r[:, :, FILTERS : 2 * FILTERS] += third[w[:, 2 : 2 + places]]
            r[:, :, 2 * FILTERS :] += second[pairs[:, 2 : 2 + places]]
            out[at : at + _CHUNK] = r.max(axis=1)
        return np.maximum(out + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        z = self.pooled(windows, tables)
        z = z @ self.out[:-1] + self.out[-1]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[str], labels: list[str], seed: int = 0) -> Network:
    """Trains on windows of the texts; shorter random crops stand for short documents."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    every = [windows_of(t) for t in texts]
    x = np.concatenate(every)
    y = np.repeat([languages.index(v) for v in labels], [len(w) for w in every])
    crop = np.array(x)
    begins, lengths = rng.integers(0, WINDOW // 2, len(x)), rng.integers(12, WINDOW, len(x))
    place = np.arange(WINDOW)
    crop[(place < begins[:, None]) | (place >= (begins + lengths)[:, None])] = 32
    x, y = np.concatenate([x, crop]), np.concatenate([y, y])
    full = (x != 32).sum(axis=1) >= 4
    x, y = x[full], y[full]
    share = np.bincount(y, minlength=len(languages)) / max(1, len(y))
    weight = 1 / np.maximum(share, 1e-9)[y] / len(languages)

    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "b": np.zeros(FILTERS * len(WIDTHS)), "o": np.zeros((FILTERS * len(WIDTHS) + 1, len(languages)))}
    p |= {f"f{k}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for k, w in enumerate(WIDTHS)}
    p["o"][:-1] = rng.normal(0, 0.2, p["o"][:-1].shape)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    places = WINDOW - max(WIDTHS) + 1
    for _ in range(_EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), _BATCH):
            chosen = order[at : at + _BATCH]
            w, target, gain = x[chosen], y[chosen], weight[chosen]
            n = len(w)
            best, peak = [], []
            for k, width in enumerate(WIDTHS):
                r = sum((p["e"] @ p[f"f{k}"][j]).astype(np.float32)[w[:, j : j + places]] for j in range(width))
                at_max = r.argmax(axis=1)
                best.append(at_max)
                peak.append(np.take_along_axis(r, at_max[:, None, :], 1)[:, 0])
            h = np.maximum(np.concatenate(peak, axis=1) + p["b"], 0)
            z = h @ p["o"][:-1] + p["o"][-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(n), target] -= 1
            d *= gain[:, None] / n
            g = {"o": np.concatenate([h.T @ d, d.sum(axis=0, keepdims=True)])}
            back = (d @ p["o"][:-1].T) * (h > 0)
            g["b"], g["e"] = back.sum(axis=0), np.zeros_like(p["e"])
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"f{k}"] = np.zeros_like(p[f"f{k}"])
                for j in range(width):
                    byte = w[np.arange(n)[:, None], best[k] + j]  # (n, filters)
                    g[f"f{k}"][j] = np.einsum("nf,nfe->ef", part, p["e"][byte])
                    np.add.at(g["e"], byte, part[:, :, None] * p[f"f{k}"][j].T[None])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= _RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"f{k}"] for k in range(len(WIDTHS))], p["b"].astype(np.float32), p["o"].astype(np.float32))


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``sample_docs`` documents a language, chosen by hash; texts are whole.

    Only documents outside the held-out fold with a label and a letter count.
    Languages are counted first (their columns alone are read), and each is
    learned; ``SAMPLE_TOTAL`` bounds what the driver gets, where one document of
    each language is not more. Rows of one id are drawn together.
    """
    labelled = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = saved(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    languages = counts.count()
    if not languages:
        return [], []
    sample_docs = max(1, min(sample_docs, SAMPLE_TOTAL // languages))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # a row a language: broadcast
    chosen = labelled.join(F.broadcast(counts), "lang").where((draw * F.col("_n") < 2 * sample_docs) & F.col("text").rlike(r"\p{L}"))
    # the expected number is at most twice the parameter for each language; the excess goes here
    rows = chosen.select("lang", draw.alias("draw"), "text").collect()
    kept: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        if len(mine := kept.setdefault(r["lang"], [])) < sample_docs:
            mine.append(r["text"])
    return [t for k in sorted(kept) for t in kept[k]], [k for k in sorted(kept) for _ in kept[k]]


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` from ``text`` alone; columns of those names are replaced.

    Null texts and texts without a letter are ``und`` with score 0. Very long
    texts are read whole, window by window.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((network, network.tables()))

    @F.arrow_udf("struct<lang:string,score:double>")
    def classify(text: pa.Array) -> pa.Array:
        net, tables = held.value
        picks, scores = [], []
        for at in range(0, len(text), 32):
            texts = text.slice(at, 32).to_pylist()
            every = [windows_of(t or "") for t in texts]
            windows = np.concatenate(every)
            logs = net.log_probabilities(windows, tables) * (windows != 32).sum(axis=1, keepdims=True)
            first = np.concatenate([[0], np.cumsum([len(w) for w in every])[:-1]])
            total = np.add.reduceat(logs, first, axis=0) / np.maximum(1, np.add.reduceat((windows != 32).sum(axis=1), first))[:, None]
            share = np.exp(total - total.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            picks += [net.languages[k] for k in best]
            scores += share[np.arange(len(best)), best].astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(picks, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    classify = classify.asNondeterministic()  # else a filter on the result would run it twice
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # the input's columns travel as one struct, so that none can clash
    coded = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), lettered.alias("lettered"), classify("text").alias("class"))
    return coded.select(
        "doc.*",
        F.when(F.col("lettered"), F.col("class.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("class.score")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Trains on the labelled part of ``docs`` (doc_id, text, lang) and predicts all of it.

    Without any labelled document every row is ``und``. An empty table gives an
    empty table. Null, blank and letterless texts are ``und``; repeated rows and
    ids are predicted alike, each row by its own text; of equal scores the first
    language by code point wins. Other columns stay.
    """
    texts, labels = training_sample(docs, sample_docs)
    if not texts:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    return predict(docs, train(texts, labels))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
