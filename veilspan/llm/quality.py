"""Operator 10: quality rules with a hashed n-gram likelihood ratio.

Words and adjacent word pairs are hashed into ``BUCKETS`` buckets. Two
multinomials over the buckets, of the trusted documents (``labels.quality`` is
1) and of the whole corpus, give every bucket a log ratio; a document's score
is the mean over its n-grams. Documents that score below the threshold fail.
One of ``FOLDS`` trusted documents (by hash), and those beyond the bounded fit
sample, are kept out of the target counts, and all of them calibrate. The threshold is the ``TRUSTED_LOSS`` quantile of the scores of those, lowered by
``SLACK`` times their interquartile range: prose like the trusted stays, and
what is unlike it goes.

Everything is DataFrame expressions. The n-grams of a document are exploded
and summed again in the task that read it, so only one row a document and one
row a bucket are shuffled, and the ids of the trusted; the log ratios (``BUCKETS`` rows whatever the
corpus) and the ids of the fitted sample (at most ``TRUSTED_DOCS``) are
broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, words_of

MIN_WORDS = 50
#: Largest percentage of words in repeated windows.
MAX_REPEATED = 50
WINDOW_WORDS = 3
BUCKETS = 1 << 16
SMOOTHING = 1.0
TRUSTED_LOSS = 0.005
SLACK = 1.0
FOLDS = 4
#: Trusted documents that the target multinomial is fitted on, chosen by hash; raw counts cover all documents.
TRUSTED_DOCS = 20_000
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds the words and the base counts of every ``text`` (null: no words).

    Windows are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= WINDOW_WORDS, F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW_WORDS, F.lit(0))), lambda i: F.xxhash64(*[w(i + k) for k in range(WINDOW_WORDS)]))).otherwise(F.array().cast("array<bigint>"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # only texts with a repeated window get here: equal hashes side by side, then their places in order
    ranked = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    places = F.array_sort(F.transform(F.filter("ranked", lambda x, i: F.coalesce(x["h"] == F.get("ranked", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("ranked", i + 1)["h"], F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW_WORDS)))), F.lit(0), lambda a, x: a + x)
    return (
        docs.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("windows", windows).withColumn("ranked", ranked).withColumn("places", places)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("lines", "windows", "ranked", "places")
    )


def _grams(buckets: int):
    """Buckets of the words and the adjacent pairs of ``words``."""
    one = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.get("words", i - 1), F.get("words", i)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio): the log of the trusted over the raw share of each bucket, over all documents.

    ``trusted`` has the distinct doc_ids of the trusted sample, few enough to broadcast.
    """
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left").select("good", words_of(F.col("text")).alias("words"))
    counts = flagged.select("good", F.explode(_grams(buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    all_of = Window.partitionBy()  # BUCKETS rows
    share = lambda c: (F.col(c) + SMOOTHING) / (F.sum(c).over(all_of) + SMOOTHING * buckets)
    return every.select("bucket", F.log(share("target") / share("raw")).alias("ratio"))


def score_documents(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, the base counts and ``llr``, the mean log ratio (no n-gram: null)."""
    based = with_base(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    grams = based.select("row", "doc_id", *_BASE, F.explode_outer(_grams(buckets)).alias("bucket"))
    return grams.join(F.broadcast(ratios), "bucket", "left").groupBy("row", "doc_id", *_BASE).agg(F.avg("ratio").alias("llr"))


def exact_quantiles(values: DataFrame, shares: list[float]) -> list[float | None]:
    """The values at the shares of the sorted column (the first of which at least that share is no greater); none: nulls.

    Values are sorted into stored ranges, whose counts (a row a range) say in which range and at which place a
    quantile is: it depends on the values alone.
    """
    column = values.columns[0]
    ranges = saved(values.repartitionByRange(column).withColumn("range", F.spark_partition_id()))
    counts = sorted(ranges.groupBy("range").agg(F.min(column).alias("low"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["low"])
    total, out = sum(r["n"] for r in counts), []
    for share in shares:
        at, found = max(1, math.ceil(share * total)), None
        for r in counts:
            if at <= r["n"]:
                inside = Window.partitionBy("range").orderBy(column)  # one range
                found = ranges.where(F.col("range") == r["range"]).withColumn("at", F.row_number().over(inside)).where(F.col("at") == at).first()[column]
                break
            at -= r["n"]
        out.append(found)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """Judges every (doc_id, text) row by the base rules and the likelihood ratio.

    Returns doc_id, the base counts, ``base_failed``, ``llr``, ``threshold`` and
    ``kept``. Null and blank texts have no words and fail. Labels may repeat a
    document (the highest quality counts) or have nulls (no label); without any
    trusted document the ratio decides nothing. Repeated rows are judged alike. Very
    long texts are counted whole. An empty table gives none. Other columns are left
    out, whatever their names.
    """
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    trusted = saved(trusted)
    kept_out = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(FOLDS)) == 0
    fitted = saved(trusted.where(~kept_out).orderBy(F.xxhash64(F.lit("trusted"), "doc_id")).limit(trusted_docs))
    scored = saved(score_documents(docs, saved(log_ratios(docs, fitted, buckets)), buckets))
    # a row a document without its text: dealt by id, whatever the number of trusted ones
    apart = scored.select("doc_id", "n_words", "llr").join(trusted.join(fitted, "doc_id", "left_anti"), "doc_id", "left_semi").where(f"n_words >= {MIN_WORDS} and llr is not null").select("llr")
    low, q1, q3 = exact_quantiles(apart, [TRUSTED_LOSS, 0.25, 0.75])
    threshold = F.lit(None).cast("double") if low is None else F.lit(low - SLACK * (q3 - q1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("threshold", threshold).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.col("threshold"), F.lit(True))).drop("row")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *_BASE, "base_failed", "llr", "kept")
