"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: White space of the contracts: space and the control characters tab to carriage return.
SPACE = " \t\n\x0b\f\r"
#: One word of the contracts, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; a small one in few files is dealt out by its first column, so that all cores work."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without that setting takes a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilspan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What one Arrow batch of long texts may hold on its way to a Python worker.
BATCH_BYTES, BATCH_RECORDS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits so that batches of long texts stay small; never raises them."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_RECORDS)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in path."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a text in order (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uniform(*parts: Column) -> Column:
    """A deterministic pseudorandom double in [0, 1) from the parts' hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


#: A key of more than this share (one in so many) of all rows is joined by broadcast.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``: one row for each key, with (at least) the number ``m`` of rows that have it.

    Keys of more than a HOT_SHARE-th of all rows are fewer than HOT_SHARE: they are broadcast, so none goes to one task.
    """
    is_hot = F.col("m") * HOT_SHARE > n_rows
    hot = F.broadcast(per_key.where(is_hot).drop("m"))
    cold = rows.join(hot.select(key), key, "left_anti").join(per_key.where(~is_hot).drop("m"), key, how)
    return cold.unionByName(rows.join(hot, key))


#: Bits of the filter that keeps rows without a partner from being shuffled (bounds a broadcast to 2 MB).
FILTER_BITS = 1 << 23


def with_filter(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Adds ``_near``: whether a filter of fixed size lets the row's 64-bit ``column`` be one of ``wanted``'s."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    # at most FILTER_BITS / 64 rows whatever the input: broadcast
    bits = wanted.groupBy(word).agg(F.bit_or(mask).alias("_bits"))
    near = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn("_near", near).drop("_word", "_bits")
