"""Readers that give the engine's logical inputs from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A stored table as it is; a small one that comes in few files is dealt to all cores by its first column.

    Small means less than one scan partition for each core, so what is moved is
    bounded by the cluster and a large table, which Spark splits itself, is never moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() or 2 * len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-page documents."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.lit(0).alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-page documents: a conversation's turns are its pages."""
    return spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))


#: A contract's text from (k: order key, c: customer key, c_name, s_name, d: date in words); the same SQL in either engine.
CONTRACT = r"""
'Contrat ' || cast(k as string) || ' du ' || d || ' entre ' || c_name || ' et ' || s_name
|| '. Contact: contact.' || cast(c as string) || '@mail' || cast(k % 9 as string) || '.example.com, tél. 06 ' || lpad(cast(k % 100 as string), 2, '0') || ' 34 56 78'
|| (case when k % 4 = 0 then ' ou +33 1 42 68 53 00' else '' end)
|| '. SIREN ' || (case k % 3 when 0 then '732 829 320' when 1 then '123 456 789' else '552081317' end)
|| ', SIRET ' || (case k % 3 when 0 then '732 829 320 00074' when 1 then '123 456 789 00012' else '55208131700015' end)
|| ', siège ' || cast(k % 90 + 1 as string) || ', rue des Lilas, 75' || lpad(cast(k % 20 + 1 as string), 3, '0') || ' Paris; bureau 690' || lpad(cast(k % 9 as string), 2, '0') || ' Lyon-Centre'
|| (case when k % 5 = 0 then '. DocuSign Envelope ID: 1A2B3C4D-00AA-11BB-22CC-' || lpad(cast(k as string), 12, '0') else '' end)
|| '. Capital ' || cast(k % 9 + 1 as string) || ' 500 000 ' || (case k % 3 when 0 then 'EUR' when 1 then 'euros' else '€.' end)
|| (case when k % 7 = 0 then ', IBAN FR76 3000 6000 0112 3456 7890 189' else '' end)
|| '. Fait le ' || cast(k % 28 + 1 as string) || (case k % 2 when 0 then ' février 2024' else ' Août 2023' end) || ' pour ' || upper(c_name) || ' (' || c_name || ').'
"""


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts rendered from orders, customers and suppliers: one page each, with every kind of identifier."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    customers = read(spark, sf_dir, "customer")
    suppliers = read(spark, sf_dir, "supplier").where("s_suppkey < 10")  # the ten parties that contracts name
    met = (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(F.broadcast(suppliers), F.col("s_suppkey") == F.col("o_orderkey") % 10)
        .select(F.col("o_orderkey").alias("k"), F.col("c_custkey").alias("c"), "c_name", "s_name", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    )
    return met.select(F.col("k").alias("doc_id"), F.lit(0).alias("page_index"), F.expr(CONTRACT).alias("text"))


def tokens(pages: DataFrame) -> DataFrame:
    """Words of each page with their offsets, numbered from 0: (doc_id, page_index, token_idx, text, char_start, char_end)."""
    from ..functions.text import matches

    found = pages.select("doc_id", "page_index", F.posexplode(matches(F.col("text"), r"\S+")).alias("token_idx", "m"))
    return found.select("doc_id", "page_index", "token_idx", F.col("m.text").alias("text"), F.col("m.start").alias("char_start"), F.col("m.stop").alias("char_end"))


def boxed_tokens(pages: DataFrame) -> DataFrame:
    """Tokens laid out in lines of 80 characters, 6 wide and 14 apart."""
    from ..functions.geometry import box

    line, column = F.floor(F.col("char_start") / 80), F.col("char_start") % 80
    return tokens(pages).withColumn("bbox", box(column * 6.0, 780.0 - 14.0 * line, (F.col("char_end") - F.col("char_start")) * 6.0, F.lit(10.0)))
