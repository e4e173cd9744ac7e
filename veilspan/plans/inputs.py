"""The logical inputs that catalogued queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detect import detect_resolved
from ..operators.scanning import scanner
from ..operators.spans import SPANS_TYPE
from ..sources.tables import boxed_tokens, contract_pages, conversation_pages
from .duck import NAMES_PATTERN


def shared_path(spark: SparkSession) -> str:
    """A new folder under the shared one that ``spark.checkpoint.dir`` names; a local session without that setting takes a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilspan-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def contract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved spans of the contracts."""
    return detect_resolved(contract_pages(spark, sf_dir))


def found_names(pages: DataFrame) -> DataFrame:
    """Capitalised words of pages, as a model's spans without ``ord``; a batch of pages is scanned at once."""
    scanned = F.arrow_udf(SPANS_TYPE)(scanner([(NAMES_PATTERN, "", False)], ["NAME"], [0.5], False))("text")
    found = pages.select("doc_id", "page_index", F.inline(scanned)).drop("ord", "label", "confidence", "source")
    n = F.length("text")
    label = F.when(n % 3 == 0, "PERSON").when(n % 3 == 1, "ORGANIZATION").otherwise("ADDRESS")
    return found.select("doc_id", "page_index", label.alias("label"), "text", "norm_text", (F.lit(0.5) + (n % 5) / 10.0).alias("confidence"), F.lit("ner").alias("source"), "char_start", "char_end")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of the conversations, as a model's spans."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "char_start")).cast("long") - 1
    found = found_names(conversation_pages(spark, sf_dir))
    return found.select("doc_id", "page_index", order.alias("ord"), *found.columns[2:])


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed_tokens(conversation_pages(spark, sf_dir))


#: Rules over the names: some texts suppressed, some overridden, two texts forced.
RULES_SQL = """
select distinct 'suppress' as kind, norm_text, cast(null as string) as label from names where norm_text like 'a%'
union all select distinct 'override', norm_text, 'IDENTIFIER' from names where norm_text like 'b%' or norm_text like 'a%'
union all select 'force', 'of the', 'ADDRESS' union all select 'force', 'de la', 'ORGANIZATION' union all select 'force', 'er', 'DATE'
"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules as RULES_SQL gives in the checking SQL."""
    names_of = found_names(conversation_pages(spark, sf_dir)).where(F.col("norm_text").rlike("^[ab]")).select("norm_text").distinct()
    suppress = F.struct(F.lit("suppress").alias("kind"), F.col("norm_text"), F.lit(None).cast("string").alias("label"))
    override = F.struct(F.lit("override").alias("kind"), F.col("norm_text"), F.lit("IDENTIFIER").alias("label"))
    edited = names_of.select(F.inline(F.when(F.col("norm_text").startswith("a"), F.array(suppress, override)).otherwise(F.array(override))))
    force = spark.createDataFrame([("force", "of the", "ADDRESS"), ("force", "de la", "ORGANIZATION"), ("force", "er", "DATE")], "kind string, norm_text string, label string")
    return edited.unionByName(force)
