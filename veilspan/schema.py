"""Schemas and fixed dimensions of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x:double,y:double,width:double,height:double>"
PAGES = "doc_id bigint, page_index int, text string"
SPANS = "doc_id bigint, page_index int, ord bigint, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"

# Entity labels in display order with their colours, and the labels of older files.
LABELS = ("PERSON", "ORGANIZATION", "ADDRESS", "DATE", "IDENTIFIER")
COLORS = {"PERSON": "#3b82f6", "ORGANIZATION": "#8b5cf6", "ADDRESS": "#10b981", "DATE": "#6366f1", "IDENTIFIER": "#f59e0b"}
LEGACY_LABELS = ("EMAIL", "PHONE", "IBAN", "SIREN", "SIRET", "CAPITAL")


def label_dimension(spark: SparkSession) -> DataFrame:
    """(label, ord, color), five rows."""
    return spark.createDataFrame([(name, k, COLORS[name]) for k, name in enumerate(LABELS)], "label string, ord int, color string")
