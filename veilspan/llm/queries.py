"""The numbered queries and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, compression, html_extract, langid, lexical, line_dedup, merkle, mixing, near_dup, pii, quality, syncmers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_langid": langid.op2_langid,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html": html_extract.op4_html,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_chat": chat.op6_chat,
    "op7_fingerprints": syncmers.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_lexical": lexical.op12_lexical,
    "op13_compression": compression.op13_compression,
}

ORACLES: dict[str, str] = {"op3_line_dedup": line_dedup.ORACLE, "op6_chat": chat.ORACLE, "op11_merkle": merkle.ORACLE, "op12_lexical": lexical.ORACLE}
