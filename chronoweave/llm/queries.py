"""Queries of the text operators over `documents` and `eval_items`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.garble import garbled, restore
from chronoweave.llm.leaks import leaks
from chronoweave.llm.tokens import decode_corpus, encode_corpus
from chronoweave.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded text of every document; null texts come back empty."""
    return decode_corpus(p6_ids(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("exact_words >= 12").select("doc_id", "item_id").distinct()


def p7_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Substitution-tolerant overlaps with their lengths."""
    return _leaks(spark, folder).where("tolerant_words >= 12")


def p8_method(spark: SparkSession, folder: str) -> DataFrame:
    """What transformations learned from near-twins find by themselves."""
    return garbled(table(spark, folder, "documents"), twins_only=True).select("doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return restore(docs, garbled(docs))


def text_queries() -> dict:
    return {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_method": p8_method, "p8_found": p8_found, "p8_restored": p8_restored}


P6_ROUND_TRIP = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def text_sql() -> dict[str, str]:
    return {"p6_round_trip": P6_ROUND_TRIP}
