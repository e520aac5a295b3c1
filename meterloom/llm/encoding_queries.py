"""Queries p8: messages with text that was decoded with the wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import encodings
from meterloom.sources.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.find_damage(table(spark, d, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected messages with the damaged words replaced where a reading is likely."""
    return encodings.restore(table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
ORACLE_SQL: dict[str, str] = {}
