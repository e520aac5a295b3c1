"""Queries p7: messages that give away test items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import leaks
from meterloom.sources.tables import table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: how many messages give it away, how much of the passage at most, and how often with the answer."""
    per_item = _leaks(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.max("words").alias("most_words"),
        F.sum(F.col("answer_seen").cast("int")).alias("n_with_answer"),
        F.round(F.max("score"), 3).alias("best_score"),
    )
    items = table(spark, d, "eval_items").select("item_id", "suite", "split_name")
    return items.join(per_item, "item_id", "left").fillna(0, ["n_docs", "most_words", "n_with_answer"])


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
ORACLE_SQL: dict[str, str] = {}
