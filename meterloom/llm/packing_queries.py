"""Queries p6: messages into containers of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import packing
from meterloom.sources.tables import table


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: their number, the least possible number, and the share of unused room."""
    capacity = packing.PackParams().capacity
    fill = p6_containers(spark, d).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    return fill.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("fill") / capacity).alias("least_possible"),
        F.max("fill").alias("fullest"),
        F.round(1 - F.sum("fill") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"),
    )


def p6_complete(spark: SparkSession, d: str) -> DataFrame:
    """How many messages are packed, and how many are lost, cut or put in wrongly or unmeasured, and containers too full."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    packed = p6_containers(spark, d)
    capacity = packing.PackParams().capacity
    pieces = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("piece").alias("different"),
        F.max("piece").alias("last"),
        F.sum("n_tokens").alias("tokens"),
    )
    whole = (F.col("n") == F.col("different")) & (F.col("n") == F.col("last") + 1) & (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)))
    per_doc = docs.join(pieces, "doc_id", "left").select(
        F.col("n").isNotNull().alias("there"), (~whole).alias("wrong"), ((F.col("chars") > 0) != (F.coalesce("tokens", F.lit(0)) > 0)).alias("unmeasured")
    )
    names = ("n_messages", "n_lost", "n_cut_wrongly", "n_unmeasured", "n_too_full")
    one = F.lit(1)
    rows = per_doc.select(one.alias(names[0]), *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in zip(names[1:], (~F.col("there"), F.col("wrong"), F.col("unmeasured"), F.lit(False)))])
    fills = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill")).where(F.col("fill") > capacity)
    full = fills.select(*[F.lit(int(n == names[-1])).alias(n) for n in names])
    return rows.unionByName(full).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


QUERIES = {"p6_containers": p6_containers, "p6_summary": p6_summary, "p6_complete": p6_complete}

ORACLE_SQL = {
    "p6_complete": """SELECT count(*) AS n_messages, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_cut_wrongly, CAST(0 AS BIGINT) AS n_unmeasured,
        CAST(0 AS BIGINT) AS n_too_full FROM documents""",
}
