"""Queries p1: different identifiers per day, site, platform and what, and per combination of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import bitmaps
from meterloom.sources.tables import table

GROUP = ("day", *bitmaps.DIMS)


def p1_distinct_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """The counts of all groups and combinations with their error bounds, and the mergeable bitmaps of the groups."""
    return bitmaps.counts_with_partials(bitmaps.bitmaps_of(table(spark, d, "ascii_parser")))


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The groups and combinations whose estimate lies within the stated bound of an exact count."""
    messages = table(spark, d, "ascii_parser")
    ids = bitmaps.identifiers(messages)
    groups = [[d for i, d in enumerate(bitmaps.DIMS) if keep >> i & 1] for keep in range(2 ** len(bitmaps.DIMS))]
    exact = ids.groupingSets([[F.col("day"), *map(F.col, g)] for g in groups], "day", *bitmaps.DIMS).agg(F.count_distinct("id").alias("exact"))
    est = bitmaps.distinct_counts(messages)
    same = [est[c].eqNullSafe(exact[c]) for c in GROUP]
    on = same[0] & same[1] & same[2] & same[3]
    ok = F.abs(F.col("estimate") - F.col("exact")) <= F.col("error_bound") * F.col("estimate")
    return est.join(exact, on).where(ok).select(*[est[c] for c in GROUP])


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """Per group, whether the bitmaps of the table's two halves, of different sizes, unite to those of the whole table."""
    ids = bitmaps.identifiers(table(spark, d, "ascii_parser"))
    bits = bitmaps.bits_for(bitmaps.largest_day(ids), 0.01)
    first = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    united = bitmaps.merge(bitmaps.build(ids.where(first), 2 * bits), bitmaps.build(ids.where(~first), bits), bits=bits)
    both = united.withColumn("side", F.lit(1)).unionByName(bitmaps.build(ids, bits).withColumn("side", F.lit(-1)))
    # a word that both have alike cancels out
    words = both.groupBy(*GROUP, "word_no", "word").agg(F.sum("side").alias("left"))
    return words.groupBy(*GROUP).agg((F.sum(F.abs("left")) == 0).alias("same"))


QUERIES = {"p1_distinct_identifiers": p1_distinct_identifiers, "p1_within_bound": p1_within_bound, "p1_merged": p1_merged}

_IDS = r"""WITH ids AS (
        SELECT CAST(ts AS DATE) AS day, split_part(name, '.', 2) AS site, split_part(name, '.', 3) AS platform, split_part(name, '.', 4) AS what
        FROM ascii_parser
        WHERE type = 's' AND regexp_full_match(name, 'uniq\.[^.]+\.[^.]+\.[^.]+') AND value <> '' AND strpos(value, '|') = 0)"""

ORACLE_SQL = {
    "p1_within_bound": _IDS
    + """
      SELECT day, site, platform, what FROM ids
      GROUP BY GROUPING SETS ((day), (day, site), (day, platform), (day, what), (day, site, platform), (day, site, what),
                              (day, platform, what), (day, site, platform, what))""",
    "p1_merged": _IDS + " SELECT day, site, platform, what, true AS same FROM ids GROUP BY ALL",
}
