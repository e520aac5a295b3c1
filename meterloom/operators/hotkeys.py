"""Per-key results when a handful of keys hold most rows.

1. Detect: a frequent-items sketch per map task, merged in two levels (lanes, then one row), yields a superset of the
   keys above the wanted share; its size is bounded by the share, not by the data.
2. Confirm, where the hot keys themselves are asked for: one narrow pass counts the candidates exactly through a broadcast
   join. Shares too small for a bounded sketch are counted by the ordinary aggregate.
3. Split: rows of hot keys (tagged by a broadcast join) are aggregated per (key, salt) and merged per key; all other keys
   take the ordinary shuffle; the two results are united. A key is hot here if it holds more than one part in
   `spark.sql.shuffle.partitions`, the share of one task, however many tasks there are.

Defined cases: a null key is no key (its rows count in the total, and come out as one light row with key null);
an empty table has no hot keys; ties at exactly the share are hot; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import kept

LANES = 64
#: Entries of the largest sketch, and so the least share it can tell: 32 / TRACKED.
TRACKED = 1 << 17


def candidates(df: DataFrame, key: str, share: float) -> DataFrame:
    """(hot_key): every key holding at least `share` of the non-null rows, and few others.

    The sketch's error is 3.5 / (2 * tracked) of the rows or less, so `tracked` = 32 / share keeps it under share / 16
    and no key at or above the share can be missed; at most 2 / share keys are returned.
    """
    tracked = 1 << math.ceil(math.log2(32 / share))
    if tracked > TRACKED:
        raise ValueError("share is too small for a bounded sketch")
    top = math.ceil(2 / share)
    lanes = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("hot_key"), F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("_lane"))
        .groupBy("_lane")
        .agg(F.expr(f"approx_top_k_accumulate(hot_key, {tracked})").alias("_sketch"))
    )
    # grouped by a constant: without lanes there is nothing to combine
    merged = lanes.groupBy(F.lit(1).alias("_all")).agg(F.expr(f"approx_top_k_combine(_sketch, {tracked})").alias("_sketch"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {top})")).alias("_it")).select("_it.item").toDF("hot_key")


def heavy_hitters(df: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """(hot_key, n, total): the keys with n >= share * total, counted exactly; total holds rows with null keys too."""
    rows = df.select(F.col(key).alias("_key"))
    if 32 / share > TRACKED:
        every = rows.groupBy(F.col("_key").alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
        total = rows.count()
        hot = F.col("hot_key").isNotNull() & (F.col("n") >= F.lit(Decimal(repr(share))) * F.lit(total))
        return every.where(hot).withColumn("total", F.lit(total).cast("bigint"))
    cand = candidates(df, key, share)
    counted = (
        rows.join(F.broadcast(cand), rows["_key"] == cand["hot_key"], "left").groupBy("hot_key").agg(F.count(F.lit(1)).alias("n"))
    )
    # at most 2 / share + 1 rows from here on; the share as a decimal, so that a key at exactly the share is hot
    totals = counted.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return totals.where(F.col("hot_key").isNotNull() & (F.col("n") >= F.lit(Decimal(repr(share))) * F.col("total")))


def split_share(df: DataFrame) -> float:
    """The share of rows that one task of a shuffle takes; no less than a sketch can tell."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32 / TRACKED, min(0.5, 1 / partitions))


def split_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    merge: dict[str, Callable[[Column], Column]],
    share: float | None = None,
    salts: int = 256,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """One row per key with the columns of `partial`, hot keys and others on separate paths.

    partial: name -> aggregate over rows; merge: name -> aggregate over partial results (of a Column).
    share: from which share of rows on a key is split; None: from `split_share` on.
    salt_on: columns whose hash chooses the salt. Equal values then meet in one salted group, so that even a count of
    distinct values can be merged by adding; without it the salt is drawn from all columns.
    """
    # a superset of the hot keys, at most 2 / share of them; splitting a key that is not so hot does no harm
    cand = kept(candidates(df, key, split_share(df) if share is None else share), "hot-keys").select(F.col("hot_key").alias("_hot"))
    tagged = df.join(F.broadcast(cand), df[key] == F.col("_hot"), "left")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_on or [c for c in df.columns if c != key] or df.columns)]), F.lit(salts))
    heavy = (
        tagged.where(F.col("_hot").isNotNull())
        .withColumn("_salt", salt)
        .groupBy(key, "_salt")
        .agg(*[c.alias(n) for n, c in partial.items()])
        .groupBy(key)
        .agg(*[merge[n](F.col(n)).alias(n) for n in partial])
    )
    light = tagged.where(F.col("_hot").isNull()).groupBy(key).agg(*[c.alias(n) for n, c in partial.items()])
    return light.unionByName(heavy)
