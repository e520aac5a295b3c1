"""Irregular readings onto a regular grid, gaps filled or marked.

Readings are reduced to occupied slots, each source is cut into shards of `shard_slots` slots, a shard's summary is its
first and last occupied slot with the values there, and one scan over the summaries (one row per source and shard)
carries the last reading across shard borders. Gaps inside a shard then need only the shard, gaps across borders only
the summary, so every shard is filled on its own and a source holding a third of all rows is spread over its shards.

Defined cases: readings with null key, null time, or null/NaN value are no readings; infinite values are; repeated
readings of a slot count once in the grid, the latest (by time, then by the tie column) gives the value; an empty table
gives an empty grid; a source with one reading gives one slot.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gauge_readings(prefix: DataFrame, sink: DataFrame) -> DataFrame:
    """(rec_id, key, ts, val): gauge records with a time and a number, joined to their key."""
    p = prefix.where((F.col("type") == 5) & F.col("timestamp").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val"))
    p = p.select("rec_id", F.col("timestamp").alias("ts"), "val")
    return p.join(sink.where(F.col("key").isNotNull()).select("rec_id", "key"), "rec_id")


def occupied_slots(readings: DataFrame, key: str, ts: str, val: str, tie: str, step: int, shard_slots: int) -> DataFrame:
    """(key, shard, slot_no, first_val, last_val, n), partitioned by (key, shard)."""
    slot = F.floor(F.col(ts) / F.lit(step))
    # time within the slot, then the tie, as one number: ordered by a struct, the aggregate would sort all its rows
    order = F.pmod(F.col(ts), F.lit(step)).cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19)) + F.coalesce(F.col(tie), F.lit(-(1 << 63))).cast("decimal(20,0)")
    ok = F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(val).isNotNull() & ~F.isnan(val)
    return (
        readings.where(ok)
        .groupBy(F.col(key).alias("key"), slot.alias("slot_no"))
        .agg(F.min_by(val, order).alias("first_val"), F.max_by(val, order).alias("last_val"), F.count(F.lit(1)).alias("n"))
        .withColumn("shard", F.floor(F.col("slot_no") / F.lit(shard_slots)))
        .repartition("key", "shard")
    )


def shard_summaries(occupied: DataFrame) -> DataFrame:
    """One row per (key, shard) with first and last reading, and the carry that enters it from the shards before."""
    summary = occupied.groupBy("key", "shard").agg(
        F.min("slot_no").alias("first_slot"),
        F.min_by("first_val", "slot_no").alias("first_val"),
        F.max("slot_no").alias("last_slot"),
        F.max_by("last_val", "slot_no").alias("last_val"),
    )
    w = Window.partitionBy("key").orderBy("shard")
    return summary.withColumn("carry_slot", F.lag("last_slot").over(w)).withColumn("carry_val", F.lag("last_val").over(w))


def _gap_value(fill: str, slot: Column, p: Column, pv: Column, n: Column, nv: Column) -> Column:
    if fill == "locf":
        return pv
    if fill == "linear":
        return pv + (nv - pv) * (slot - p) / (n - p)
    if fill == "mark":
        return F.lit(None).cast("double")
    raise ValueError(f"unknown fill {fill!r}")


def regular_grid(
    readings: DataFrame,
    step: int = 60,
    shard_slots: int = 360,
    fill: str = "locf",
    key: str = "key",
    ts: str = "ts",
    val: str = "val",
    tie: str = "rec_id",
) -> DataFrame:
    """(key, slot, val, n, gap): every slot from a key's first to its last reading; slot is its start in epoch seconds.

    gap is true where no reading exists; n is then 0 and val the filled value ("locf": last reading before,
    "linear": between the neighbours, "mark": null).
    """
    occ = occupied_slots(readings, key, ts, val, tie, step, shard_slots)
    inside = Window.partitionBy("key", "shard").orderBy("slot_no")
    seen = occ.select("key", F.col("slot_no").alias("s"), F.col("last_val").alias("v"), F.col("n").alias("c"), F.lit(False).alias("gap"))
    inner = (
        occ.select("key", "shard", "slot_no", "first_val", F.lag("slot_no").over(inside).alias("p"), F.lag("last_val").over(inside).alias("pv"))
        .where(F.col("slot_no") > F.col("p") + 1)
        .select("*", F.explode(F.sequence(F.col("p") + 1, F.col("slot_no") - 1)).alias("s"))
        .select("key", "s", _gap_value(fill, F.col("s"), F.col("p"), F.col("pv"), F.col("slot_no"), F.col("first_val")).alias("v"))
    )
    # a long silence spans whole shards: first explode the shards, then the slots of each, so no array outgrows a shard
    border = (
        shard_summaries(occ)
        .where(F.col("first_slot") > F.col("carry_slot") + 1)
        .select(
            "*",
            F.explode(
                F.sequence(F.floor((F.col("carry_slot") + 1) / shard_slots), F.floor((F.col("first_slot") - 1) / shard_slots))
            ).alias("h"),
        )
        .select(
            "*",
            F.explode(
                F.sequence(
                    F.greatest(F.col("carry_slot") + 1, F.col("h") * shard_slots),
                    F.least(F.col("first_slot") - 1, (F.col("h") + 1) * shard_slots - 1),
                )
            ).alias("s"),
        )
        .select("key", "s", _gap_value(fill, F.col("s"), F.col("carry_slot"), F.col("carry_val"), F.col("first_slot"), F.col("first_val")).alias("v"))
    )
    gaps = inner.unionByName(border).select("key", "s", "v", F.lit(0).cast("bigint").alias("c"), F.lit(True).alias("gap"))
    both = seen.unionByName(gaps)
    return both.select("key", (F.col("s") * step).cast("bigint").alias("slot"), F.col("v").alias("val"), F.col("c").alias("n"), "gap")
