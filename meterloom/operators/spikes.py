"""Implausible readings: values that cannot occur, frozen stretches, spikes.

Per source a robust exponentially weighted control chart follows level, scale and the far quantile of the deviations. A
reading beyond the chart's bound is suspected; like every other it enters the update, but clipped to half the bound, so that
a spike hardly moves level and scale. A suspected group of at most `spike_len` readings after which the source is back at
the level it had before, nearer to it than halfway, is a spike; a longer one is a change of level, from which the chart goes
on, and one that lasts to the end is not seen to come back. The chart is run in
both directions. A run-length counter finds frozen stretches, limits of the kind find values that cannot occur.

A source of at most `shard_rows` records is judged whole, its records shuffled once. Larger ones are cut into shards of
about that many readings, so that no task holds an unbounded source: repeated deliveries are first reduced to one reading by
an aggregate (never collected), readings are counted per 16 seconds, running totals over those counts, in two levels, give
the shard of each, and every shard also gets the readings before and after it as context, which it does not report.
Whether a source changes with nearly every reading, and how long a run is that reaches a shard's border, is found per
source from run summaries of its shards. Readings are kept in the shared folder, as both ways start from them.

Defined cases: readings with null key, null time, or null/NaN value are not judged; infinite values are judged; every
delivered copy of a flagged reading is flagged; several different values at one second are taken in order of value; a
kind without limits, or a null limit, limits nothing; an empty table gives no flags.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import kept

REASONS = ("limit", "frozen", "spike")


@dataclass(frozen=True)
class ChartParams:
    clip: float = 8.0  # scales beyond which a reading is suspected
    tail: float = 2.5  # and times the 96 % quantile of the deviations, for sources with heavy tails
    back: float = 6.0  # scales within which the source counts as back at its former level
    level_weight: float = 0.25
    scale_weight: float = 0.06
    tail_weight: float = 0.01
    warm_up: int = 24  # readings that give the first level
    spike_len: int = 3
    frozen_len: int = 12
    max_repeats: float = 0.2  # share of repeats, long runs apart, up to which a source changes with nearly every reading
    shard_rows: int = 4096
    context_share: float = 0.125  # of a shard's readings, on either side


def frozen_runs(v: np.ndarray, p: ChartParams) -> np.ndarray:
    """Readings in unbroken runs of at least frozen_len equal values, if the rest seldom repeats."""
    n = len(v)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    lengths = np.diff(np.r_[starts, n])
    long = lengths >= p.frozen_len
    rest = lengths[~long].sum()
    repeats = rest - (~long).sum()
    if not long.any() or repeats > p.max_repeats * rest:
        return np.zeros(n, bool)
    # a source that is frozen throughout shows no other behaviour
    if rest < p.frozen_len:
        return np.zeros(n, bool)
    return np.repeat(long, lengths)


def chart(v: np.ndarray, p: ChartParams, frozen: np.ndarray) -> np.ndarray:
    """Spikes by a forward control chart; a group is judged once up to spike_len readings have followed its first."""
    n = len(v)
    out = np.zeros(n, bool)
    if n < 6:
        return out
    finite = np.where(np.isfinite(v) & (np.abs(v) < 1e300), v, np.nan)
    d = np.abs(np.diff(finite[~frozen & ~np.isnan(finite)]))
    d = d[d > 0]
    if not len(d):
        return out
    # first scale and far quantile, from the source's steps: their median is robust against spikes, and steps beyond 25
    # typical ones belong to spikes, which in a short series would be a large share
    typical = float(np.median(d)) * 1.0483
    far = float(np.quantile(d[d <= 25 * typical], 0.96))
    floor, least = 0.35 * typical, 0.5 * far
    head = finite[: p.warm_up]
    level = float(np.nanmedian(head)) if not np.isnan(head).all() else float(np.nanmedian(finite))
    scale = max(floor, typical)
    before = (level, 0.0)  # level and tolerance when the first of the pending readings came
    pending: list[int] = []
    rise, fall = math.exp(0.96 * p.tail_weight), math.exp(-0.04 * p.tail_weight)
    a, b, clip, tail = p.level_weight, p.scale_weight, p.clip, p.tail
    vals, hold = v.tolist(), frozen.tolist()
    for i, x in enumerate(vals):
        e = x - level
        dev = abs(e)
        if pending:
            # back is near the former level, and no more than halfway to the nearest of the suspected
            if abs(x - before[0]) <= before[1] and all(abs(x - before[0]) <= 0.5 * abs(vals[j] - before[0]) for j in pending):
                out[pending] = True
                pending = []
            elif len(pending) < p.spike_len:
                pending.append(i)
            else:
                # longer than a spike: a lasting change, the chart goes on from the new level
                known = [vals[j] for j in [*pending, i] if math.isfinite(vals[j]) and abs(vals[j]) < 1e300]
                if known:
                    level = float(np.median(known[-3:]))
                pending = []
                continue
        elif dev > clip * scale and dev > tail * far:
            pending.append(i)
            before = (level, max(p.back * scale, 0.75 * tail * far))
        if hold[i]:
            level = x if math.isfinite(x) else level
            continue
        bound = 0.5 * clip * scale
        level += a * max(-bound, min(bound, e))
        scale += b * (1.2533 * min(dev, 3.5 * scale) - scale)
        if scale < floor:
            scale = floor
        far *= rise if dev > far else fall
        if far < least:
            far = least
    return out


def shard_runs(v: np.ndarray, own: np.ndarray, facts: tuple[bool, int, int], p: ChartParams) -> np.ndarray:
    """The same for a shard and its context: the source's verdict, and the whole lengths of the first and last run of its own."""
    changes, first, last = facts
    if not changes or not own.any():
        return np.zeros(len(v), bool)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    lengths = np.diff(np.r_[starts, len(v)])
    long = lengths >= p.frozen_len
    at = np.flatnonzero(own)
    for i, n in ((at[0], first), (at[-1], last)):
        long[np.searchsorted(starts, i, "right") - 1] = n >= p.frozen_len
    return np.repeat(long, lengths)


def judge(v: np.ndarray, low: float, high: float, p: ChartParams, frozen: np.ndarray | None = None) -> np.ndarray:
    """Reason code per reading in time order: 0 none, else 1 + index into REASONS."""
    limit = (v < low) | (v > high)
    frozen = frozen_runs(v, p) if frozen is None else frozen
    seen = np.where(limit, np.inf, v) if limit.any() else v
    spike = chart(seen, p, frozen) | chart(seen[::-1], p, frozen[::-1])[::-1]
    if spike.any():
        # what lasts to the end is not seen to come back
        spike[np.flatnonzero(~spike).max(initial=-1) + 1 :] = False
    return np.where(limit, 1, np.where(frozen, 2, np.where(spike, 3, 0)))


def known_readings(readings: DataFrame) -> DataFrame:
    """(key, ts, val, rec_id): the readings that can be judged."""
    ok = F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val")
    return readings.where(ok).select("key", "ts", "val", "rec_id")


def _cut(large: DataFrame, p: ChartParams) -> DataFrame:
    """Readings of large sources with their shard, and for how many neighbouring shards they are context.

    Shards are cut by number of readings: counts per 16 seconds, running totals of these within 2**16 seconds, and over the
    2**16-second totals of a source. No window holds more than 4,096 counts or the totals of one source.
    """
    x = large.withColumn("_spot", F.shiftright("ts", 4))
    counts = x.groupBy("key", "_spot").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.shiftright("_spot", 12))
    days = counts.groupBy("key", "_day").agg(F.sum("_n").alias("_in_day"))
    earlier = (Window.unboundedPreceding, -1)
    by_day = Window.partitionBy("key").orderBy("_day").rowsBetween(*earlier)
    in_day = Window.partitionBy("key", "_day").orderBy("_spot").rowsBetween(*earlier)
    days = days.withColumn("_from", F.coalesce(F.sum("_in_day").over(by_day), F.lit(0)))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_day), F.lit(0)))
    spots = counts.join(days, ["key", "_day"]).select("key", "_spot", (F.col("_from") + F.col("_before")).alias("_at"))
    into = F.pmod("_at", F.lit(p.shard_rows))
    context = int(p.context_share * p.shard_rows)
    spots = spots.select(
        "key", "_spot", F.expr(f"_at div {p.shard_rows}").alias("_shard"), (into < context).alias("_first"), (into >= p.shard_rows - context).alias("_last")
    )
    return x.join(spots, ["key", "_spot"]).drop("_spot")


def _run_facts(x: DataFrame, p: ChartParams) -> DataFrame:
    """(key, shard, changes, first_run, last_run) of large sources, from run summaries of the shards.

    changes: whether the source, long runs apart, changes with nearly every reading and has long runs at all.
    """
    inside = Window.partitionBy("key", "shard").orderBy("ts", "val")
    x = x.select("key", F.col("_shard").alias("shard"), "ts", "val")
    x = x.withColumn("_new", F.coalesce(F.col("val") != F.lag("val").over(inside), F.lit(True)).cast("bigint"))
    x = x.withColumn("run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("key", "shard", "run").agg(F.max("val").alias("val"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("runs", F.max("run").over(Window.partitionBy("key", "shard")))
    inner, short = (F.col("run") > 1) & (F.col("run") < F.col("runs")), F.col("n") < p.frozen_len
    shards = runs.groupBy("key", "shard").agg(
        F.max(F.when(F.col("run") == 1, F.struct("val", "n"))).alias("head"),
        F.max(F.when((F.col("run") == F.col("runs")) & (F.col("runs") > 1), F.struct("val", "n"))).alias("tail"),
        F.coalesce(F.sum(F.when(inner & short, F.col("n"))), F.lit(0)).alias("rest"),
        F.count_if(inner & short).alias("rest_runs"),
        F.count_if(inner & ~short).alias("long"),
    )
    zero = F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("head").alias("of"), F.col("rest").alias("rest"), F.col("rest_runs").alias("rest_runs"), F.col("long").alias("long")),
        F.struct(F.lit(1).alias("pos"), F.col("tail").alias("of"), zero.alias("rest"), zero.alias("rest_runs"), zero.alias("long")),
    )
    # a run goes on from a shard's last to the next shard's first
    order = Window.partitionBy("key").orderBy("shard", "pos")
    e = shards.select("key", "shard", F.explode(ends).alias("e")).select("key", "shard", "e.*").where("of is not null")
    starts = (F.col("pos") == 1) | F.coalesce(F.col("of.val") != F.lag("of.val").over(order), F.lit(True))
    e = e.withColumn("_new", starts.cast("bigint")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("n", F.sum("of.n").over(Window.partitionBy("key", "run")))
    of_key = Window.partitionBy("key")
    rest = F.sum(F.col("rest") + F.when(short, F.col("of.n")).otherwise(0)).over(of_key)
    rest_runs = F.sum(F.col("rest_runs") + F.when(short, F.col("_new")).otherwise(0)).over(of_key)
    long = F.sum(F.col("long") + F.when(short, 0).otherwise(1)).over(of_key)
    e = e.withColumn("changes", (long > 0) & (rest >= p.frozen_len) & (rest - rest_runs <= p.max_repeats * rest))
    return e.groupBy("key", "shard").agg(
        F.first("changes").alias("changes"), F.min_by("n", "pos").alias("first_run"), F.max_by("n", "pos").alias("last_run")
    )


def _with_context(x: DataFrame) -> DataFrame:
    """Readings with their shard, and again as context (own = false) for the shards beside it."""

    def spot(shard: Column, own: bool) -> Column:
        return F.struct(shard.alias("shard"), F.lit(own).alias("own"))

    here = F.col("_shard")
    spots = F.array(spot(here, True), spot(F.when(F.col("_first") & (here > 0), here - 1), False), spot(F.when(F.col("_last"), here + 1), False))
    known = F.explode(F.filter(spots, lambda s: s["shard"].isNotNull())).alias("_to")
    return x.select("key", "ts", "val", known).select("key", "ts", "val", F.col("_to.shard").alias("shard"), F.col("_to.own").alias("own"))


def _with_limits(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows with the limits of their kind, the last part of the key; where a kind has several rows, the widest."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    limits = kinds.groupBy(F.col("kind").alias("_kind")).agg(F.min(known("low")).alias("low"), F.max(known("high")).alias("high"))
    return rows.join(limits, F.substring_index("key", ".", -1) == F.col("_kind"), "left").drop("_kind")


def _judged(groups: DataFrame, params: ChartParams) -> DataFrame:
    """(key, ts, val, rec_id, reason): the implausible ones of readings that are partitioned by (key, shard).

    Repeated deliveries are judged as one reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions are sorted by key and shard, so groups are contiguous; only one is held over a batch's end."""
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if rest and _same_group(rest[-1], b.num_rows, b):
                rest.append(b)
                continue
            whole = pa.Table.from_batches([*rest, b]).combine_chunks()
            starts = _group_starts(whole)
            done = int(starts[-1])
            if done:
                yield _judge_groups(whole, starts[:-1], done)
            rest = whole.slice(done).to_batches()
        if rest:
            whole = pa.Table.from_batches(rest).combine_chunks()
            yield _judge_groups(whole, np.array([0]), whole.num_rows)

    def _same_group(last: pa.RecordBatch, n: int, b: pa.RecordBatch) -> bool:
        """Whether all of b belongs to the group that is held; spares joining a long group's batches again and again."""
        held = (last["key"][-1], last["shard"][-1])
        return held == (b["key"][0], b["shard"][0]) and held == (b["key"][n - 1], b["shard"][n - 1])

    def _group_starts(t: pa.Table) -> np.ndarray:
        codes = t["key"].combine_chunks().dictionary_encode().indices.to_numpy() if t.num_rows else np.array([], int)
        shard = t["shard"].to_numpy()
        return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (shard[1:] != shard[:-1])])

    def _judge_groups(t: pa.Table, starts: np.ndarray, end: int) -> pa.RecordBatch:
        codes = np.zeros(end, np.int64)
        ts, vals, own, low, high = (t[c].to_numpy()[:end] for c in ("ts", "val", "own", "low", "high"))
        for s, e in zip(starts, [*starts[1:], end]):
            facts = None
            if t["changes"][int(s)].is_valid:
                facts = tuple(t[c][int(s)].as_py() for c in ("changes", "first_run", "last_run"))
                s += 1
            first = np.r_[True, (ts[s + 1 : e] != ts[s : e - 1]) | (vals[s + 1 : e] != vals[s : e - 1])][: e - s]
            v, mine = vals[s:e][first], own[s:e][first]
            frozen = None if facts is None else shard_runs(v, mine, facts, params)
            codes[s:e] = judge(v, low[e - 1], high[e - 1], params, frozen)[np.cumsum(first) - 1]
        hit = np.flatnonzero((codes > 0) & own)
        out = t.select(["key", "ts", "val", "rec_id"]).take(pa.array(hit)).combine_chunks()
        reason = pa.array([REASONS[c - 1] for c in codes[hit]], pa.string())
        cols = [(c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in out.columns]
        return pa.RecordBatch.from_arrays([*cols, reason], names=["key", "ts", "val", "rec_id", "reason"])

    columns = ("key", "shard", "ts", "val", "rec_id", "own", F.coalesce("low", F.lit(-math.inf)).alias("low"), F.coalesce("high", F.lit(math.inf)).alias("high"), *_FACTS)
    parts = groups.select(*columns).sortWithinPartitions("key", "shard", "ts", "val")
    return parts.mapInArrow(run, "key string, ts bigint, val double, rec_id bigint, reason string")


#: What `_run_facts` finds out about a shard.
_FACTS = {"changes": "boolean", "first_run": "bigint", "last_run": "bigint"}


def flag_records(readings: DataFrame, kinds: DataFrame, params: ChartParams = ChartParams()) -> DataFrame:
    """(rec_id, reason): every delivered record of an implausible reading.

    readings: rec_id, key, ts (epoch seconds), val. kinds: kind, low, high.
    """
    p = params
    readings = kept(known_readings(readings), "readings")
    large = kept(readings.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > p.shard_rows).select("key"), "large-sources")
    any_large = not large.isEmpty()
    # a whole source, copies and all, has at most shard_rows records here
    small = readings.join(large, "key", "left_anti") if any_large else readings
    whole = _with_limits(small, kinds).withColumns({"shard": F.lit(0).cast("bigint"), "own": F.lit(True)} | {n: F.lit(None).cast(t) for n, t in _FACTS.items()})
    out = _judged(whole.repartition("key"), p).select("rec_id", "reason")
    if any_large:
        every = readings.join(large, "key", "left_semi")
        once = kept(every.groupBy("key", "ts", "val").agg(F.lit(1).alias("_")).drop("_"), "large-readings")
        cut = _cut(once, p)
        # the facts of a shard are the first row of its group, as they have no time
        facts = _run_facts(cut, p).withColumn("own", F.lit(False))
        rows = _with_limits(_with_context(cut).unionByName(facts, allowMissingColumns=True), kinds).withColumn("rec_id", F.lit(None).cast("bigint"))
        flags = _judged(rows.repartition("key", "shard"), p).select(F.col("key").alias("_k"), F.col("ts").alias("_t"), F.col("val").alias("_v"), "reason")
        copies = every.join(flags, (F.col("key") == F.col("_k")) & (F.col("ts") == F.col("_t")) & (F.col("val") == F.col("_v")))
        out = out.unionByName(copies.select("rec_id", "reason"))
    return out
