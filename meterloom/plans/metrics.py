"""Queries over the engine's own operators: parsing, aggregates, windows, emission; with their SQL.

Samples come from the tables: events (name event_type, order event_id, member user_id), lineitem (timers named by flag and
status) and ascii_parser (tokenised messages). Sums of doubles are rounded, as the order of summation differs.
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.config import EngineConfig, Histogram, with_histogram_table
from meterloom.functions import protocol
from meterloom.functions.numbers import number_of, number_parts
from meterloom.operators import aggregate as agg
from meterloom.operators import emit
from meterloom.sources import binary
from meterloom.sources.tables import table
from meterloom.streaming import flush as streaming

#: The sketch is exact up to this many values a group and mergeable beyond; the oracle wants exact quantiles.
CFG = EngineConfig(quantiles=(0.5, 0.9, 0.95, 0.99), quantile_accuracy=1_000_000)
HISTS = (
    Histogram("", 0.0, 300.0, 25.0),
    Histogram("p", 0.0, 100.0, 30.0),
    Histogram("pur", 10.0, 90.0, 10.0),
    Histogram("view", 0.0, 10.0, 3.0),
)
WINDOW = 6 * 3600


def events_as(spark: SparkSession, d: str, kind: str | Column, rate: Column | None = None, name: Column | None = None, value: Column | None = None) -> DataFrame:
    """Samples of one type from the events table."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (F.col("event_type") if name is None else name).alias("name"),
        (F.col("value") if value is None else value).alias("value"),
        F.col("user_id").cast("string").alias("member"),
        (F.lit(1.0) if rate is None else rate).alias("sample_rate"),
    )


def r(c: str | Column, digits: int = 3) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_RATE_SQL = "CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 ELSE 0.3 END"


def _rates() -> Column:
    k = F.col("event_id") % 4
    return F.when(k == 0, 1.0).when(k == 1, 0.5).when(k == 2, 0.1).otherwise(0.3)


def counter_sum(spark: SparkSession, d: str) -> DataFrame:
    return agg.counters(events_as(spark, d, "c"), CFG).select("name", r("sum").alias("sum"))


def counter_rate(spark: SparkSession, d: str) -> DataFrame:
    return agg.counters(events_as(spark, d, "c"), CFG).select("name", r("rate").alias("rate"))


def counter_sampled(spark: SparkSession, d: str) -> DataFrame:
    return agg.counters(events_as(spark, d, "c", _rates()), CFG).select("name", r("sum").alias("sum"), "count", r("rate").alias("rate"))


def _flushed(samples: DataFrame, cfg: EngineConfig) -> DataFrame:
    return emit.flush(samples, cfg, F.lit(0)).select("type", "key", r("value").alias("value"))


def counter_extended(spark: SparkSession, d: str) -> DataFrame:
    return _flushed(events_as(spark, d, "c", _rates()), replace(CFG, extended_counters=True))


def counter_extended_nonlegacy(spark: SparkSession, d: str) -> DataFrame:
    return _flushed(events_as(spark, d, "c", _rates()), replace(CFG, extended_counters=True, legacy_extended_counters=False))


def timer_stats(spark: SparkSession, d: str) -> DataFrame:
    x = agg.timers(events_as(spark, d, "ms", _rates()), CFG)
    return x.select(
        "name", r("sum").alias("sum"), r("sum_sq", 1).alias("sum_sq"), r("mean", 6).alias("mean"), "lower", "upper", "count", "actual_count", r("stdev", 6).alias("stdev"), r("rate").alias("rate"), r("sample_rate").alias("sample_rate")
    )


def timer_quantiles(spark: SparkSession, d: str) -> DataFrame:
    x = agg.timers(events_as(spark, d, "ms"), CFG)
    return x.select("name", *[F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "median")


def timer_quantiles_approx(spark: SparkSession, d: str) -> DataFrame:
    """The quantiles of default accuracy that lie within timer_eps of their rank."""
    cfg, x = EngineConfig(), events_as(spark, d, "ms")
    return _near_their_rank(x, agg.timers(x, cfg), cfg)


def _near_their_rank(samples: DataFrame, found: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(name, stat): the quantiles of timers that are within timer_eps of their rank, or one rank."""
    x = samples.where("type = 'ms' and name is not null and value is not null and not isnan(value)")
    x = x.join(found.select("name", F.posexplode("quantiles").alias("i", "found")), "name")
    ranks = x.groupBy("name", "i").agg(F.count_if(F.col("value") < F.col("found")).alias("below"), F.count_if(F.col("value") <= F.col("found")).alias("upto"), F.count(F.lit(1)).alias("n"))
    rank = F.ceil(F.element_at(F.array(*map(F.lit, cfg.quantiles)), F.col("i") + 1) * F.col("n"))
    slack = F.greatest(F.lit(1.0), cfg.timer_eps * F.col("n"))
    near = ranks.where((F.col("below") + 1 <= rank + slack) & (F.col("upto") >= rank - slack))
    return near.select("name", F.concat(F.lit("q"), F.col("i").cast("string")).alias("stat"))


def timer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return agg.histograms(events_as(spark, d, "ms"), replace(CFG, histograms=HISTS[:1])).select("name", "bin", "label", "count")


def timer_histogram_prefix(spark: SparkSession, d: str) -> DataFrame:
    return agg.histograms(events_as(spark, d, "ms"), replace(CFG, histograms=HISTS)).select("name", "bin", "label", "count")


def timers_windowed(spark: SparkSession, d: str) -> DataFrame:
    x = events_as(spark, d, "ms").withColumn("window_start", F.window(F.col("ts").cast("timestamp"), f"{WINDOW} seconds")["start"])
    out = agg.timers(x, CFG, ("window_start",))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "name", r("sum").alias("sum"), "count", "lower", "upper")


def lineitem_timers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        F.lit("ms").alias("type"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("name"), F.col("l_extendedprice").alias("value"), F.lit(None).cast("string").alias("member"), F.lit(1.0).alias("sample_rate")
    )
    out = agg.timers(x, CFG)
    return out.select("name", r("mean", 4).alias("mean"), "lower", "upper", "count", r("stdev", 4).alias("stdev"), F.element_at("quantiles", 1).alias("p50"), F.element_at("quantiles", 4).alias("p99"))


def gauge_last(spark: SparkSession, d: str) -> DataFrame:
    return agg.gauges(events_as(spark, d, "g"))


def _delta_kind() -> Column:
    return F.when(F.col("event_id") % 1000 == 0, "g").otherwise("gd")


def gauge_delta(spark: SparkSession, d: str) -> DataFrame:
    """One reading in a thousand is absolute, the others are deltas of alternating sign."""
    v = F.when(F.col("event_id") % 1000 == 0, F.col("value")).when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return agg.gauges(events_as(spark, d, _delta_kind(), value=v)).select("name", r("value").alias("value"))


def kv_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return agg.key_values(events_as(spark, d, "kv"))


def set_exact(spark: SparkSession, d: str) -> DataFrame:
    return agg.sets(events_as(spark, d, "s"), CFG, exact=True)


def set_hybrid_small(spark: SparkSession, d: str) -> DataFrame:
    """Sets per hour and type: small ones are counted exactly, larger ones come out exactly if the sketch keeps its bound."""
    x = events_as(spark, d, "s", name=F.concat_ws(".", "event_type", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH")))
    both = agg.sets(x, CFG).withColumnRenamed("members", "found").join(agg.sets(x, CFG, exact=True), "name")
    kept_bound = (F.col("members") > agg.EXACT_SET) & (F.abs(F.col("found") - F.col("members")) <= 3 * CFG.set_eps * F.col("members"))
    return both.select("name", F.when(kept_bound, F.col("members")).otherwise(F.col("found")).alias("members"))


def set_hll(spark: SparkSession, d: str) -> DataFrame:
    return agg.sets(events_as(spark, d, "s"), CFG)


def set_hll_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Sets whose sketched size is within three standard errors of the exact one."""
    exact = agg.sets(events_as(spark, d, "s"), CFG, exact=True)
    sketch = set_hll(spark, d).withColumnRenamed("members", "estimate")
    return exact.join(sketch, "name").where(F.abs(F.col("estimate") - F.col("members")) <= 3 * CFG.set_eps * F.col("members") + 1).select("name", "members")


def input_counter(spark: SparkSession, d: str) -> DataFrame:
    cfg = replace(CFG, input_counter="numStats")
    x = agg.count_inputs(events_as(spark, d, F.when(F.col("event_id") % 2 == 0, "c").otherwise("kv")), cfg)
    return agg.counters(x, cfg).select("name", r("sum").alias("sum"), "count")


def flush_all_types(spark: SparkSession, d: str) -> DataFrame:
    """Every flushed row of samples of all types, with prefixes and suffixes."""
    kinds = ("c", "ms", "g", "s")
    x = None
    for k in kinds:
        e = events_as(spark, d, k)
        x = e if x is None else x.unionByName(e)
    return emit.flush(x, replace(CFG, global_prefix="app.", exact_sets=True), F.lit(0)).select("type", "name", "stat", "key", r("value", 1).alias("value"))


def flush_text(spark: SparkSession, d: str) -> DataFrame:
    """Text records of gauges and key-values, whose numbers are exact."""
    x = events_as(spark, d, "g").unionByName(events_as(spark, d, "kv"))
    return emit.text_records(emit.flush(x, CFG, F.lit(1700000000))).select("line")


def binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Packed records of timers and counters, decoded again."""
    x = events_as(spark, d, "ms").unionByName(events_as(spark, d, "c"))
    packed = emit.binary_records(emit.flush(x, CFG, F.lit(1700000000), binary=True), CFG)
    return binary.parse_records(packed).select("ts", "type", "value_type", "key", r("value", 1).alias("value"))


def binary_messages(spark: SparkSession, d: str) -> DataFrame:
    """Binary messages made of events, framed back into samples and summed."""
    rows = table(spark, d, "events").where("event_type is not null and value is not null")
    packed = rows.select(F.col("event_id").alias("chunk_no"), _pack_message("event_id", "event_type", "value").alias("data"))
    return agg.counters(binary.parse_chunks(packed), CFG).select("name", r("sum").alias("sum"), "count")


def _pack_message(*columns: str) -> Column:
    @F.pandas_udf(T.BinaryType())
    def pack(no: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([binary.write_number(2, n, v) for n, v in zip(name, value)], dtype="object")

    return pack(*columns)


def binary_message_types(spark: SparkSession, d: str) -> DataFrame:
    """Binary messages of every type made of events, framed back into samples."""

    @F.pandas_udf(T.BinaryType())
    def pack(no: pd.Series, name: pd.Series, value: pd.Series, member: pd.Series) -> pd.Series:
        kinds = list(binary.MESSAGE_TYPES)
        packed = (binary.write_set(n, m) if i % 6 == 3 else binary.write_number(kinds[i % 6], n, v) for i, n, v, m in zip(no, name, value, member))
        return pd.Series(list(packed), dtype="object")

    rows = table(spark, d, "events").where("event_type is not null and value is not null and user_id is not null")
    chunks = rows.select(F.col("event_id").alias("chunk_no"), pack("event_id", "event_type", "value", F.col("user_id").cast("string")).alias("data"))
    return binary.parse_chunks(chunks).select(F.col("chunk_no").alias("seq"), "type", "name", "value", "member")


def timers_chosen(spark: SparkSession, d: str) -> DataFrame:
    """A flush of some statistics only, with quantiles whose labels round half to even and beyond 99."""
    cfg = replace(CFG, timers_include=frozenset({"mean", "upper", "count"}), quantiles=(0.125, 0.995))
    return emit.flush(events_as(spark, d, "ms"), cfg, F.lit(0)).select("key", r("value", 6).alias("value"))


# ---- tokenised messages


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return protocol.tokens_to_samples(table(spark, d, "ascii_parser"))


def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    """All messages written as lines and parsed again."""
    m = table(spark, d, "ascii_parser").where("name is not null and value is not null and type is not null")
    line = F.concat("name", F.lit(":"), "value", F.lit("|"), "type", F.coalesce(F.concat(F.lit("|@"), "samplerate"), F.lit("")))
    return protocol.parse_lines(m.select("seq", line.alias("line"))).select("seq", "type", "name", "value", "member", "sample_rate")


def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The number that every message's value starts with."""
    return table(spark, d, "ascii_parser").where("type <> 's'").select("seq", number_of(number_parts(F.col("value")), F.col("value")).alias("number"))


def message_counters(spark: SparkSession, d: str) -> DataFrame:
    return agg.counters(_messages(spark, d), CFG).select("name", r("sum", 5).alias("sum"), "count")


def message_timers(spark: SparkSession, d: str) -> DataFrame:
    x = agg.timers(_messages(spark, d), CFG)
    return x.select("name", r("sum", 5).alias("sum"), r("mean", 7).alias("mean"), "lower", "upper", "count", "actual_count", r("stdev", 7).alias("stdev"), F.element_at("quantiles", 1).alias("p50"), F.element_at("quantiles", 4).alias("p99"))


def message_gauges(spark: SparkSession, d: str) -> DataFrame:
    return agg.gauges(_messages(spark, d)).select("name", r("value").alias("value"))


def message_sets(spark: SparkSession, d: str) -> DataFrame:
    return agg.sets(_messages(spark, d), CFG, exact=True)


def message_histograms(spark: SparkSession, d: str) -> DataFrame:
    cfg = with_histogram_table(CFG, table(spark, d, "hist_cfg"))
    return agg.histograms(_messages(spark, d), cfg).select("name", "bin", "count")


def replay_counters(spark: SparkSession, d: str) -> DataFrame:
    """Recorded counters flushed once a minute."""
    cfg = replace(CFG, flush_interval=60)
    out = streaming.replay(_messages(spark, d).where("type = 'c' and ts is not null"), cfg)
    return out.select("ts", "key", r("value").alias("value"))


FLUSHED_AT = 1647302400
#: Quantiles of any group of up to a million values, and sets, come out as SQL has them.
EXACT = EngineConfig(quantile_accuracy=1_000_000, exact_sets=True, extended_counters=True)


def _flush_messages(spark: SparkSession, d: str, cfg: EngineConfig) -> DataFrame:
    return emit.flush(_messages(spark, d), with_histogram_table(cfg, table(spark, d, "hist_cfg")), F.lit(FLUSHED_AT))


def flush_messages(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one whole flush of all messages, every type, statistic and histogram; sets and quantiles exactly."""
    value = F.when(F.col("stat") == "sum_sq", r("value", 0)).when(F.col("stat").isin("mean", "stdev"), r("value", 7)).otherwise(r("value", 6))
    return _flush_messages(spark, d, EXACT).select("ts", "type", "key", value.alias("value"), "hist_count")


def flush_messages_sketched(spark: SparkSession, d: str) -> DataFrame:
    """The same with the default error of quantiles and sets: what every flush of a service computes."""
    return _flush_messages(spark, d, EngineConfig()).select("ts", "type", "key", "value", "hist_count")


def flush_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The sets and quantiles of a sketched flush that keep their bounds: three set_eps, and timer_eps of the ranks."""
    cfg, messages = EngineConfig(), _messages(spark, d)
    got = agg.scalars(messages, cfg)
    sets = got.where("type = 's'").join(agg.sets(messages, cfg, exact=True).withColumnRenamed("members", "exact"), "name")
    sets = sets.where(F.abs(F.col("members") - F.col("exact")) <= 3 * cfg.set_eps * F.col("exact")).select("type", "name", F.lit("members").alias("stat"))
    near = _near_their_rank(messages, got.where("type = 'ms'"), cfg)
    return sets.unionByName(near.select(F.lit("ms").alias("type"), "name", "stat"))


def input_counter_messages(spark: SparkSession, d: str) -> DataFrame:
    """Counters with one that counts every message of the grammar, whether its numbers can be used or not."""
    cfg = replace(CFG, input_counter="inputs")
    return agg.counters(agg.count_inputs(protocol.tokens_to_samples(table(spark, d, "ascii_parser"), counted=True), cfg), cfg).select("name", r("sum", 5).alias("sum"), "count")


def condensed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the messages written as condensed lines, each with a second value, and parsed again."""
    m = table(spark, d, "ascii_parser").where("name is not null and value is not null and type is not null and not contains(value, ':') and not contains(coalesce(samplerate, ''), ':')")
    one = F.concat("value", F.lit("|"), "type", F.coalesce(F.concat(F.lit("|@"), "samplerate"), F.lit("")))
    line = F.concat("name", F.lit(":"), one, F.lit(":1|c"))
    x = protocol.to_samples(protocol.match_condensed(m.select("seq", line.alias("line"))))
    return agg.counters(x, CFG).select("name", r("sum", 5).alias("sum"), "count")


def binary_round_trip_all(spark: SparkSession, d: str) -> DataFrame:
    """Packed records of a whole flush of all messages, sets and histograms too, with key prefixes, decoded again."""
    cfg = with_histogram_table(replace(EXACT, prefix_binary_stream=True, global_prefix="all."), table(spark, d, "hist_cfg"))
    packed = emit.binary_records(emit.flush(_messages(spark, d), cfg, F.lit(FLUSHED_AT), binary=True), cfg)
    timer, stat = F.col("type") == 3, F.col("value_type")
    value = F.when(timer & (stat == 2), r("value", 0)).when(timer & stat.isin(3, 5), r("value", 7)).otherwise(r("value", 6))
    return binary.parse_records(packed).select("ts", "type", "value_type", "key", value.alias("value"), "hist_count")


# ---- the two workloads of the baseline


def counter_few_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        F.lit("c").alias("type"), F.concat(F.lit("key"), (F.col("l_orderkey") % 3).cast("string")).alias("name"), F.col("l_quantity").alias("value"), F.lit(1.0).alias("sample_rate")
    )
    return agg.counters(x, CFG).select("name", r("sum").alias("sum"), "count")


def set_few_keys(spark: SparkSession, d: str) -> DataFrame:
    member = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    x = table(spark, d, "lineitem").select(F.lit("s").alias("type"), F.concat(F.lit("key"), (F.col("l_orderkey") % 3).cast("string")).alias("name"), member.alias("member"))
    return agg.sets(x, CFG, exact=True)


def set_few_keys_sketch(spark: SparkSession, d: str) -> DataFrame:
    member = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    x = table(spark, d, "lineitem").select(F.lit("s").alias("type"), F.concat(F.lit("key"), (F.col("l_orderkey") % 3).cast("string")).alias("name"), member.alias("member"))
    return agg.sets(x, CFG)


QUERIES = {
    f.__name__: f
    for f in (
        flush_messages, flush_messages_sketched, flush_within_bound, input_counter_messages, condensed_messages, binary_round_trip_all, counter_sum, counter_rate, counter_sampled, counter_extended, counter_extended_nonlegacy, timer_stats, timer_quantiles,
        timer_quantiles_approx, timer_histogram, timer_histogram_prefix, timers_windowed, lineitem_timers, gauge_last, gauge_delta, kv_passthrough,
        set_exact, set_hybrid_small, set_hll, set_hll_within_bound, input_counter, flush_all_types, flush_text, binary_round_trip, binary_messages, binary_message_types, timers_chosen,
        parse_lines, parse_numbers, message_counters, message_timers, message_gauges, message_sets, message_histograms, replay_counters,
        counter_few_keys, set_few_keys, set_few_keys_sketch,
    )
}

# ---- SQL

_NUM = """CASE WHEN regexp_matches({0}, '^[+-]?[0-9]*(\\.[0-9]*)?[eE]') THEN
    CASE WHEN regexp_matches({0}, '^[+-]?(\\.?[0-9])') THEN
      CASE WHEN abs({1}) < 'inf'::DOUBLE AND (abs({1}) >= 2.2250738585072014e-308 OR NOT regexp_matches(regexp_extract({0}, '^[+-]?[0-9.]*'), '[1-9]'))
           THEN {1} END END
  WHEN regexp_matches({0}, '^[+-]?(\\.?[0-9])') THEN TRY_CAST(regexp_extract({0}, '^[+-]?[0-9]*(\\.[0-9]*)?') AS DOUBLE)
  WHEN regexp_matches({0}, '^[-+.]') THEN 0.0::DOUBLE END"""
#: A rate counts from two characters on and between 0 and 1; one that starts with no number makes the sample unusable.
_RATE = r"""CASE WHEN t NOT IN ('ms', 'h', 'c') OR rt IS NULL OR length(rt) <= 1 THEN 1.0::DOUBLE
  WHEN NOT regexp_matches(rt, '^[-+.0-9]') OR regexp_matches(rt, '^[-+]?\.?[eE]') THEN NULL
  WHEN rate > 0 AND rate <= 1 THEN rate ELSE 1.0::DOUBLE END"""
_RATE_VALUE = r"TRY_CAST(regexp_extract(rt, '^[+-]?[0-9]*(\.[0-9]*)?([eE][+-]?[0-9]+)?') AS DOUBLE)"


def _num(c: str) -> str:
    return _NUM.format(c, f"TRY_CAST(regexp_extract({c}, '^[+-]?[0-9]*(\\.[0-9]*)?([eE][+-]?[0-9]+)?') AS DOUBLE)")


_SAMPLES = f"""
tokens AS (
  SELECT seq, ts, name, value AS raw, type AS t, samplerate AS rt FROM ascii_parser
  WHERE length(name) > 0 AND strpos(name, ':') = 0 AND length(value) > 0 AND strpos(value, '|') = 0
    AND (type IN ('kv', 'g', 's') AND samplerate IS NULL OR type IN ('ms', 'h', 'c'))
),
numbers AS (SELECT *, CASE WHEN t <> 's' THEN {_num("raw")} END AS value, {_RATE_VALUE} AS rate FROM tokens),
samples AS (
  SELECT seq, ts, name, value, CASE WHEN t = 's' THEN raw END AS member,
         CASE WHEN t = 'h' THEN 'ms' WHEN t = 'g' AND regexp_matches(raw, '^[+-]') THEN 'gd' ELSE t END AS type,
         {_RATE} AS sample_rate
  FROM numbers WHERE value IS NOT NULL OR t = 's'
),
good AS (SELECT * FROM samples WHERE sample_rate IS NOT NULL)
"""

_TIMER_SQL = """round(sum(value), {s}) AS sum, {sq} round(avg(value), {m}) AS mean, min(value) AS lower, max(value) AS upper,
  CAST(sum(CAST(floor(1.0 / sample_rate) AS BIGINT)) AS BIGINT) AS count, count(value) AS actual_count,
  round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(value) END, {m}) AS stdev"""


def _bin_sql(h: Histogram) -> str:
    return f"CASE WHEN value < {h.min_val} THEN 0 WHEN value >= {h.max_val} THEN {h.num_bins - 1} ELSE CAST(trunc((value - {h.min_val}) / {h.bin_width}::DOUBLE) AS INTEGER) + 1 END"


def _hist_sql(hists: tuple[Histogram, ...]) -> str:
    ordered = sorted(hists, key=lambda h: -len(h.prefix))
    case = "CASE " + " ".join(f"WHEN starts_with(event_type, '{h.prefix}') THEN {_bin_sql(h)}" for h in ordered) + " END"
    labels = ", ".join(f"({i}, '{h.prefix}', {b}, '{h.label(b)}')" for i, h in enumerate(ordered) for b in range(h.num_bins))
    which = "CASE " + " ".join(f"WHEN starts_with(event_type, '{h.prefix}') THEN {i}" for i, h in enumerate(ordered)) + " END"
    return f"""WITH labels(h, prefix, bin, label) AS (VALUES {labels}),
      names AS (SELECT DISTINCT event_type AS name, {which} AS h FROM events WHERE {which} IS NOT NULL),
      counted AS (SELECT event_type AS name, {case} AS bin, count(*) AS c FROM events GROUP BY ALL)
      SELECT n.name, CAST(l.bin AS INTEGER) AS bin, l.label, coalesce(c.c, 0) AS count
      FROM names n JOIN labels l ON l.h = n.h LEFT JOIN counted c ON c.name = n.name AND c.bin = l.bin"""


_EVENT_RATED = f"SELECT event_id, event_type AS name, value, {_RATE_SQL} AS sample_rate FROM events"
_Q = ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)
_STATS = ("sum", "sum(value)"), ("sum_sq", "sum(value * value)"), ("mean", "avg(value)"), ("lower", "min(value)"), ("upper", "max(value)"), ("count", "count(*)"), ("stdev", "coalesce(stddev_samp(value), 0)")
_ALL_TIMER = [*_STATS, ("median", "quantile_disc(value, 0.5)"), *[(n, f"quantile_disc(value, {q})") for n, q in _Q], ("rate", "sum(value) / 10"), ("sample_rate", "count(*) / 10.0")]
_EXT = """WITH x AS ({0}), c AS (SELECT name, sum(value * (1.0 / sample_rate)) AS s, sum(CAST(floor(1.0 / sample_rate) AS BIGINT)) AS n FROM x GROUP BY name)
  SELECT 'c' AS type, 'counts.' || name || '.count' AS key, round(CAST({1} AS DOUBLE), 3) AS value FROM c
  UNION ALL SELECT 'c', 'counts.' || name || '.rate', round(s / 10.0, 3) FROM c"""

def _every(rows: dict[str, str]) -> str:
    """All flushed rows as (type, name, stat, value, hist_count), from `good` samples and histograms."""
    return " UNION ALL ".join(f"SELECT '{t}' AS type, name, {stat} AS stat, CAST({e} AS DOUBLE) AS value, {h} AS hist_count FROM {src}" for (t, stat), (e, h, src) in rows.items())


_NO_COUNT = "CAST(NULL AS BIGINT)"
_HIST_CTE = """
hcfg AS (SELECT *, CAST(trunc((max_val - min_val) / bin_width + 2) AS INTEGER) AS bins FROM hist_cfg),
hnames AS (SELECT name, arg_max(hcfg, length(prefix)) AS h FROM (SELECT DISTINCT name FROM good WHERE type = 'ms') JOIN hcfg ON starts_with(name, prefix) GROUP BY name),
hcounted AS (
  SELECT g.name, CASE WHEN value < h.min_val THEN 0 WHEN value >= h.max_val THEN h.bins - 1
         ELSE CAST(trunc((value - h.min_val) / h.bin_width) AS INTEGER) + 1 END AS bin, count(*) AS c
  FROM good g JOIN hnames n USING (name) WHERE type = 'ms' GROUP BY ALL),
hspine AS (SELECT name, h, CAST(unnest(generate_series(0, h.bins - 1)) AS INTEGER) AS bin FROM hnames),
hist AS (
  SELECT s.name, s.bin, coalesce(c.c, 0) AS c, h.bins AS bins,
         CASE WHEN s.bin = 0 THEN h.min_val WHEN s.bin = h.bins - 1 THEN h.max_val ELSE h.min_val + h.bin_width * (s.bin - 1) END AS edge
  FROM hspine s LEFT JOIN hcounted c USING (name, bin)),
gbase AS (SELECT name, max(seq) FILTER (type = 'g') AS base FROM good WHERE type IN ('g', 'gd') GROUP BY name),
gauges AS (SELECT g.name, sum(value) AS value FROM good g JOIN gbase USING (name) WHERE type IN ('g', 'gd') AND (base IS NULL OR seq >= base) GROUP BY g.name)
"""
_SCALED, _WEIGHT = "sum(value * (1.0 / sample_rate))", "sum(CAST(floor(1.0 / sample_rate) AS BIGINT))"
_C_ROWS, _MS_ROWS, _S_ROWS = "good WHERE type = 'c' GROUP BY name", "good WHERE type = 'ms' GROUP BY name", "good WHERE type = 's' GROUP BY name"
_DEFAULT_Q = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
_MS_STATS = {
    "sum": "sum(value)", "sum_sq": "sum(value * value)", "mean": "avg(value)", "lower": "min(value)", "upper": "max(value)", "count": _WEIGHT, "stdev": "coalesce(stddev_samp(value), 0)",
    "median": "quantile_disc(value, 0.5)", **{n: f"quantile_disc(value, {q})" for n, q in _DEFAULT_Q}, "rate": "sum(value) / 10", "sample_rate": f"{_WEIGHT} / 10.0",
}
_FLUSHED = _every(
    {
        ("kv", "''"): ("value", _NO_COUNT, "good WHERE type = 'kv'"),
        ("c", "'count'"): (_WEIGHT, _NO_COUNT, _C_ROWS),
        ("c", "'rate'"): (f"{_SCALED} / 10", _NO_COUNT, _C_ROWS),
        **{("ms", f"'{n}'"): (e, _NO_COUNT, _MS_ROWS) for n, e in _MS_STATS.items()},
        ("g", "''"): ("value", _NO_COUNT, "gauges"),
        ("s", "''"): ("count(DISTINCT member)", _NO_COUNT, _S_ROWS),
        ("ms", "'histogram.bin_' || CASE WHEN bin = 0 THEN '<' WHEN bin = bins - 1 THEN '>' ELSE '' END || format('{:.2f}', edge)"): ("c", "c", "hist"),
    }
)
#: Type, value type and source of every record of a packed flush.
_PACKED = {
    (1, "0"): ("value", _NO_COUNT, "good WHERE type = 'kv'"),
    (2, "4"): (_WEIGHT, _NO_COUNT, _C_ROWS),
    (2, "11"): (f"{_SCALED} / 10", _NO_COUNT, _C_ROWS),
    **{(3, str(c)): (_MS_STATS[n], _NO_COUNT, _MS_ROWS) for n, c in (("sum", 1), ("sum_sq", 2), ("mean", 3), ("count", 4), ("stdev", 5), ("lower", 6), ("upper", 7), ("rate", 11), ("sample_rate", 12))},
    **{(3, str(128 | int(q * 100))): (f"quantile_disc(value, {q})", _NO_COUNT, _MS_ROWS) for _, q in _DEFAULT_Q},
    (5, "0"): ("value", _NO_COUNT, "gauges"),
    (4, "1"): ("count(DISTINCT member)", _NO_COUNT, _S_ROWS),
    (3, "CASE WHEN bin = 0 THEN 8 WHEN bin = bins - 1 THEN 10 ELSE 9 END"): ("edge", "c", "hist"),
}
_PREFIX = "CASE type WHEN {0} THEN 'kv.' WHEN {1} THEN 'counts.' WHEN {2} THEN 'timers.' WHEN {3} THEN 'gauges.' ELSE 'sets.' END"


ORACLE_SQL = {
    "flush_messages": f"""WITH {_SAMPLES}, {_HIST_CTE}, flushed AS ({_FLUSHED})
        SELECT CAST({FLUSHED_AT} AS BIGINT) AS ts, type, {_PREFIX.format("'kv'", "'c'", "'ms'", "'g'")} || name || CASE WHEN stat = '' THEN '' ELSE '.' || stat END AS key,
               CASE WHEN stat = 'sum_sq' THEN round(value, 0) WHEN stat IN ('mean', 'stdev') THEN round(value, 7) ELSE round(value, 6) END AS value, hist_count FROM flushed""",
    "flush_within_bound": f"""WITH {_SAMPLES} SELECT 's' AS type, name, 'members' AS stat FROM {_S_ROWS}
        UNION ALL SELECT 'ms', name, 'q' || i FROM (SELECT name FROM {_MS_ROWS}), (VALUES (0), (1), (2)) AS q(i)""",
    "input_counter_messages": f"""WITH {_SAMPLES} SELECT name, round({_SCALED}, 5) AS sum, CAST({_WEIGHT} AS BIGINT) AS count FROM {_C_ROWS}
        UNION ALL SELECT 'inputs', CAST(count(*) AS DOUBLE), count(*) FROM tokens""",
    "condensed_messages": f"""WITH lines AS (
          SELECT name, value AS raw, type AS t, samplerate AS rt FROM ascii_parser
          WHERE length(name) > 0 AND strpos(name, ':') = 0 AND length(value) > 0 AND strpos(value, '|') = 0 AND strpos(value, ':') = 0
            AND (type IN ('kv', 'g', 's') AND samplerate IS NULL OR type IN ('ms', 'h', 'c') AND coalesce(samplerate, 'x') <> '' AND strpos(coalesce(samplerate, ''), ':') = 0)),
        numbers AS (SELECT *, {_num("raw")} AS value, {_RATE_VALUE} AS rate FROM lines),
        rated AS (SELECT name, value, {_RATE} AS sample_rate FROM numbers WHERE t = 'c' AND value IS NOT NULL),
        every AS (SELECT * FROM rated WHERE sample_rate IS NOT NULL UNION ALL SELECT name, 1.0::DOUBLE, 1.0::DOUBLE FROM lines)
        SELECT name, round({_SCALED}, 5) AS sum, CAST({_WEIGHT} AS BIGINT) AS count FROM every GROUP BY name""",
    "binary_round_trip_all": f"""WITH {_SAMPLES}, {_HIST_CTE}, packed AS ({" UNION ALL ".join(f"SELECT {t} AS type, CAST({c} AS INTEGER) AS value_type, name, CAST({e} AS DOUBLE) AS value, {h} AS hist_count FROM {src}" for (t, c), (e, h, src) in _PACKED.items())})
        SELECT CAST({FLUSHED_AT} AS BIGINT) AS ts, CAST(type AS INTEGER) AS type, value_type, 'all.' || {_PREFIX.format(1, 2, 3, 5)} || name AS key,
               CASE WHEN type = 3 AND value_type = 2 THEN round(value, 0) WHEN type = 3 AND value_type IN (3, 5) THEN round(value, 7) ELSE round(value, 6) END AS value, hist_count FROM packed""",
    "counter_sum": "SELECT event_type AS name, round(sum(value), 3) AS sum FROM events GROUP BY 1",
    "counter_rate": "SELECT event_type AS name, round(sum(value) / 10.0, 3) AS rate FROM events GROUP BY 1",
    "counter_sampled": f"""SELECT name, round(sum(value * (1.0 / sample_rate)), 3) AS sum, CAST(sum(CAST(floor(1.0 / sample_rate) AS BIGINT)) AS BIGINT) AS count,
        round(sum(value * (1.0 / sample_rate)) / 10.0, 3) AS rate FROM ({_EVENT_RATED}) GROUP BY name""",
    "counter_extended": _EXT.format(_EVENT_RATED, "n"),
    "counter_extended_nonlegacy": _EXT.format(_EVENT_RATED, "s"),
    "timer_stats": f"""SELECT name, {_TIMER_SQL.format(s=3, sq='round(sum(value * value), 1) AS sum_sq,', m=6)}, round(sum(value) / 10.0, 3) AS rate,
        round(sum(CAST(floor(1.0 / sample_rate) AS BIGINT)) / 10.0, 3) AS sample_rate FROM ({_EVENT_RATED}) AS t GROUP BY name""",
    "timer_quantiles": "SELECT event_type AS name, " + ", ".join(f"quantile_disc(value, {q}) AS {n}" for n, q in _Q) + ", quantile_disc(value, 0.5) AS median FROM events GROUP BY 1",
    "timer_quantiles_approx": "SELECT name, 'q' || i AS stat FROM (SELECT DISTINCT event_type AS name FROM events), (VALUES (0), (1), (2)) AS q(i)",
    "timer_histogram": _hist_sql(HISTS[:1]),
    "timer_histogram_prefix": _hist_sql(HISTS),
    "timers_windowed": f"""SELECT CAST(floor(epoch(ts) / {WINDOW}) * {WINDOW} AS BIGINT) AS window_start, event_type AS name, round(sum(value), 3) AS sum, count(*) AS count,
        min(value) AS lower, max(value) AS upper FROM events GROUP BY ALL""",
    "lineitem_timers": """SELECT l_returnflag || '.' || l_linestatus AS name, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS lower, max(l_extendedprice) AS upper,
        count(*) AS count, round(stddev_samp(l_extendedprice), 4) AS stdev, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99
        FROM lineitem GROUP BY 1""",
    "gauge_last": "SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "gauge_delta": """WITH b AS (SELECT event_type, max(event_id) FILTER (event_id % 1000 = 0) AS base FROM events GROUP BY 1)
        SELECT e.event_type AS name, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 3) AS value
        FROM events e JOIN b USING (event_type) WHERE b.base IS NULL OR e.event_id >= b.base GROUP BY 1""",
    "kv_passthrough": "SELECT event_type AS name, value, event_id AS seq FROM events",
    "set_exact": "SELECT event_type AS name, count(DISTINCT user_id) AS members FROM events GROUP BY 1",
    "set_hybrid_small": """SELECT event_type || '.' || strftime(ts, '%Y-%m-%dT%H') AS name, count(DISTINCT user_id) AS members FROM events
        GROUP BY 1""",
    "set_hll_within_bound": "SELECT event_type AS name, count(DISTINCT user_id) AS members FROM events GROUP BY 1",
    "input_counter": """SELECT event_type AS name, round(sum(value), 3) AS sum, count(*) AS count FROM events WHERE event_id % 2 = 0 GROUP BY 1
        UNION ALL SELECT 'numStats', CAST(count(*) AS DOUBLE), count(*) FROM events""",
    "flush_all_types": " UNION ALL ".join(
        [
            "SELECT 'c' AS type, event_type AS name, '' AS stat, 'app.counts.' || event_type AS key, round(sum(value), 1) AS value FROM events GROUP BY event_type",
            "SELECT 's', event_type, '', 'app.sets.' || event_type, CAST(count(DISTINCT user_id) AS DOUBLE) FROM events GROUP BY event_type",
            "SELECT 'g', event_type, '', 'app.gauges.' || event_type, round(arg_max(value, event_id), 1) FROM events GROUP BY event_type",
            *[f"SELECT 'ms', event_type, '{n}', 'app.timers.' || event_type || '.{n}', round(CAST({e} AS DOUBLE), 1) FROM events GROUP BY event_type" for n, e in _ALL_TIMER],
        ]
    ),
    "flush_text": """SELECT 'gauges.' || event_type || '|' || format('{:.6f}', arg_max(value, event_id)) || '|1700000000' AS line FROM events GROUP BY event_type
        UNION ALL SELECT 'kv.' || event_type || '|' || format('{:.6f}', value) || '|1700000000' FROM events""",
    "binary_round_trip": " UNION ALL ".join(
        [f"SELECT CAST(1700000000 AS BIGINT) AS ts, CAST({t} AS INTEGER) AS type, CAST({c} AS INTEGER) AS value_type, event_type AS key, round(CAST({e} AS DOUBLE), 1) AS value FROM events GROUP BY event_type"
         for t, c, e in [(2, 4, "count(*)"), (2, 11, "sum(value) / 10"), *[(3, i + 1, e) for i, (_, e) in enumerate((_STATS[0], _STATS[1], _STATS[2], _STATS[5], _STATS[6], _STATS[3], _STATS[4]))],
                         (3, 11, "sum(value) / 10"), (3, 12, "count(*) / 10.0"), *[(3, 128 | int(q * 100), f"quantile_disc(value, {q})") for _, q in _Q]]]
    ),
    "binary_message_types": """SELECT event_id AS seq, ['kv', 'c', 'ms', 's', 'g', 'gd'][event_id % 6 + 1] AS type, event_type AS name, CASE WHEN event_id % 6 <> 3 THEN value END AS value,
        CASE WHEN event_id % 6 = 3 THEN CAST(user_id AS VARCHAR) END AS member FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL""",
    "timers_chosen": " UNION ALL ".join(
        f"SELECT 'timers.' || event_type || '.{n}' AS key, round(CAST({e} AS DOUBLE), 6) AS value FROM events GROUP BY event_type"
        for n, e in (("mean", "avg(value)"), ("upper", "max(value)"), ("count", "count(*)"), ("p12", "quantile_disc(value, 0.125)"), ("p100", "quantile_disc(value, 0.995)"))
    ),
    "binary_messages": "SELECT event_type AS name, round(sum(value), 3) AS sum, count(*) AS count FROM events GROUP BY 1",
    "parse_numbers": f"SELECT seq, {_num('value')} AS number FROM ascii_parser WHERE type <> 's'",
    "parse_lines": f"""WITH lines AS (
          SELECT seq, regexp_extract(name || ':' || value || '|' || type || coalesce('|@' || samplerate, ''),
                 '(?s)^([^:]+):([^|]+)\\|((kv|g|s)|(ms|h|c)(\\|@([^\\n]+))?)$', ['name', 'raw', 'tail', 'u', 't', 'x', 'rt']) AS f
          FROM ascii_parser WHERE name IS NOT NULL AND value IS NOT NULL AND type IS NOT NULL),
        tokens AS (SELECT seq, f.name AS name, f.raw AS raw, f.u || f.t AS t, nullif(f.rt, '') AS rt FROM lines WHERE f.name <> ''),
        numbers AS (SELECT *, CASE WHEN t <> 's' THEN {_num("raw")} END AS value, {_RATE_VALUE} AS rate FROM tokens),
        samples AS (
          SELECT seq, CASE WHEN t = 'h' THEN 'ms' WHEN t = 'g' AND regexp_matches(raw, '^[+-]') THEN 'gd' ELSE t END AS type, name, value,
                 CASE WHEN t = 's' THEN raw END AS member,
                 {_RATE} AS sample_rate
          FROM numbers WHERE value IS NOT NULL OR t = 's')
        SELECT * FROM samples WHERE sample_rate IS NOT NULL""",
    "message_counters": f"""WITH {_SAMPLES} SELECT name, round(sum(value * (1.0 / sample_rate)), 5) AS sum, CAST(sum(CAST(floor(1.0 / sample_rate) AS BIGINT)) AS BIGINT) AS count
        FROM good WHERE type = 'c' GROUP BY name""",
    "message_timers": f"""WITH {_SAMPLES} SELECT name, {_TIMER_SQL.format(s=5, sq='', m=7)}, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99
        FROM good WHERE type = 'ms' GROUP BY name""",
    "message_gauges": f"""WITH {_SAMPLES}, b AS (SELECT name, max(seq) FILTER (type = 'g') AS base FROM good WHERE type IN ('g', 'gd') GROUP BY name)
        SELECT g.name, round(sum(value), 3) AS value FROM good g JOIN b USING (name)
        WHERE type IN ('g', 'gd') AND (base IS NULL OR seq >= base) GROUP BY g.name""",
    "message_sets": f"WITH {_SAMPLES} SELECT name, count(DISTINCT member) AS members FROM good WHERE type = 's' GROUP BY name",
    "message_histograms": f"""WITH {_SAMPLES},
        cfg AS (SELECT *, CAST(trunc((max_val - min_val) / bin_width + 2) AS INTEGER) AS bins FROM hist_cfg),
        names AS (SELECT name, arg_max(cfg, length(prefix)) AS h FROM (SELECT DISTINCT name FROM good WHERE type = 'ms') JOIN cfg ON starts_with(name, prefix) GROUP BY name),
        counted AS (
          SELECT g.name, CASE WHEN value < h.min_val THEN 0 WHEN value >= h.max_val THEN h.bins - 1
                 ELSE CAST(trunc((value - h.min_val) / h.bin_width) AS INTEGER) + 1 END AS bin, count(*) AS c
          FROM good g JOIN names n USING (name) WHERE type = 'ms' GROUP BY ALL),
        spine AS (SELECT name, CAST(unnest(generate_series(0, h.bins - 1)) AS INTEGER) AS bin FROM names)
        SELECT s.name, s.bin, coalesce(c.c, 0) AS count FROM spine s LEFT JOIN counted c USING (name, bin)""",
    "replay_counters": f"""WITH {_SAMPLES} SELECT CAST(floor(epoch(ts) / 60) * 60 + 60 AS BIGINT) AS ts, 'counts.' || name AS key, round(sum(value * (1.0 / sample_rate)), 3) AS value
        FROM good WHERE type = 'c' AND ts IS NOT NULL GROUP BY ALL""",
    "counter_few_keys": "SELECT 'key' || CAST(l_orderkey % 3 AS VARCHAR) AS name, round(sum(l_quantity), 3) AS sum, count(*) AS count FROM lineitem GROUP BY 1",
    "set_few_keys": """SELECT 'key' || CAST(l_orderkey % 3 AS VARCHAR) AS name,
        count(DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1""",
}
