"""From aggregates to flushed records: one row per statistic, as `key|value|timestamp` text or as packed binary.

Flushed rows: ts, type, name, stat, key, value, whole, hist_count, rank, seq. whole marks values that are written as
integers; rank orders types as a text stream does (kv, counters, timers, gauges, sets).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.config import EngineConfig, percentile_code, percentile_label
from meterloom.operators import aggregate as agg
from meterloom.operators.aggregate import longest_prefix

#: Order of types in a stream.
RANK = {"kv": 0, "c": 1, "ms": 2, "g": 3, "s": 4}
#: Codes of binary records; fixed values of the format.
TYPE_CODES = {"kv": 1, "c": 2, "ms": 3, "s": 4, "g": 5}
VALUE_CODES = {
    "": 0,
    "sum": 1,
    "sum_sq": 2,
    "mean": 3,
    "count": 4,
    "stdev": 5,
    "lower": 6,
    "upper": 7,
    "hist_floor": 8,
    "hist_bin": 9,
    "hist_ceil": 10,
    "rate": 11,
    "sample_rate": 12,
}
HEADER = "<QBBHd"
HIST_COUNT = "<I"
_COLUMNS = ["type", "name", "stat", "code", "value", "whole", "hist_count", "rank", "seq"]


def _item(stat: str, value: Column, code: int, whole: bool = False) -> Column:
    return F.struct(F.lit(stat).alias("stat"), F.lit(code).alias("code"), value.cast("double").alias("value"), F.lit(whole).alias("whole"))


def _rows(df: DataFrame, kind: str, items: list[Column], by: tuple[str, ...], seq: Column | None = None) -> DataFrame:
    x = df.select(*by, "name", (seq if seq is not None else F.lit(None).cast("bigint")).alias("seq"), F.posexplode(F.array(*items)).alias("_pos", "_x"))
    return x.select(
        *by,
        F.lit(kind).alias("type"),
        "name",
        F.col("_x.stat").alias("stat"),
        F.col("_x.code").alias("code"),
        F.col("_x.value").alias("value"),
        F.col("_x.whole").alias("whole"),
        F.lit(None).cast("bigint").alias("hist_count"),
        (F.lit(RANK[kind] * 10_000) + F.col("_pos")).cast("int").alias("rank"),
        "seq",
    )


def timer_items(cfg: EngineConfig, binary: bool) -> list[Column]:
    """Which statistics of a timer come out, in order; quantiles always do, and in binary everything but the median."""
    wanted = set(cfg.timers_include) if not binary else {"sum", "sum_sq", "mean", "lower", "upper", "count", "stdev", "rate", "sample_rate"}
    out = []
    for stat in ("sum", "sum_sq", "mean", "lower", "upper", "count", "stdev"):
        if stat in wanted:
            out.append(_item(stat, F.col(stat), VALUE_CODES[stat], whole=stat == "count"))
    if "median" in wanted and 0.5 in cfg.quantiles:
        out.append(_item("median", F.col("median"), percentile_code(0.5)))
    for i, q in enumerate(cfg.quantiles):
        out.append(_item(percentile_label(q), F.element_at("quantiles", i + 1), percentile_code(q)))
    for stat in ("rate", "sample_rate"):
        if stat in wanted:
            out.append(_item(stat, F.col(stat), VALUE_CODES[stat]))
    return out


def counter_items(cfg: EngineConfig, binary: bool) -> list[Column]:
    if binary:
        count = F.col("count") if cfg.legacy_extended_counters else F.col("sum")
        return [_item("count", count, VALUE_CODES["count"]), _item("rate", F.col("rate"), VALUE_CODES["rate"])]
    if not cfg.extended_counters:
        return [_item("", F.col("sum"), VALUE_CODES["sum"])]
    legacy = cfg.legacy_extended_counters
    count = _item("count", F.col("count"), VALUE_CODES["count"], whole=True) if legacy else _item("count", F.col("sum"), VALUE_CODES["count"])
    return [count, _item("rate", F.col("rate"), VALUE_CODES["rate"])]


def set_items() -> list[Column]:
    return [_item("", F.col("members"), VALUE_CODES["sum"], whole=True)]


def _scalar_rows(df: DataFrame, cfg: EngineConfig, by: tuple[str, ...], binary: bool) -> DataFrame:
    """The rows of counters, timers and sets, which come from one aggregate."""
    items = {"c": counter_items(cfg, binary), "ms": timer_items(cfg, binary), "s": set_items()}
    case = F.coalesce(*[F.when(F.col("type") == k, F.array(*v)) for k, v in items.items()])
    rank = F.coalesce(*[F.when(F.col("type") == k, F.lit(RANK[k] * 10_000)) for k in items])
    return df.select(*by, "type", "name", F.posexplode(case).alias("_pos", "_x")).select(
        *by,
        "type",
        "name",
        F.col("_x.stat").alias("stat"),
        F.col("_x.code").alias("code"),
        F.col("_x.value").alias("value"),
        F.col("_x.whole").alias("whole"),
        F.lit(None).cast("bigint").alias("hist_count"),
        (rank + F.col("_pos")).cast("int").alias("rank"),
        F.lit(None).cast("bigint").alias("seq"),
    )


def _with_key(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    prefix = F.coalesce(*[F.when(F.col("type") == k, F.lit(cfg.prefix(k))) for k in RANK])
    suffix = F.when(F.col("stat") == "", F.lit("")).otherwise(F.concat(F.lit("."), "stat"))
    return df.withColumn("key", F.concat(prefix, "name", suffix))


def flush(samples: DataFrame, cfg: EngineConfig = EngineConfig(), ts: Column | None = None, by: tuple[str, ...] = (), binary: bool = False) -> DataFrame:
    """All flushed rows of an interval's samples; ts: epoch second of the flush."""
    x = agg.count_inputs(samples, cfg)
    seq = "seq" if "seq" in samples.columns else None
    ordered = x if seq else x.withColumn("seq", F.monotonically_increasing_id())
    parts = [
        _rows(agg.key_values(ordered, by), "kv", [_item("", F.col("value"), VALUE_CODES[""])], by, F.col("seq")),
        _scalar_rows(agg.scalars(x, cfg, by), cfg, by, binary),
        _rows(agg.gauges(ordered, by), "g", [_item("", F.col("value"), VALUE_CODES[""])], by),
    ]
    if cfg.exact_sets:
        parts.append(_rows(agg.sets(x, cfg, by, exact=True), "s", set_items(), by))
    if cfg.histograms:
        last = longest_prefix(F.col("name"), cfg.histograms, lambda h: F.lit(h.num_bins - 1))
        edge = longest_prefix(
            F.col("name"), cfg.histograms, lambda h: F.when(F.col("bin") == 0, h.min_val).when(F.col("bin") == h.num_bins - 1, h.max_val).otherwise(h.min_val + h.bin_width * (F.col("bin") - 1))
        )
        code = F.when(F.col("bin") == 0, VALUE_CODES["hist_floor"]).when(F.col("bin") == last, VALUE_CODES["hist_ceil"]).otherwise(VALUE_CODES["hist_bin"])
        h = agg.histograms(x, cfg, by)
        parts.append(
            h.select(
                *by,
                F.lit("ms").alias("type"),
                "name",
                F.concat(F.lit("histogram."), "label").alias("stat"),
                code.alias("code"),
                (edge if binary else F.col("count")).cast("double").alias("value"),
                F.lit(True).alias("whole"),
                F.col("count").alias("hist_count"),
                (F.lit(RANK["ms"] * 10_000 + 5_000) + F.col("bin")).cast("int").alias("rank"),
                F.lit(None).cast("bigint").alias("seq"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    stamp = ts if ts is not None else F.unix_timestamp()
    return _with_key(out.select(*by, *_COLUMNS), cfg).select(*by, stamp.cast("bigint").alias("ts"), "key", *_COLUMNS)


def in_stream_order(flushed: DataFrame) -> DataFrame:
    """Sorted as one text stream: by type, keys together, statistics in order, key-values latest first."""
    kind = F.floor(F.col("rank") / 10_000)
    return flushed.orderBy(kind, F.col("seq").desc_nulls_last(), "name", "rank")


@F.pandas_udf(T.StringType())
def _line(key: pd.Series, value: pd.Series, whole: pd.Series, ts: pd.Series) -> pd.Series:
    return pd.Series([f"{k}|{int(v) if w else f'{v:f}'}|{t}" for k, v, w, t in zip(key, value, whole, ts)], dtype="object")


def text_records(flushed: DataFrame) -> DataFrame:
    """(line): `key|value|timestamp`, numbers as C's %f writes them."""
    return flushed.select("*", _line("key", "value", "whole", "ts").alias("line"))


def binary_records(flushed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(record): packed header, key with final NUL, and the count of histogram bins. Takes rows of flush(binary=True)."""
    codes = dict(TYPE_CODES)
    prefixes = {k: cfg.prefix(k) for k in RANK} if cfg.prefix_binary_stream else dict.fromkeys(RANK, "")

    @F.pandas_udf(T.BinaryType())
    def pack(ts: pd.Series, kind: pd.Series, code: pd.Series, name: pd.Series, value: pd.Series, hist: pd.Series) -> pd.Series:
        out = []
        for t, k, c, n, v, h in zip(ts, kind, code, name, value, hist):
            key = (prefixes[k] + n).encode() + b"\0"
            tail = struct.pack(HIST_COUNT, int(h) & 0xFFFFFFFF) if 8 <= c <= 10 else b""
            out.append(struct.pack(HEADER, t, codes[k], c, len(key), v) + key + tail)
        return pd.Series(out, dtype="object")

    return flushed.select("*", pack("ts", "type", "code", "name", "value", F.coalesce("hist_count", F.lit(0))).alias("record"))
