"""The latest statistics of every key, merged with what was kept before.

A state row is key, ts, type and the statistics of one flush. New keys replace old ones; where old and new are both
counters, sums and counts add up and extremes combine, statistics that are absent staying absent.

The state is kept in versions, as JSON, Parquet, or YAML with one key a line. For programs that read Ruby's Marshal it comes
as payloads, and is read back from them. YAML and Marshal hold, by key, the statistics by name, percentiles as P50 and so on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.sinks import marshal
from meterloom.sinks.payloads import _chunked

#: Value type of binary records to state column, and names of types; fixed values. Percentiles (128 + p) go to the map `percentiles`.
STATS = {0: "kv", 1: "sum", 2: "sumsqrt", 3: "mean", 4: "count", 5: "stddev", 6: "min", 7: "max"}
TYPES = {1: "kv", 2: "counter", 3: "timer", 4: "set", 5: "gauge"}


STATE_SCHEMA = (
    "key string, ts bigint, type string, kv double, sum double, sumsqrt double, mean double, count double, stddev double, min double, max double, percentiles map<string,double>"
)


def collect_state(recs: DataFrame) -> DataFrame:
    """(key, ts, type, kv, sum, sumsqrt, mean, count, stddev, min, max, percentiles) of decoded binary records."""
    order = F.struct("ts", *(["seq"] if "seq" in recs.columns else []))
    kinds = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])
    # the last value of every statistic first, of which a key has a bounded number
    last = recs.groupBy("key", "value_type").agg(F.max_by(F.struct("value", "type"), order).alias("x"), F.max(order).alias("order"))
    stat = F.col("value_type")
    pct = F.when((stat >= 128) & (stat < 256), F.struct((stat - 128).cast("string").alias("k"), F.col("x.value").alias("v")))
    return last.groupBy("key").agg(
        F.max("order.ts").alias("ts"),
        F.max_by(F.try_element_at(kinds, F.col("x.type").cast("int")), F.col("order")).alias("type"),
        *[F.max(F.when(stat == c, F.col("x.value"))).alias(n) for c, n in STATS.items()],
        F.map_from_entries(F.array_sort(F.collect_list(pct))).alias("percentiles"),
    )


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after `new`: one row per key of either side."""
    o, n = old.alias("o"), new.alias("n")
    both = (F.col("o.type") == "counter") & (F.col("n.type") == "counter")
    there = F.col("n.key").isNotNull()

    def pick(name: str):
        a, b = F.col(f"o.{name}"), F.col(f"n.{name}")
        joined = b
        if name in ("sum", "count", "sumsqrt"):
            joined = F.when(both, F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))).otherwise(b)
        elif name == "min":
            joined = F.when(both, F.least(a, b)).otherwise(b)
        elif name == "max":
            joined = F.when(both, F.greatest(a, b)).otherwise(b)
        return F.when(there, joined).otherwise(a).alias(name)

    rest = [c for c in new.columns if c != "key"]
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(F.coalesce("n.key", "o.key").alias("key"), *[pick(c) for c in rest])


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(where))
    return sorted(int(m[1]) for n in names if (m := re.fullmatch("version=([0-9]+)", n)))


_FIELDS = ("kv", "sum", "sumsqrt", "mean", "count", "stddev", "min", "max")


def _by_name(state: DataFrame) -> DataFrame:
    """(key, stats): a key's statistics by name, as texts of JSON values; absent ones left out."""
    plain = [F.struct(F.lit(n).alias("n"), (F.to_json(F.struct(F.col(n).alias("v")))).alias("v")) for n in ("ts", "type", *_FIELDS)]
    shares = F.transform(
        F.map_entries(F.coalesce("percentiles", F.create_map().cast("map<string,double>"))),
        lambda e: F.struct(F.concat(F.lit("P"), F.lpad(e["key"], 2, "0")).alias("n"), F.to_json(F.struct(e["value"].alias("v"))).alias("v")),
    )
    known = F.filter(F.concat(F.array(*plain), shares), lambda e: e["v"] != "{}")
    inner = F.transform(known, lambda e: F.struct(e["n"].alias("n"), F.regexp_extract(e["v"], r'(?s)^\{"v":(.*)\}$', 1).alias("v")))
    return state.select("key", inner.alias("stats"))


def _from_names(named: DataFrame) -> DataFrame:
    """State rows of (key, stats), stats a map of texts."""
    stat = lambda n: F.try_element_at("stats", F.lit(n))
    shares = F.filter(F.map_entries("stats"), lambda e: e["key"].rlike("^P[0-9]+$"))
    percentiles = F.map_from_entries(
        F.array_sort(F.transform(shares, lambda e: F.struct(F.substring(e["key"], 2, 9).cast("int").cast("string").alias("key"), e["value"].try_cast("double").alias("value"))))
    )
    return named.select("key", stat("ts").try_cast("bigint").alias("ts"), stat("type").alias("type"), *[stat(n).try_cast("double").alias(n) for n in _FIELDS], percentiles.alias("percentiles"))


def yaml_lines(state: DataFrame) -> DataFrame:
    """(value): one line a key, `"key": {"name": value, ...}`; together they are one YAML mapping."""
    name = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    body = F.array_join(F.transform("stats", lambda e: F.concat(F.lit('"'), e["n"], F.lit('": '), e["v"])), ", ")
    return _by_name(state.where("key is not null")).select(F.concat(name(F.col("key")), F.lit(": {"), body, F.lit("}")).alias("value"))


def read_yaml_lines(lines: DataFrame) -> DataFrame:
    every = F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}")), "map<string,map<string,string>>")
    return _from_names(lines.select(F.explode(every).alias("key", "stats")))


def marshal_payloads(state: DataFrame, size: int = 50_000) -> DataFrame:
    """(payload, n): mappings of at most `size` keys each, as Ruby's Marshal writes them."""

    def build(rows: list[tuple]) -> bytes:
        return marshal.dumps({key: {e["n"]: json.loads(e["v"]) for e in stats} for key, stats in rows})

    return _chunked(_by_name(state.where("key is not null")), ["key", "stats"], size, build, "binary")


def read_marshal(payloads: DataFrame, column: str = "payload") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                found = marshal.loads(data)
                stats = [[(str(n), None if v is None else str(v)) for n, v in x.items()] for x in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(map(str, found), pa.string()), pa.array(stats, pa.map_(pa.string(), pa.string()))], names=["key", "stats"])

    return _from_names(payloads.select(column).mapInArrow(run, "key string, stats map<string,string>"))


def load_state(spark: SparkSession, path: str, kind: str = "json", version: int | None = None) -> DataFrame | None:
    """The kept state, the latest version unless told otherwise; None where there is none."""
    found = _versions(spark, path)
    if not found:
        return None
    where = f"{path}/version={found[-1] if version is None else version}"
    return read_yaml_lines(spark.read.text(where)) if kind == "yaml" else spark.read.schema(STATE_SCHEMA).format(kind).load(where)


def update_state(new: DataFrame, path: str, kind: str = "json") -> int:
    """Merge a flush into the kept state and write it as the next version; readers of the old one are not disturbed."""
    spark = new.sparkSession
    old = load_state(spark, path, kind)
    merged = new if old is None else merge_state(old, new)
    version = (_versions(spark, path) or [0])[-1] + 1
    out = yaml_lines(merged).write.format("text") if kind == "yaml" else merged.write.format(kind)
    out.save(f"{path}/version={version}")
    return version
