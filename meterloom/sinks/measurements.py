"""Tagged measurements: timer statistics of one name folded into one record, tags and source taken from the name.

Keys are `<type>.<name>[#tag=value,...][.suffix]`. For timers (and counters, if those are extended) the suffix names the
statistic; the ones a summary holds become fields of one record per name, source and tag set, and the others stay records
of their own with the field `value`. The last value of a field wins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.numbers import floor_to
from meterloom.sinks.payloads import _chunked

#: Suffix to summary field; fixed values. Suffixes in DROPPED give no field.
SUMMARY = {"sum": "sum", "count": "count", "stdev": "stddev_m2", "lower": "min", "upper": "max"}
DROPPED = ("sum_sq", "mean")
FIELDS = ("value", "sum", "count", "stddev_m2", "min", "max")
NAME_LIMIT = 255


def sanitize(c: Column) -> Column:
    return F.regexp_replace(c, "[^-A-Za-z0-9.:_]", "_")


def parse_names(
    recs: DataFrame,
    extended_counters: bool = False,
    source: str | None = None,
    source_regex: str | None = None,
    source_prefix: str | None = None,
    prefix: str | None = None,
    floor_seconds: int | None = None,
) -> DataFrame:
    """(name, source, tags, field, value, time, seq): one row per record that gives a field; tags as sorted entries."""
    key = F.col("key")
    x = recs.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in recs.columns else recs
    x = x.where(key.rlike("^(kv|timers|counts|gauges|sets)\\..+$"))
    multi = key.startswith("timers.") | (key.startswith("counts.") if extended_counters else F.lit(False))
    time = F.col("ts").cast("bigint")
    x = x.select(
        "seq",
        F.regexp_extract(key, "^(?:kv|timers|counts|gauges|sets)\\.(.+)$", 1).alias("name"),
        multi.alias("multi"),
        F.col("value").cast("double").alias("value"),
        (floor_to(time, floor_seconds) if floor_seconds else time).alias("time"),
        F.lit(source).cast("string").alias("source"),
    )
    if source_regex:
        found = F.col("name").rlike(source_regex)
        x = x.withColumn("source", F.when(found, F.regexp_extract("name", source_regex, 1)).otherwise(F.col("source")))
        # replaces the first match only
        x = x.withColumn("name", F.regexp_replace("name", f"(?s)^(.*?)(?:{source_regex})(.*)$".replace("(?:" + source_regex + ")", "(?:" + _plain(source_regex) + ")"), "$1$2"))
    if source_prefix:
        x = x.withColumn("source", F.concat_ws(".", F.lit(source_prefix), "source"))
    tagged = F.col("name").contains("#")
    raw = F.element_at(F.split("name", "#"), -1)
    suffix = F.substring_index(raw, ".", -1)
    x = x.select(
        "*",
        F.when(tagged & F.col("multi"), F.concat(F.substring_index("name", "#", 1), F.lit("."), suffix)).otherwise(F.substring_index("name", "#", 1)).alias("bare"),
        F.when(tagged & F.col("multi"), F.substring(raw, F.lit(1), F.length(raw) - F.length(suffix) - 1)).when(tagged, raw).alias("raw_tags"),
    )
    stat = F.regexp_extract("bare", "\\.(sum|sum_sq|count|stdev|lower|upper|mean)$", 1)
    field_map = F.create_map(*[F.lit(v) for kv in SUMMARY.items() for v in kv])
    summary = F.col("multi") & (stat != "")
    x = x.where(~(summary & stat.isin(*DROPPED)))
    x = x.withColumn("field", F.when(summary, F.try_element_at(field_map, stat)).otherwise(F.lit("value")))
    name = F.when(summary, F.regexp_extract("bare", "(?s)^(.+)\\.[^.]+$", 1)).otherwise(F.col("bare"))
    if prefix:
        name = F.concat(F.lit(prefix + "."), name)
    entries = F.transform(
        F.split("raw_tags", ","), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.element_at(F.split(t, "="), 2).alias("value"))
    )
    tags = F.coalesce(F.when(F.length("raw_tags") > 0, entries), F.array().cast("array<struct<key:string,value:string>>"))
    clean = sanitize(F.col("source"))
    has_source = F.exists(tags, lambda t: t["key"] == "source")
    tags = F.when((F.length(clean) > 0) & ~has_source, F.concat(tags, F.array(F.struct(F.lit("source").alias("key"), clean.alias("value"))))).otherwise(tags)
    return x.select(sanitize(name).alias("name"), clean.alias("source"), F.array_sort(tags).alias("tags"), "field", "value", "time", "seq")


def _plain(regex: str) -> str:
    """The pattern with its groups made non-capturing."""
    out, i, in_class = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append("(?:" if c == "(" and not in_class and regex[i + 1 : i + 2] != "?" else c)
        i += 1
    return "".join(out)


def measurements(parsed: DataFrame) -> DataFrame:
    """(name, source, tags, time, value, sum, count, stddev_m2, min, max): one record per name, source and tag set."""
    order = F.col("seq")
    fields = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, order)).alias(f) for f in FIELDS]
    return parsed.groupBy("name", "source", "tags").agg(F.min_by("time", order).alias("time"), *fields)


def legacy_gauges(parsed: DataFrame) -> DataFrame:
    """The same without tags, name and source cut to 255 characters."""
    cut = parsed.select(F.substring("name", 1, NAME_LIMIT).alias("name"), F.substring("source", 1, NAME_LIMIT).alias("source"), F.lit(None).cast("string").alias("tags"), "field", "value", "time", "seq")
    return measurements(cut).drop("tags").withColumnRenamed("time", "measure_time")


def payloads(found: DataFrame, host: str | None = None, tags: dict[str, str] | None = None, size: int = 500) -> DataFrame:
    """(payload, n): {"measurements": [...], "tags": {...}} in chunks; host joins the global tags."""
    every = dict(tags or {}) | ({"host": host} if host else {})
    body = F.to_json(F.struct("name", F.map_from_entries("tags").alias("tags"), "time", *FIELDS))

    def build(rows: list[tuple]) -> str:
        return '{"measurements": [' + ", ".join(r[0] for r in rows) + '], "tags": ' + json.dumps(every) + "}"

    return _chunked(found.select(body.alias("body")), ["body"], size, build, "string")
