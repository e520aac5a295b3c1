"""Queries over the sinks: records shaped for back ends, tagged measurements, merged state; with their SQL.

The records are one per message name, its value the number of its messages, and the gauges and timers of events.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.config import EngineConfig
from meterloom.operators import emit
from meterloom.plans.metrics import events_as
from meterloom.sinks import measurements as ms
from meterloom.sinks import payloads, state_table
from meterloom.sources.tables import table

STAMP = 1700000000
#: Percentiles that the records hold.
PERCENTILES = (50, 95, 99)
CUT = 1646700000


def _key_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per message name that a gauge record can hold, with a whole number as its value."""
    names = table(spark, d, "ascii_parser").where("name is not null and not contains(name, '|') and trim(name) <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("gauges."), "name", F.lit("|"), F.col("n").cast("string"), F.lit(f"|{STAMP}"))
    return payloads.records(names.select(line.alias("line")))


def sink_records(spark: SparkSession, d: str) -> DataFrame:
    flushed = emit.flush(events_as(spark, d, "g"), EngineConfig(), F.lit(STAMP))
    return payloads.records(emit.text_records(flushed))


def sink_graphite_normalize(spark: SparkSession, d: str) -> DataFrame:
    return payloads.graphite_lines(_key_records(spark, d), "app.").select("line")


def sink_graphite_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The records in the line chunks and in the pickled chunks, opened again."""
    lines = payloads.graphite_lines(_key_records(spark, d))
    a = payloads.graphite_line_chunks(lines, 500).select(F.lit("lines").alias("kind"), F.explode(F.split("payload", "\n")).alias("line")).where("line <> ''")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = pickle.loads(data[4:]) if struct.unpack("!L", data[:4])[0] == len(data) - 4 else []
                yield pa.RecordBatch.from_arrays([pa.array([f"{k} {v} {t}" for k, (t, v) in rows], pa.string())], names=["line"])

    b = payloads.graphite_pickle_chunks(lines, 500).select("payload").mapInArrow(opened, "line string")
    return a.unionByName(b.select(F.lit("pickle").alias("kind"), "line"))


def sink_influx_line(spark: SparkSession, d: str) -> DataFrame:
    return payloads.influx_lines(_key_records(spark, d), "app").select("line")


def sink_influx_json(spark: SparkSession, d: str) -> DataFrame:
    return payloads.influx_series(_key_records(spark, d)).select("name", "value", "time")


def _identifier_parts() -> tuple[Column, Column]:
    """Whether a record is of an identifier name, and its dotted parts."""
    return F.col("key").rlike("^gauges\\.uniq\\.[^. :=]+\\.[^. :=]+\\.[^. :=]+$"), F.split("key", "\\.")


def sink_opentsdb_tags(spark: SparkSession, d: str) -> DataFrame:
    """All records; the site and platform of identifier names are dotted tags."""
    shaped, p = _identifier_parts()
    tagged = F.concat_ws(".", p[0], p[1], F.lit("_t_site"), p[2], F.lit("_t_platform"), p[3], p[4])
    return payloads.opentsdb_puts(_key_records(spark, d).withColumn("key", F.when(shaped, tagged).otherwise(F.col("key")))).select("name", "tags", "line")


def sink_cloudwatch_dims(spark: SparkSession, d: str) -> DataFrame:
    """All records, in one name space; the site and platform of identifier names are dimensions."""
    shaped, p = _identifier_parts()
    tagged = F.concat(F.lit("app:"), p[4], F.lit(":site="), p[2], F.lit(":platform="), p[3])
    x = payloads.cloudwatch_metrics(_key_records(spark, d).withColumn("key", F.when(shaped, tagged).otherwise(F.concat(F.lit("app:"), "key"))))
    said = "array<struct<MetricName:string,Value:double,Timestamp:bigint,Dimensions:array<struct<Name:string,Value:string>>>>"
    m = x.select("namespace", F.from_json("json", said)[0].alias("m"))
    dims = F.array_join(F.transform("m.Dimensions", lambda e: F.concat(e["Name"], F.lit("="), e["Value"])), ",")
    return m.select("namespace", F.col("m.MetricName").alias("name"), dims.alias("dimensions"), F.col("m.Value").cast("bigint").alias("value"), F.col("m.Timestamp").alias("ts"))


def sink_http_json(spark: SparkSession, d: str) -> DataFrame:
    """Payloads opened again: one row per record."""
    kind = "struct<metrics:array<struct<key:string,value:string,timestamp:string>>>"
    x = payloads.http_json(_key_records(spark, d), 500)
    return x.select(F.explode(F.from_json("payload", kind)["metrics"]).alias("m")).select("m.*")


def sink_ganglia_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ascii_parser").select("seq", payloads.metric_type(F.col("value")).alias("kind"))


def sink_ganglia_packets(spark: SparkSession, d: str) -> DataFrame:
    x = payloads.ganglia(_key_records(spark, d))
    return x.select("key", "kind", F.hex("meta").alias("meta"), F.hex("data").alias("data"))


def _timer_records(spark: SparkSession, d: str) -> DataFrame:
    flushed = emit.flush(events_as(spark, d, "ms"), EngineConfig(quantiles=(0.5,), quantile_accuracy=1_000_000), F.lit(STAMP))
    tagged = flushed.withColumn("key", F.concat(F.lit("timers."), "name", F.lit("#site=north,env=prod"), F.lit("."), "stat"))
    return tagged.select("key", F.col("value").cast("string").alias("value"), F.col("ts").cast("string").alias("ts"), F.col("rank").cast("bigint").alias("seq"))


def sink_measurements(spark: SparkSession, d: str) -> DataFrame:
    """Timer statistics folded into summaries; percentiles and rates stay measurements of their own."""
    x = ms.measurements(ms.parse_names(_timer_records(spark, d), floor_seconds=60))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",")
    return x.select("name", tags.alias("tags"), "time", *_rounded())


def _rounded(of: str = "") -> list[Column]:
    return [F.round(of + c, 3).alias(c) for c in ("value", "sum", "count", "stddev_m2", "min", "max")]


def sink_measurement_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The measurements in the payloads, opened again, with the host that joined the global tags."""
    x = ms.payloads(ms.measurements(ms.parse_names(_timer_records(spark, d), floor_seconds=60)), host="node-1", size=4)
    one = "name:string,tags:map<string,string>,time:bigint,value:double,sum:double,count:double,stddev_m2:double,min:double,max:double"
    x = x.select(F.from_json("payload", f"struct<measurements:array<struct<{one}>>,tags:map<string,string>>").alias("p"))
    x = x.select("p.tags", F.explode("p.measurements").alias("m"))
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("m.tags"), lambda t: F.concat(t["key"], F.lit("="), t["value"]))), ",")
    return x.select(F.col("tags")["host"].alias("host"), "m.name", tags.alias("tags"), "m.time", *_rounded("m."))


LONG = "long-" * 47
SOURCE = r"\.([a-z]+[0-9]*)\."


def sink_sources(spark: SparkSession, d: str) -> DataFrame:
    """Names of all records with the part a pattern finds taken out as their source, prefixed."""
    x = ms.parse_names(_key_records(spark, d), source_regex=SOURCE, source_prefix="plant", prefix="all")
    return x.select("name", "source", F.col("value").cast("bigint").alias("value"))


def sink_legacy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made longer than old interfaces take, cut."""
    recs = _key_records(spark, d).withColumn("key", F.concat(F.lit("gauges." + LONG), F.substring("key", 8, 1 << 20)))
    x = ms.legacy_gauges(ms.parse_names(recs, source="s" * 300))
    return x.select("name", F.length("source").alias("source_length"))


def _binary_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "binary_out_prefix").where("timestamp is not null and val is not null and not isnan(val)")
    s = table(spark, d, "binary_sink").where("key is not null").select("rec_id", "key")
    return p.join(s, "rec_id").select(F.col("rec_id").alias("seq"), F.col("timestamp").alias("ts"), "type", "value_type", "key", F.col("val").alias("value"))


def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """The state after the records up to a time, merged with the state of the later ones."""
    rows = _binary_rows(spark, d)
    old, new = (state_table.collect_state(rows.where(c)) for c in (f"ts < {CUT}", f"ts >= {CUT}"))
    x = state_table.merge_state(old, new)
    added = [F.round(c, 6).alias(c) for c in ("sum", "count", "sumsqrt")]
    shares = [F.try_element_at("percentiles", F.lit(str(p))).alias(f"p{p}") for p in PERCENTILES]
    return x.select("key", "ts", "type", "kv", *added, "mean", "stddev", "min", "max", *shares, F.size("percentiles").alias("n_percentiles"))


def state_forms(spark: SparkSession, d: str) -> DataFrame:
    """The state of all records, written as YAML lines and as Marshal payloads and read again."""
    state = state_table.collect_state(_binary_rows(spark, d))
    a = state_table.read_yaml_lines(state_table.yaml_lines(state)).withColumn("form", F.lit("yaml"))
    b = state_table.read_marshal(state_table.marshal_payloads(state, 100)).withColumn("form", F.lit("marshal"))
    shares = [F.try_element_at("percentiles", F.lit(str(p))).alias(f"p{p}") for p in PERCENTILES]
    return a.unionByName(b).select("form", "key", "ts", "type", "kv", "sum", "sumsqrt", "mean", "count", "stddev", "min", "max", *shares, F.size("percentiles").alias("n_percentiles"))


def binary_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Decoded binary records per type and statistic."""
    return _binary_rows(spark, d).groupBy("type", "value_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.max("ts").alias("last_ts"))


QUERIES = {
    f.__name__: f
    for f in (
        sink_records, sink_graphite_normalize, sink_graphite_chunks, sink_influx_line, sink_influx_json, sink_opentsdb_tags, sink_cloudwatch_dims, sink_http_json,
        sink_ganglia_types, sink_ganglia_packets, sink_sources, sink_legacy_names, sink_measurements, sink_measurement_payloads, json_merge, state_forms, binary_key_totals,
    )
}

_NAMES = r"names AS (SELECT 'gauges.' || name AS key, count(*) AS n FROM ascii_parser WHERE name IS NOT NULL AND strpos(name, '|') = 0 AND trim(name) <> '' GROUP BY name)"
_SHAPED = "regexp_full_match(key, 'gauges[.]uniq[.][^. :=]+[.][^. :=]+[.][^. :=]+')"
_PARTS = f"p AS (SELECT key, string_split(key, '.') AS p, n, {_SHAPED} AS shaped FROM names)"


def _xdr(x: str) -> str:
    size = f"octet_length(encode({x}))"
    return f"lpad(to_hex({size}), 8, '0') || hex(encode({x})) || repeat('00', (4 - {size} % 4) % 4)"


_WORD = "(SELECT event_type AS name, {} AS v FROM events GROUP BY 1)"
_MEAS = """SELECT event_type{0} AS name, 'env=prod,site=north' AS tags, CAST({2} AS BIGINT) AS time, {1} FROM events GROUP BY event_type"""
_NONE = "CAST(NULL AS DOUBLE)"


def _single(suffix: str, expr: str) -> str:
    cols = f"round(CAST({expr} AS DOUBLE), 3) AS value, " + ", ".join(f"{_NONE} AS {c}" for c in ("sum", "count", "stddev_m2", "min", "max"))
    return _MEAS.format(f" || '.{suffix}'", cols, STAMP - STAMP % 60)


_MEASURED = " UNION ALL ".join(
    [
        _MEAS.format("", f"{_NONE} AS value, round(sum(value), 3) AS sum, CAST(count(*) AS DOUBLE) AS count, round(stddev_samp(value), 3) AS stddev_m2, min(value) AS min, max(value) AS max", STAMP - STAMP % 60),
        _single("median", "quantile_disc(value, 0.5)"),
        _single("p50", "quantile_disc(value, 0.5)"),
        _single("rate", "sum(value) / 10.0"),
        _single("sample_rate", "count(*) / 10.0"),
    ]
)
_STATE_STATS = {"kv": 0, "sum": 1, "sumsqrt": 2, "mean": 3, "count": 4, "stddev": 5, "min": 6, "max": 7} | {f"p{p}": 128 + p for p in PERCENTILES}
_STATE = """{0} AS (SELECT key, max(ts) AS ts, arg_max(CASE type WHEN 1 THEN 'kv' WHEN 2 THEN 'counter' WHEN 3 THEN 'timer' WHEN 4 THEN 'set' WHEN 5 THEN 'gauge' END, o) AS type,
  CAST(count(DISTINCT value_type) FILTER (value_type BETWEEN 128 AND 255) AS INTEGER) AS n_percentiles, """ + ", ".join(f"arg_max(value, o) FILTER (value_type = {c}) AS {n}" for n, c in _STATE_STATS.items()) + """
  FROM rows WHERE ts {1} GROUP BY key)"""
_ROWS = """rows AS (SELECT p.rec_id, p.timestamp AS ts, CAST(p.timestamp AS HUGEINT) * 10000000000 + p.rec_id AS o, p.type, p.value_type, s.key, p.val AS value
  FROM binary_out_prefix p JOIN binary_sink s USING (rec_id) WHERE p.timestamp IS NOT NULL AND p.val IS NOT NULL AND NOT isnan(p.val) AND s.key IS NOT NULL)"""


def _added(c: str) -> str:
    return f"CASE WHEN n.key IS NULL THEN o.{c} WHEN n.type = 'counter' AND o.type = 'counter' AND (o.{c} IS NOT NULL OR n.{c} IS NOT NULL) THEN coalesce(o.{c}, 0) + coalesce(n.{c}, 0) ELSE n.{c} END"


def _extreme(c: str, f: str) -> str:
    return f"CASE WHEN n.key IS NULL THEN o.{c} WHEN n.type = 'counter' AND o.type = 'counter' THEN {f}(o.{c}, n.{c}) ELSE n.{c} END"


ORACLE_SQL = {
    "sink_records": f"SELECT 'gauges.' || event_type AS key, format('{{:.6f}}', arg_max(value, event_id)) AS value, '{STAMP}' AS ts FROM events GROUP BY event_type",
    "sink_graphite_normalize": f"""WITH {_NAMES} SELECT 'app.' || regexp_replace(regexp_replace(regexp_replace(key, '\\s+', '_', 'g'), '/+', '-', 'g'), '[^a-zA-Z_0-9.-]', '', 'g')
        || ' ' || n || ' {STAMP}' AS line FROM names""",
    "sink_graphite_chunks": f"""WITH {_NAMES} SELECT k AS kind, regexp_replace(regexp_replace(regexp_replace(key, '\\s+', '_', 'g'), '/+', '-', 'g'), '[^a-zA-Z_0-9.-]', '', 'g')
        || ' ' || n || ' {STAMP}' AS line FROM names, (VALUES ('lines'), ('pickle')) v(k)""",
    "sink_influx_line": f"WITH {_NAMES} SELECT regexp_replace('app.' || key, '[^a-zA-Z0-9.,=_-]+', '.', 'g') || ' value=' || n || ' {STAMP}' AS line FROM names",
    "sink_influx_json": f"WITH {_NAMES} SELECT regexp_replace(key, '[^a-zA-Z0-9._-]+', '.', 'g') AS name, CAST(n AS DOUBLE) AS value, CAST({STAMP} AS BIGINT) AS time FROM names",
    "sink_opentsdb_tags": f"""WITH {_NAMES}, {_PARTS}, x AS (
          SELECT n, CASE WHEN shaped THEN p[1] || '.' || p[2] || '.' || p[5] ELSE key END AS name, CASE WHEN shaped THEN 'site=' || p[3] || ' platform=' || p[4] ELSE '' END AS tags FROM p)
        SELECT name, tags, regexp_replace('put ' || name || ' {STAMP} ' || n || ' ' || tags || ' source=statsd', '\\s+', ' ', 'g') AS line FROM x""",
    "sink_cloudwatch_dims": f"""WITH {_NAMES}, {_PARTS}, x AS (
          SELECT n, string_split(CASE WHEN shaped THEN 'app:' || p[5] || ':site=' || p[3] || ':platform=' || p[4] ELSE 'app:' || key END, ':') AS c FROM p)
        SELECT c[1] AS namespace, c[2] AS name, array_to_string([split_part(v, '=', 1) || '=' || split_part(v || '=', '=', 2) for v in c[3:] if v <> ''], ',') AS dimensions,
               n AS value, CAST({STAMP} AS BIGINT) AS ts FROM x WHERE c[2] <> ''""",
    "sink_http_json": f"WITH {_NAMES} SELECT key, CAST(n AS VARCHAR) AS value, '{STAMP}' AS timestamp FROM names",
    "sink_ganglia_types": """SELECT seq, CASE WHEN value IS NULL OR value = '' THEN NULL WHEN NOT regexp_full_match(value, '\\s*[+-]?[0-9]+\\s*') THEN 'string'
          WHEN n < -2147483648 THEN NULL WHEN n < -32768 THEN 'int32' WHEN n < 0 THEN 'int16' WHEN n < 65536 THEN 'uint16' WHEN n < 4294967296 THEN 'uint32' END AS kind
        FROM (SELECT seq, value, TRY_CAST(trim(value) AS HUGEINT) AS n FROM ascii_parser)""",
    "sink_ganglia_packets": f"""WITH {_NAMES}, x AS (SELECT key, CASE WHEN n < 65536 THEN 'uint16' ELSE 'uint32' END AS kind, CAST(n AS VARCHAR) AS v FROM names)
        SELECT key, kind, '00000080' || {_xdr("'test'")} || {_xdr("key")} || '00000000' || {_xdr("kind")} || {_xdr("key")} || '00000000' || '00000003' || '0000003C' || '00000000' || '00000000' AS meta,
               '00000085' || {_xdr("'test'")} || {_xdr("key")} || '00000000' || {_xdr("'%s'")} || {_xdr("v")} AS data FROM x""",
    "sink_sources": f"""WITH {_NAMES}, x AS (SELECT key[8:] AS name, n, regexp_matches(key[8:], '{SOURCE}') AS hit, regexp_extract(key[8:], '{SOURCE}', 1) AS src FROM names WHERE length(key) > 7)
        SELECT regexp_replace('all.' || CASE WHEN hit THEN regexp_replace(split_part(name, '#', 1), '{SOURCE}', '') ELSE split_part(name, '#', 1) END, '[^-A-Za-z0-9.:_]', '_', 'g') AS name,
               CASE WHEN hit THEN 'plant.' || src ELSE 'plant' END AS source, n AS value FROM x""",
    "sink_legacy_names": f"""WITH {_NAMES} SELECT DISTINCT left(regexp_replace('{LONG}' || split_part(key[8:], '#', 1), '[^-A-Za-z0-9.:_]', '_', 'g'), 255) AS name, 255 AS source_length FROM names""",
    "sink_measurements": _MEASURED,
    "sink_measurement_payloads": f"SELECT 'node-1' AS host, * FROM ({_MEASURED})",
    "json_merge": f"""WITH {_ROWS}, {_STATE.format('o', f'< {CUT}')}, {_STATE.format('n', f'>= {CUT}')}
        SELECT coalesce(n.key, o.key) AS key, coalesce(n.ts, o.ts) AS ts, CASE WHEN n.key IS NULL THEN o.type ELSE n.type END AS type,
          {', '.join(f'CASE WHEN n.key IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in ('kv', 'mean', 'stddev', 'p50', 'p95', 'p99', 'n_percentiles'))},
          round({_added('sum')}, 6) AS sum, round({_added('count')}, 6) AS count, round({_added('sumsqrt')}, 6) AS sumsqrt,
          {_extreme('min', 'least')} AS min, {_extreme('max', 'greatest')} AS max
        FROM o FULL OUTER JOIN n ON o.key = n.key""",
    "state_forms": f"WITH {_ROWS}, {_STATE.format('state', 'IS NOT NULL')} SELECT * FROM (VALUES ('yaml'), ('marshal')) f(form), state",
    "binary_key_totals": f"WITH {_ROWS} SELECT type, value_type, count(*) AS n, count(DISTINCT key) AS n_keys, max(ts) AS last_ts FROM rows GROUP BY ALL",
}
