"""Flushed text records shaped for monitoring back ends: DataFrame in, payload rows out; transport is a callable.

Records are the columns key, value, ts as texts (see `records`). Payloads that hold many records are built per partition
in chunks, so that no task or driver holds a whole flush.
"""

from __future__ import annotations

import json
import pickle
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(lines: DataFrame, line: str = "line") -> DataFrame:
    """(key, value, ts) of the lines with exactly two bars; other lines vanish."""
    p = F.split(F.col(line), "\\|")
    x = lines.select(F.explode(F.filter(F.array(p), lambda a: F.size(a) == 3)).alias("p"))
    return x.select(F.col("p")[0].alias("key"), F.col("p")[1].alias("value"), F.col("p")[2].alias("ts"))


def _chunked(df: DataFrame, columns: list[str], size: int, build: Callable[[list[tuple]], object], kind: str) -> DataFrame:
    out_type = pa.string() if kind == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def payload(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([build(rows)], out_type), pa.array([len(rows)], pa.int64())], names=["payload", "n"])

        for b in batches:
            held += zip(*[b.column(i).to_pylist() for i in range(b.num_columns)])
            while len(held) >= size:
                yield payload(held[:size])
                held = held[size:]
        if held:
            yield payload(held)

    return df.select(*columns).mapInArrow(run, f"payload {kind}, n bigint")


# ---- plain-text stores


def normal_key(key: Column, prefix: str = "") -> Column:
    """Whitespace runs as _, slash runs as -, other characters but letters, digits, _, - and . dropped."""
    key = F.regexp_replace(key, "\\s+", "_")
    key = F.regexp_replace(key, "/+", "-")
    return F.concat(F.lit(prefix), F.regexp_replace(key, "[^a-zA-Z_0-9.-]", ""))


def graphite_lines(recs: DataFrame, prefix: str = "", normalize: bool = True) -> DataFrame:
    """(key, value, ts, line): `key value ts`."""
    key = normal_key(F.col("key"), prefix) if normalize else F.concat(F.lit(prefix), "key")
    x = recs.select(key.alias("key"), "value", "ts")
    return x.select("*", F.concat_ws(" ", "key", "value", "ts").alias("line"))


def graphite_line_chunks(lines: DataFrame, size: int = 5000) -> DataFrame:
    """(payload, n): lines, newline-ended, in chunks."""
    return _chunked(lines, ["line"], size, lambda rows: "".join(r[0] + "\n" for r in rows), "string")


def _pickled(rows: list[tuple]) -> bytes:
    data = pickle.dumps([(k, (t, v)) for k, v, t in rows], protocol=2)
    return struct.pack("!L", len(data)) + data


def graphite_pickle_chunks(lines: DataFrame, size: int = 5000) -> DataFrame:
    """(payload, n): length-headed pickles of [(key, (ts, value))]."""
    return _chunked(lines, ["key", "value", "ts"], size, _pickled, "binary")


def influx_lines(recs: DataFrame, prefix: str = "") -> DataFrame:
    """(key, value, ts, line): line protocol; runs of other characters in the key become a point."""
    full = F.concat(F.lit(prefix + "."), "key") if prefix else F.col("key")
    x = recs.select(F.regexp_replace(full, "[^a-zA-Z0-9.,=_-]+", ".").alias("key"), "value", "ts")
    return x.select("*", F.concat(F.col("key"), F.lit(" value="), F.col("value"), F.lit(" "), F.col("ts")).alias("line"))


def influx_series(recs: DataFrame, prefix: str = "") -> DataFrame:
    """(name, value, time, json): one series per record, for the older JSON interface."""
    full = F.concat(F.lit(prefix + "."), "key") if prefix else F.col("key")
    x = recs.select(F.regexp_replace(full, "[^a-zA-Z0-9._-]+", ".").alias("name"), F.col("value").cast("double").alias("value"), F.col("ts").cast("bigint").alias("time"))
    point = F.struct(F.col("name"), F.array(F.lit("value"), F.lit("time")).alias("columns"), F.array(F.array("value", F.col("time").cast("double"))).alias("points"))
    return x.select("*", F.to_json(point).alias("json"))


def influx_uses_lines(version: str) -> bool:
    """From version 0.9 on the line protocol is used."""
    parts = [int(p) for p in version.split(".")]
    while parts and parts[-1] == 0:
        parts.pop()
    return parts >= [0, 9]


def influx(recs: DataFrame, version: str = "0.9", prefix: str = "") -> DataFrame:
    return influx_lines(recs, prefix) if influx_uses_lines(version) else influx_series(recs, prefix)


# ---- tagged stores


def dotted_tags(key: Column, tag_prefix: str) -> Column:
    """["name=value", ...] of a dotted key in which a part with the prefix names a tag and the next part is its value."""
    n = len(tag_prefix)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("tags"))

    def step(acc: Column, part: Column) -> Column:
        named = part.startswith(tag_prefix)
        name = F.element_at(F.split(F.substring(part, n + 1, 1 << 30), "\\Q" + tag_prefix + "\\E"), 1)
        push = ~named & (acc["open"] != "")
        return F.struct(
            F.when(named, name).when(push, F.lit("")).otherwise(acc["open"]).alias("open"),
            F.when(push, F.concat(acc["tags"], F.array(F.concat(acc["open"], F.lit("="), part)))).otherwise(acc["tags"]).alias("tags"),
        )

    return F.aggregate(F.split(key, "\\."), start, step, lambda a: a["tags"])


def without_dotted_tags(key: Column, tag_prefix: str) -> Column:
    """The key without tag names and the parts after them."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, part: Column) -> Column:
        named = ~acc["skip"] & part.startswith(tag_prefix)
        keep = ~acc["skip"] & ~named
        return F.struct(named.alias("skip"), F.when(keep, F.concat(acc["kept"], F.array(part))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.split(key, "\\."), start, step, lambda a: F.array_join(a["kept"], "."))


def opentsdb_puts(recs: DataFrame, tag_prefix: str = "_t_") -> DataFrame:
    """(name, value, ts, tags, line): `put name ts value tags source=statsd`, single blanks throughout."""
    key = F.col("key")
    x = recs.select(without_dotted_tags(key, tag_prefix).alias("name"), "value", "ts", F.array_join(dotted_tags(key, tag_prefix), " ").alias("tags"))
    line = F.concat_ws(" ", F.lit("put"), "name", "ts", "value", "tags", F.lit("source=statsd"))
    return x.select("*", F.regexp_replace(line, "\\s+", " ").alias("line"))


def cloudwatch_metrics(recs: DataFrame) -> DataFrame:
    """(namespace, name, value, ts, dimensions, json) of keys `namespace:metric[:name=value]*`; incomplete ones vanish."""
    p = F.split("key", ":")
    dims = F.transform(
        F.filter(F.slice(p, 3, 1 << 20), lambda d: d != ""),
        lambda d: F.struct(F.element_at(F.split(d, "="), 1).alias("Name"), F.get(F.split(F.concat(d, F.lit("=")), "="), F.lit(1)).alias("Value")),
    )
    x = recs.select(p[0].alias("namespace"), F.get(p, F.lit(1)).alias("name"), "value", "ts", dims.alias("dimensions"))
    x = x.where((F.length("namespace") > 0) & (F.length("name") > 0) & (F.length("ts") > 0))
    body = F.struct(
        F.col("name").alias("MetricName"), F.col("value").cast("double").alias("Value"), F.col("ts").cast("bigint").alias("Timestamp"), F.col("dimensions").alias("Dimensions")
    )
    return x.select("*", F.to_json(F.array(body)).alias("json"))


def http_json(recs: DataFrame, size: int = 50_000) -> DataFrame:
    """(payload, n): {"metrics": [{key, value, timestamp}]}, all texts, at most `size` records each."""

    def build(rows: list[tuple]) -> str:
        return json.dumps({"metrics": [{"key": k, "value": v, "timestamp": t} for k, v, t in rows]})

    return _chunked(recs, ["key", "value", "ts"], size, build, "string")


# ---- Ganglia: two XDR packets per metric


def metric_type(value: Column) -> Column:
    """int16, int32, uint16 or uint32 for whole numbers, string for other texts, null for empty or out-of-range ones."""
    whole = value.rlike("^\\s*[+-]?[0-9]+\\s*$")
    n = F.trim(value).try_cast("decimal(38,0)")
    kind = (
        F.when(n < -(1 << 31), F.lit(None).cast("string"))
        .when(n < -(1 << 15), "int32")
        .when(n < 0, "int16")
        .when(n < 1 << 16, "uint16")
        .when(n < 1 << 32, "uint32")
    )
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(whole, kind).otherwise(F.lit("string"))


#: Slopes by code; fixed values of the packet format.
SLOPES = {"zero": 0, "positive": 1, "negative": 2, "both": 3, "unspecified": 4}
#: Kinds of packets; fixed values of the format, as is the order of their fields below.
_META, _DATA = 128, 133


def _xdr(text: str) -> bytes:
    data = text.encode()
    return struct.pack(">I", len(data)) + data + b"\0" * (-len(data) % 4)


def ganglia_packets(name: str, value: str, kind: str, units: str = "", slope: str = "both", tmax: int = 60, dmax: int = 0, group: str = "", spoof: str = "", host: str = "test") -> tuple[bytes, bytes]:
    """Meta and data packet of one metric."""
    if not name:
        raise ValueError("a metric needs a name")
    whose = _xdr(spoof or host)
    spoofed = struct.pack(">i", bool(spoof))
    meta = struct.pack(">i", _META) + whose + _xdr(name) + spoofed + _xdr(kind) + _xdr(name) + _xdr(units)
    meta += struct.pack(">iII", SLOPES[slope], tmax, dmax)
    meta += struct.pack(">i", 1) + _xdr("GROUP") + _xdr(group) if group else struct.pack(">i", 0)
    data = struct.pack(">i", _DATA) + whose + _xdr(name) + spoofed + _xdr("%s") + _xdr(value)
    return meta, data


def ganglia(recs: DataFrame, units: str = "", slope: str = "both", tmax: int = 60, dmax: int = 0, group: str = "", spoof: str = "") -> DataFrame:
    """(key, value, kind, meta, data); values without a type vanish."""
    x = recs.select("key", "value", metric_type(F.col("value")).alias("kind")).where("kind is not null and key <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [ganglia_packets(k, v, t, units, slope, tmax, dmax, group, spoof) for k, v, t in zip(*[c.to_pylist() for c in b.columns])]
            meta, data = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(meta, pa.binary()), pa.array(data, pa.binary())], names=["key", "value", "kind", "meta", "data"])

    return x.mapInArrow(run, "key string, value string, kind string, meta binary, data binary")


# ---- transports


def deliver(payloads: DataFrame, column: str, send: Callable[[object], None], attempts: int = 3) -> None:
    """Hand every payload to `send` from the tasks; a payload that fails `attempts` times raises."""

    def run(rows) -> None:
        for r in rows:
            for left in range(attempts - 1, -1, -1):
                try:
                    send(r[column])
                    break
                except OSError:
                    if not left:
                        raise

    payloads.select(column).foreachPartition(run)


def tcp_sender(host: str, port: int, timeout: float = 2.0) -> Callable[[object], None]:
    def send(payload: object) -> None:
        import socket

        with socket.create_connection((host, port), timeout) as s:
            s.sendall(payload if isinstance(payload, bytes | bytearray) else str(payload).encode())

    return send


def udp_sender(host: str, port: int) -> Callable[[object], None]:
    def send(payload: object) -> None:
        import socket

        family, kind, proto, _, address = socket.getaddrinfo(host, port, type=socket.SOCK_DGRAM)[0]
        with socket.socket(family, kind, proto) as s:
            s.sendto(bytes(payload), address)

    return send


def http_sender(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[object], None]:
    def send(payload: object) -> None:
        from urllib.request import Request, urlopen

        data = payload if isinstance(payload, bytes | bytearray) else str(payload).encode()
        with urlopen(Request(url, data, headers or {"Content-Type": "application/json"}), timeout=timeout) as r:
            r.read()

    return send
