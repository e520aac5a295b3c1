"""Binary messages and binary flushed records: framing is sequential, so each chunk of bytes is one row.

Messages: `<BBHd` magic 0xaa, type, key length with NUL, value, key; sets `<BBHH` with a member instead of the value.
A bad magic byte, type or missing NUL ends a chunk: what came before it stands. A newline between messages is skipped.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.protocol import UNUSABLE, parse_lines

MAGIC = 0xAA
#: Type codes of messages; fixed values of the format.
MESSAGE_TYPES = {1: "kv", 2: "c", 3: "ms", 4: "s", 5: "g", 6: "gd"}
NUMBER = struct.Struct("<BBHd")
SET = struct.Struct("<BBHH")
RECORD = struct.Struct("<QBBHd")
SAMPLE_SCHEMA = "chunk_no bigint, pos int, type string, name string, value double, member string, sample_rate double"


def frame(data: bytes) -> tuple[list[tuple[str, int, int, int, float | None]], int, bool]:
    """(messages, bytes they take, damaged): messages as type, start of the key, its length, the member's, value.

    What follows the bytes taken is an unfinished message, or damage.
    """
    out: list[tuple[str, int, int, int, float | None]] = []
    at, end = 0, len(data)
    while at < end:
        if data[at] == 0x0A:
            at += 1
            continue
        if data[at] != MAGIC or (at + 1 < end and data[at + 1] not in MESSAGE_TYPES):
            return out, at, True
        if at + SET.size > end:
            break
        kind = MESSAGE_TYPES[data[at + 1]]
        head = SET if kind == "s" else NUMBER
        if at + head.size > end:
            break
        _, _, n, last = head.unpack_from(data, at)
        body = at + head.size
        m, value = (last, None) if kind == "s" else (0, last)
        if not n or (kind == "s" and not m):
            return out, at, True
        if body + n + m > end:
            break
        if data[body + n - 1] or (m and data[body + n + m - 1]):
            return out, at, True
        out.append((kind, body, n, m, value))
        at = body + n + m
    return out, at, False


def read_messages(data: bytes) -> list[tuple[str, str, float | None, str | None]]:
    """(type, name, value, member) of one chunk, up to the first damage or an unfinished message."""

    def text(a: int, n: int) -> str:
        return data[a : a + n].split(b"\0", 1)[0].decode("utf-8", "replace")

    return [(kind, text(at, n), value, text(at + n, m) if m else None) for kind, at, n, m, value in frame(data)[0]]


def write_number(kind: int, name: str, value: float) -> bytes:
    key = name.encode() + b"\0"
    return NUMBER.pack(MAGIC, kind, len(key), value) + key


def write_set(name: str, member: str) -> bytes:
    key, m = name.encode() + b"\0", member.encode() + b"\0"
    return SET.pack(MAGIC, 4, len(key), len(m)) + key + m


def parse_chunks(chunks: DataFrame, data: str = "data", chunk_no: str = "chunk_no", counted: bool = False) -> DataFrame:
    """Samples of binary chunks; NaN timers are dropped (or only counted), other NaN and infinite values pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for no, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for pos, (kind, name, value, member) in enumerate(read_messages(d or b"")):
                    usable = not (kind == "ms" and math.isnan(value))
                    if usable or counted:
                        rows.append((no, pos, kind if usable else UNUSABLE, name, value, member, 1.0))
            names = [x.split()[0] for x in SAMPLE_SCHEMA.split(", ")]
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return chunks.select(F.col(chunk_no).cast("bigint").alias("chunk_no"), F.col(data).alias("data")).mapInArrow(run, SAMPLE_SCHEMA)


def sequence(chunk_no: Column, pos: Column) -> Column:
    """One order over chunks and places in them, of any number."""
    return chunk_no.cast("decimal(20,0)") * F.lit(1 << 31) + pos


def parse_mixed(chunks: DataFrame, data: str = "data", chunk_no: str = "chunk_no", counted: bool = False) -> DataFrame:
    """(seq and a sample's columns) of chunks of either protocol: the first byte of a chunk decides for all of it.

    Bytes of a text chunk that are no UTF-8 are replaced.
    """
    binary = F.substring(F.col(data), 1, 1) == F.lit(bytearray([MAGIC]))
    columns = ("seq", "type", "name", "value", "member", "sample_rate")
    packed = parse_chunks(chunks.where(binary), data, chunk_no, counted).withColumn("seq", sequence(F.col("chunk_no"), F.col("pos")))
    text = F.make_valid_utf8(F.col(data).cast("string"))
    lines = chunks.where(~binary).select(F.col(chunk_no).alias("chunk_no"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    read = parse_lines(lines.where("line <> ''").select(sequence(F.col("chunk_no"), F.col("pos")).alias("seq"), "line"), counted=counted)
    return packed.select(*columns).unionByName(read.select(*columns))


def read_records(data: bytes) -> list[tuple[int, int, int, str, float, int | None]]:
    """(ts, type, value_type, key, value, hist_count) of a stream of flushed binary records."""
    out = []
    at = 0
    while at + RECORD.size <= len(data):
        ts, kind, code, n, value = RECORD.unpack_from(data, at)
        at += RECORD.size
        key = data[at : at + n]
        if len(key) < n:
            break
        at += n
        count = None
        if 8 <= code <= 10:
            if at + 4 > len(data):
                break
            (count,) = struct.unpack_from("<I", data, at)
            at += 4
        out.append((ts, kind, code, key.rstrip(b"\0").decode("utf-8", "replace"), value, count))
    return out


def parse_records(chunks: DataFrame, data: str = "record") -> DataFrame:
    """Flushed records back as columns: the inverse of `emit.binary_records`."""
    schema = "ts bigint, type int, value_type int, key string, value double, hist_count bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for d in b.column(0).to_pylist() for r in read_records(d or b"")]
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return chunks.select(data).mapInArrow(run, schema)
