"""Load the valid rows of dirty input and set the others apart with the reason.

Rows travel in Arrow batches. A block takes the bulk path: one pass of compiled kernels parses all its fields at once, and
either the whole block is valid or it is not. A block that is not is halved, and so on down to the single record, which
is diagnosed by the strict parser; that alone decides and names the reason. How many records of a stretch have the shape
of a sample is known from running sums after one pass of the grammar, so that most halves fail without being parsed.
The bulk path is conservative: it may refuse a valid record, it never passes an invalid one. Valid and rejected rows come
out of the same pass.

A valid sample: name neither null nor blank and without ':'; type one of kv, g, c, ms, h, s; value for type s non-empty
and without '|', else a finite decimal number; sample rate absent or, for c, ms and h, a decimal number in (0, 1].
A spool line has exactly five comma-separated fields, the first of ASCII digits only; a quoted field is quoted as a
whole, with quotes inside doubled.

Defined cases: a null line or field is a failure with its own reason (a null sample rate is an absent one); repeated
rows are each judged; an empty table gives none; long values are parsed whole; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("kv", "g", "c", "ms", "h", "s")
RATED = ("c", "ms", "h")
NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_NUMBER = re.compile(NUMBER)
_SEP, _ABSENT = "\x1f", "\x1e~\x1e"
#: One joined record: name, type, value, rate. The name must show a visible ASCII character here; other names go the strict way.
_RECORD = (
    rf"^[^:{_SEP}]*[!-9;-~][^:{_SEP}]*{_SEP}"
    rf"(?:s{_SEP}[^|{_SEP}]+{_SEP}{_ABSENT}|(?:kv|g){_SEP}{NUMBER}{_SEP}{_ABSENT}|(?:c|ms|h){_SEP}{NUMBER}{_SEP}(?:{NUMBER}|{_ABSENT}))$"
)
#: An unquoted field with a line break is left to the strict parser, as the bulk parser would end the line there.
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_LINE = rf'^(?:"[0-9]+"|[0-9]+)(?:,{_FIELD}){{4}}$'

OUT_SCHEMA = "row_id bigint, reason string, name string, type string, number double, member string, rate double"
_OUT = pa.schema(
    [("row_id", pa.int64()), ("reason", pa.string()), ("name", pa.string()), ("type", pa.string()), ("number", pa.float64()), ("member", pa.string()), ("rate", pa.float64())]
)


# ---- strict, row by row


def diagnose(name: str | None, value: str | None, kind: str | None, rate: str | None) -> str | None:
    """The first reason why these fields are no valid sample, or None."""
    if name is None:
        return "name missing"
    if not name.strip():
        return "name blank"
    if ":" in name:
        return "name has a colon"
    if kind not in TYPES:
        return "type unknown"
    if value is None:
        return "value missing"
    if value == "":
        return "value empty"
    if kind == "s":
        if "|" in value:
            return "set member has a bar"
    elif not _NUMBER.fullmatch(value):
        return "value is no number"
    elif abs(float(value)) == float("inf"):
        return "value not finite"
    if rate is not None:
        if kind not in RATED:
            return "rate not allowed for type"
        if not _NUMBER.fullmatch(rate):
            return "rate is no number"
        if not 0 < float(rate) <= 1:
            return "rate out of range"
    return None


def split_line(line: str | None) -> tuple[list[str], str | None]:
    """The fields of one spool line and the reason why it can't be split, or None."""
    if line is None:
        return [], "line missing"
    fields: list[str] = []
    at, end = 0, len(line)
    while True:
        if at < end and line[at] == '"':
            part, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return fields, "quote not closed"
                part.append(line[at:close])
                at = close + 1
                if at < end and line[at] == '"':
                    part.append('"')
                    at += 1
                else:
                    break
            fields.append("".join(part))
            if at < end and line[at] != ",":
                return fields, "text after closing quote"
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            if '"' in line[at:stop]:
                return fields, "quote inside unquoted field"
            fields.append(line[at:stop])
            at = stop
        if at >= end:
            break
        at += 1
    if len(fields) < 5:
        return fields, "too few fields"
    if len(fields) > 5:
        return fields, "too many fields"
    if not re.fullmatch("[0-9]+", fields[0]):
        return fields, "time is not digits"
    return fields, None


def _strict(row_id, name, value, kind, rate) -> tuple:
    why = diagnose(name, value, kind, rate)
    if why:
        return (row_id, why, name, kind, None, None, None)
    return (row_id, None, name, kind, None if kind == "s" else float(value), value if kind == "s" else None, 1.0 if rate is None else float(rate))


def _strict_line(row_id, line) -> tuple:
    fields, why = split_line(line)
    if why:
        return (row_id, why, None, None, None, None, None)
    _, name, value, kind, rate = fields
    return _strict(row_id, name, value, kind, rate or None)


# ---- bulk, block by block


def _joined(name: pa.Array, value: pa.Array, kind: pa.Array, rate: pa.Array) -> pa.Array:
    """One text per record for the grammar; null where a field that must exist is null."""
    return pc.binary_join_element_wise(name, kind, value, pc.fill_null(rate, _ABSENT), _SEP)


def _misshapen(text: pa.Array, grammar: str) -> np.ndarray:
    """Running number of records that the grammar does not match; one entry more than records."""
    fits = pc.fill_null(pc.match_substring_regex(text, grammar), False).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(~fits)]


def _typed(row_id: pa.Array, name: pa.Array, value: pa.Array, kind: pa.Array, rate: pa.Array) -> pa.RecordBatch | None:
    """A block of records of the right shape, typed, or None where a number is out of range."""
    sets = pc.equal(kind, "s").to_numpy(zero_copy_only=False)
    try:
        numbers = pc.cast(value.filter(pa.array(~sets)), pa.float64()).to_numpy(zero_copy_only=False)
        factor = pc.cast(pc.fill_null(rate, "1"), pa.float64())
    except pa.ArrowInvalid:
        return None
    f = factor.to_numpy(zero_copy_only=False)
    if not np.isfinite(numbers).all() or not ((f > 0) & (f <= 1)).all():
        return None
    n = len(row_id)
    spread = np.zeros(n)
    spread[~sets] = numbers
    member = value.take(pa.array(np.arange(n), mask=~sets))
    return pa.RecordBatch.from_arrays([row_id, pa.nulls(n, pa.string()), name, kind, pa.array(spread, mask=sets), member, factor], schema=_OUT)


def bisect(n: int, misshapen: np.ndarray, parse: Callable[[np.ndarray], object], block: int) -> tuple[list, list[int]]:
    """(what `parse` made of the records that pass, the records that fail) of n records, block by block.

    parse(places) gives None where any record fails. Failing blocks are halved down to the record: first by the running sums,
    then, where what has the right shape still fails as a whole, by parsing it again.
    """
    good: list = []
    bad: list[int] = []

    def by_shape(a: int, b: int, fine: list[np.ndarray]) -> None:
        if misshapen[a] == misshapen[b]:
            fine.append(np.arange(a, b))
        elif b - a == 1:
            bad.append(a)
        else:
            half = (a + b) // 2
            by_shape(a, half, fine)
            by_shape(half, b, fine)

    def by_parsing(places: np.ndarray) -> None:
        if not len(places):
            return
        parsed = parse(places)
        if parsed is not None:
            good.append(parsed)
        elif len(places) == 1:
            bad.append(int(places[0]))
        else:
            half = len(places) // 2
            by_parsing(places[:half])
            by_parsing(places[half:])

    for a in range(0, n, block):
        fine: list[np.ndarray] = []
        by_shape(a, min(n, a + block), fine)
        by_parsing(np.concatenate(fine) if fine else np.arange(0))
    return good, bad


def _at(columns: list[pa.Array], places: np.ndarray) -> list[pa.Array]:
    """The records at ascending places; without a copy where none between is left out."""
    first, n = int(places[0]), len(places)
    if int(places[-1]) - first + 1 == n:
        return [c.slice(first, n) for c in columns]
    index = pa.array(places)
    return [c.take(index) for c in columns]


def _rows_of(good: list[pa.RecordBatch], judged: list[tuple]) -> list[pa.RecordBatch]:
    if judged:
        good = [*good, pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*judged), _OUT)], schema=_OUT)]
    return pa.Table.from_batches(good).combine_chunks().to_batches() if good else []


def judge_messages(b: pa.RecordBatch, block: int) -> list[pa.RecordBatch]:
    """Typed rows and diagnosed ones of tokenised messages (row_id, name, value, type, rate)."""
    row_id, name, value, kind, rate = b.columns
    wrong = _misshapen(_joined(name, value, kind, rate), _RECORD)
    good, bad = bisect(b.num_rows, wrong, lambda places: _typed(*_at(b.columns, places)), block)
    return _rows_of(good, [_strict(*(c[i].as_py() for c in b.columns)) for i in bad])


_CSV = ("at", "name", "value", "type", "rate")


def _fields(lines: pa.Array) -> list[pa.Array] | None:
    """The five fields of a block of lines by the bulk reader, or None where it can't tell them apart."""
    one = pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines)
    text = pc.binary_join(one, "\n")[0].as_buffer()
    try:
        t = pacsv.read_csv(
            pa.BufferReader(text),
            read_options=pacsv.ReadOptions(column_names=_CSV, use_threads=False, block_size=max(1 << 20, text.size + 1)),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(_CSV, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if t.num_rows != len(lines):
        return None
    return [t[x].combine_chunks() for x in _CSV[1:]]


def judge_lines(b: pa.RecordBatch, block: int) -> list[pa.RecordBatch]:
    """Typed rows and diagnosed ones of spool lines (row_id, line)."""
    row_id, line = b.columns

    def parse(places: np.ndarray) -> tuple | None:
        fields = _fields(_at([line], places)[0])
        return fields and (places, *fields)

    read, bad = bisect(b.num_rows, _misshapen(line, _LINE), parse, block)
    good: list[pa.RecordBatch] = []
    judged = [_strict_line(row_id[i].as_py(), line[i].as_py()) for i in bad]
    if read:
        at = pa.array(np.concatenate([r[0] for r in read]))
        name, value, kind, rate = (pa.chunked_array(c).combine_chunks() for c in zip(*[r[1:] for r in read]))
        rate = pc.if_else(pc.equal(rate, ""), pa.scalar(None, pa.string()), rate)
        cols = [row_id.take(at), name, value, kind, rate]
        wrong = _misshapen(_joined(name, value, kind, rate), _RECORD)
        good, bad = bisect(len(at), wrong, lambda places: _typed(*_at(cols, places)), block)
        judged += [_strict(*(c[i].as_py() for c in cols)) for i in bad]
    return _rows_of(good, judged)


def _parse(df: DataFrame, judge: Callable, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from judge(b, block)

    return df.mapInArrow(run, OUT_SCHEMA)


def parse_messages(df: DataFrame, row_id: str = "seq", block: int = 4096) -> DataFrame:
    """Judge tokenised messages (name, value, type, samplerate); one row each, reason null where valid."""
    fields = df.select(F.col(row_id).cast("bigint").alias("row_id"), "name", "value", "type", "samplerate")
    return _parse(fields, judge_messages, block)


def parse_spool(df: DataFrame, row_id: str = "line_id", line: str = "line", block: int = 4096) -> DataFrame:
    """Judge spool lines `second,name,value,type,samplerate`; one row each, reason null where valid."""
    return _parse(df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(line).alias("line")), judge_lines, block)


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("row_id", "reason")
