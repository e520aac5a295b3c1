"""Numbers as the wire protocol reads and writes them, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mantissa, exponent, and an exponent letter without digits, of whatever a text starts with.
_HEAD = r"(?s)\A([+-]?[0-9]*(?:\.[0-9]*)?)([eE][+-]?[0-9]+)?([eE])?.*\z"
_SMALLEST_NORMAL = 2.2250738585072014e-308


def _plain(text: Column) -> Column:
    """Whether a text is a decimal number through and through: at most a leading sign, digits and one point."""
    rest = F.translate(text, "0123456789", "")
    unsigned = rest.isin("", ".")
    signed = rest.isin("-", "+", "-.", "+.") & (F.substring(text, 1, 1) == F.substring(rest, 1, 1))
    return (unsigned | signed) & (F.length(text) > F.length(rest))


def number_parts(text: Column) -> Column:
    """Array of mantissa, exponent and lone exponent letter; null for plain numbers, which need no pattern."""
    return F.when(~_plain(text), F.split(F.regexp_replace(text, _HEAD, "$1\n$2\n$3"), "\n"))


def number_of(parts: Column, text: Column, any_size: bool = False) -> Column:
    """The number a text starts with, or null: what follows it is ignored, and a sign or point alone reads as zero.

    Only where an exponent letter follows the digits can a value be out of range, and is then rejected; any_size takes it
    as the infinity or the zero it comes to.
    """
    mantissa, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    has_letter = F.length(F.concat(exponent, F.get(parts, F.lit(2)))) > 0
    has_digit = F.length(F.translate(mantissa, "+-.", "")) > 0
    zero = F.length(F.translate(mantissa, "+-.0", "")) == 0
    scaled = F.concat(mantissa, exponent).try_cast("double")
    size = F.abs(scaled)
    in_range = F.lit(True) if any_size else (size < float("inf")) & ((size >= _SMALLEST_NORMAL) | zero)
    return (
        F.when(parts.isNull(), text.try_cast("double"))
        .when(has_letter, F.when(has_digit & in_range, scaled))
        .when(has_digit, mantissa.try_cast("double"))
        .when(F.length(mantissa) > 0, F.lit(0.0))
    )


def bind(*columns: Column) -> Column:
    """A generator that evaluates the columns once per row, as fields of one struct.

    Plain projections would be inlined into every expression and filter that mentions them.
    """
    return F.explode(F.array(F.struct(*columns)))


@F.pandas_udf(T.StringType())
def fixed_point(value: pd.Series) -> pd.Series:
    """Six decimals, rounded on the exact binary value, ties to even."""
    return value.map(lambda v: None if v is None else f"{v:f}")


@F.pandas_udf(T.StringType())
def record_value(value: pd.Series, whole: pd.Series) -> pd.Series:
    """Values of text records: whole ones as integers, the others with six decimals."""
    return pd.Series([f"{v:f}" if not w else str(int(v)) for v, w in zip(value, whole)], dtype="object")


def floor_to(ts: Column, seconds: int) -> Column:
    """A time in seconds, floored to a multiple."""
    return ts - F.pmod(ts, F.lit(seconds))
