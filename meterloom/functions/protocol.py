"""The text protocol `name:value|type[|@rate]`: from lines or tokens to typed samples.

Samples: seq, ts, type (kv, g, gd, c, ms, s), name, value, member, sample_rate. A gauge text with a sign is a delta (gd);
h is ms. Anything that is no valid message gives no row; the operators for rejected rows are in `operators.badrows`. Only
with `counted`, for an input counter, do messages whose number or rate is none come along, as samples of the type UNUSABLE
that no aggregate takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.numbers import bind, number_of, number_parts

#: Type of samples that count as input only.
UNUSABLE = "unusable"
#: One message; groups: name, value, unrated type, rated type, rate.
MESSAGE = r"(?s)\A([^:]+):([^|]+)\|(?:(kv|g|s)|(ms|h|c)(?:\|@([^\n]+))?)\z"
#: The form with several values for one name: name(:value|type[|@rate])+.
CONDENSED = r"(?s)\A([^:]+)((?::[^|:]+\|(?:kv|g|s|(?:ms|h|c)(?:\|@[^:\n]+)?))+)\z"


def match_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds name, raw, type, rate of the lines that match the grammar; other lines vanish."""
    # one pass of the pattern; lines hold no newline, so it can part the groups
    parts = F.split(F.regexp_replace(line, MESSAGE, "$1\n$2\n$3$4\n$5"), "\n")
    others = [x for x in lines.columns if x != line]
    cut = lines.select(*others, F.explode(F.filter(F.array(parts), lambda p: F.size(p) == 4)).alias("_p"))
    return cut.select(*others, F.col("_p")[0].alias("name"), F.col("_p")[1].alias("raw"), F.col("_p")[2].alias("type"), F.nullif(F.col("_p")[3], F.lit("")).alias("rate"))


def match_condensed(lines: DataFrame, line: str = "line") -> DataFrame:
    """As match_messages, for lines that may hold several values of one name."""
    c = F.col(line)
    parts = F.explode(F.split(F.substring(F.regexp_extract(c, CONDENSED, 2), 2, 1 << 30), ":"))
    one = lines.where(c.rlike(CONDENSED)).withColumn("_part", parts).withColumn(line, F.concat(F.regexp_extract(c, CONDENSED, 1), F.lit(":"), "_part"))
    return match_messages(one.drop("_part"), line)


def effective_rate(rate: Column, number: Column) -> Column:
    """The sample rate that counts; null where a rate of two characters or more is no number."""
    usable = F.when((number > 0) & (number <= 1), number).otherwise(F.lit(1.0))
    return F.when(rate.isNull() | (F.length(rate) <= 1) & number.isNull(), F.lit(1.0)).when(number.isNotNull(), usable)


def to_samples(messages: DataFrame, name: str = "name", raw: str = "raw", kind: str = "type", rate: str = "rate", counted: bool = False) -> DataFrame:
    """Typed samples of tokenised messages; extra columns other than seq and ts are dropped.

    The type is a plain projection below the generator that parses numbers, so a filter on it, such as every aggregate
    has, is applied before any number is parsed.
    """
    t, v, r = F.col(kind), F.col(raw), F.col(rate)
    keep = [c for c in ("seq", "ts") if c in messages.columns]
    out_type = F.when(t == "h", "ms").when((t == "g") & v.rlike(r"\A[+-]"), "gd").otherwise(t)
    x = messages.select(*keep, F.col(name).alias("name"), out_type.alias("type"), v.alias("_v"), r.alias("_r"))
    is_set, rated = F.col("type") == "s", F.col("type").isin("c", "ms")
    x = x.select(*keep, "name", "type", bind(F.col("_v"), F.col("_r"), number_parts(F.when(~is_set, F.col("_v"))).alias("v"), number_parts(F.when(rated, F.col("_r"))).alias("r")).alias("_b"))
    x = x.select(
        *keep,
        "name",
        "type",
        bind(
            F.when(is_set, F.col("_b._v")).alias("member"),
            number_of(F.col("_b.v"), F.when(~is_set, F.col("_b._v"))).alias("value"),
            F.when(rated, effective_rate(F.col("_b._r"), number_of(F.col("_b.r"), F.col("_b._r"), any_size=True))).otherwise(F.lit(1.0)).alias("sample_rate"),
        ).alias("_b"),
    )
    x = x.select(*keep, "type", "name", "_b.value", "_b.member", "_b.sample_rate")
    usable = F.col("sample_rate").isNotNull() & (F.col("value").isNotNull() | (F.col("type") == "s") & F.col("member").isNotNull())
    return x.withColumn("type", F.when(usable, F.col("type")).otherwise(UNUSABLE)) if counted else x.where(usable)


def parse_lines(lines: DataFrame, line: str = "line", counted: bool = False) -> DataFrame:
    """Samples from lines without their line ends."""
    return to_samples(match_messages(lines, line), counted=counted)


def tokens_to_samples(messages: DataFrame, counted: bool = False) -> DataFrame:
    """Samples from a table of tokenised messages (name, value, type, samplerate), held to the same grammar as lines."""
    ok = (F.length("name") > 0) & ~F.col("name").contains(":") & (F.length("value") > 0) & ~F.col("value").contains("|")
    ok = ok & (F.col("type").isin("kv", "g", "s") & F.col("samplerate").isNull() | F.col("type").isin("ms", "h", "c"))
    return to_samples(messages.where(ok), raw="value", rate="samplerate", counted=counted)
