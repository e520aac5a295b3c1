"""Distinct counts over huge identifier sets by fixed bitmaps (linear counting).

Every identifier sets the bit its hash names in its group's bitmap of m bits; the estimate is -m ln(share of empty bits).
A bitmap is stored as its non-zero 64-bit words, one row each, so that a group costs no more than its identifiers, and the
union of two bitmaps is a bitwise or per word: partial results of days, files or runs merge by one aggregate that combines
map-side. m is a power of two: a bitmap folds to a smaller one by dropping high bits of the word number, so partial
results of different sizes merge too.

Standard deviation of the estimate for n identifiers, t = n / m: sqrt(m (e^t - t - 1)). `bits_for` takes the smallest
m whose relative deviation at the largest n stays under the target; smaller groups have smaller ones. The stated bound is
five standard deviations, and three identifiers for collisions in groups so small that no normal law holds.

Defined cases: null identifiers, and names that don't have the four parts, are not counted; a null time gives a group with
null day; repeated rows set the same bit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("site", "platform", "what")
WORD_BITS = 64
#: The largest power of two that bit numbers of 63 bits allow; the hash tells no more identifiers apart anyway.
MOST_BITS = 1 << 62
DEVIATIONS, COLLISIONS = 5.0, 3.0


def relative_error(n: float, m: int) -> float:
    """One standard deviation of the estimate, relative to n."""
    if n <= 0:
        return 0.0
    t = n / m
    return math.sqrt(m * (math.exp(min(t, 600.0)) - t - 1)) / n


def bits_for(capacity: int, error: float, least: int = 1 << 12) -> int:
    """The smallest power of two that keeps the error under `error` up to `capacity` identifiers in a group.

    Also at most 9 identifiers a bit, so that a bitmap has empty bits left with certainty for all practical purposes.
    """
    m = least
    while m < MOST_BITS and (relative_error(capacity, m) > error or capacity > 9 * m):
        m *= 2
    return m


def identifiers(messages: DataFrame) -> DataFrame:
    """(day, site, platform, what, id) of the set members in tokenised messages."""
    part = F.split("name", "\\.")
    ok = (F.col("type") == "s") & F.col("name").rlike("^uniq\\.[^.]+\\.[^.]+\\.[^.]+$") & (F.length("value") > 0) & ~F.col("value").contains("|")
    return messages.where(ok).select(
        F.to_date("ts").alias("day"), part[1].alias("site"), part[2].alias("platform"), part[3].alias("what"), F.col("value").alias("id")
    )


def largest_day(ids: DataFrame) -> int:
    """Roughly how many identifiers the fullest day has, a tenth added: no group can hold more. One small sketch a day."""
    most = ids.groupBy("day").agg(F.approx_count_distinct("id", 0.02).alias("n")).agg(F.max("n")).first()[0]
    return math.ceil(1.1 * (most or 1))


def build(ids: DataFrame, bits: int) -> DataFrame:
    """(day, site, platform, what, word_no, word, bits): partial bitmaps, one row per non-zero word."""
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(WORD_BITS)).cast("int"))
    x = ids.select("day", *DIMS, F.shiftright(spot, 6).alias("word_no"), bit.alias("bit"))
    return x.groupBy("day", *DIMS, "word_no").agg(F.bit_or("bit").alias("word")).withColumn("bits", F.lit(bits).cast("bigint"))


def fold(partial: DataFrame, bits: int) -> DataFrame:
    """Partial bitmaps of any sizes from `bits` up, brought to `bits`."""
    words = F.lit(bits // WORD_BITS)
    return partial.withColumn("word_no", F.pmod("word_no", words)).withColumn("bits", F.lit(bits).cast("bigint"))


def merge(*partials: DataFrame, bits: int | None = None) -> DataFrame:
    """The union of partial bitmaps, of `bits` bits, or of the size of the smallest, which takes one job to find out."""
    both = partials[0]
    for x in partials[1:]:
        both = both.unionByName(x)
    bits = bits or both.agg(F.min("bits")).first()[0] or WORD_BITS
    return fold(both, bits).groupBy("day", *DIMS, "word_no", "bits").agg(F.bit_or("word").alias("word"))


def _estimate(set_bits: Column, m: Column) -> Column:
    return -m * F.log(F.greatest(m - set_bits, F.lit(1.0)) / m)


def _bound(n: Column, m: Column) -> Column:
    t = n / m
    return (DEVIATIONS * F.sqrt(m * F.greatest(F.exp(t) - t - 1, F.lit(0.0))) + COLLISIONS) / n


def estimate_cube(partial: DataFrame) -> DataFrame:
    """(day, site, platform, what, estimate, error_bound, bits): every group and every combination; null means all.

    All combinations of one (day, word_no) meet in one partition, so the bitmaps move once and the eightfold blow-up stays
    inside the tasks, where it collapses to one row per combination and word; only set-bit counts are shuffled again.
    error_bound is relative to the estimate.
    """
    here = partial.repartition("day", "word_no")
    combos = [
        F.struct(*[(F.col(d) if keep >> i & 1 else F.lit(None).cast("string")).alias(d) for i, d in enumerate(DIMS)], F.lit(keep).alias("kept"))
        for keep in range(2 ** len(DIMS))
    ]
    wide = here.select("day", "word_no", "bits", "word", F.explode(F.array(*combos)).alias("c"))
    words = wide.groupBy("day", "word_no", "bits", "c").agg(F.bit_or("word").alias("word"))
    full = words.groupBy("day", "c", "bits").agg(F.sum(F.bit_count("word")).alias("set_bits"))
    m = F.col("bits").cast("double")
    n = _estimate(F.col("set_bits"), m)
    return full.select("day", *[F.col(f"c.{d}").alias(d) for d in DIMS], n.alias("estimate"), _bound(n, m).alias("error_bound"), "bits")


def bitmaps_of(messages: DataFrame, error: float = 0.01, bits: int | None = None) -> DataFrame:
    """The partial bitmaps of a table, sized for a relative standard deviation of `error` in its fullest day."""
    ids = identifiers(messages)
    return build(ids, bits or bits_for(largest_day(ids), error))


def counts_with_partials(partial: DataFrame) -> DataFrame:
    """(day, site, platform, what, estimate, error_bound, bits, word_no, word): the counts, and the bitmaps they come from.

    Rows with an estimate are groups and combinations of groups, null meaning all. Rows with a word are the bitmaps of the
    groups, to be kept: `partials_in` reads them back, `merge` unites them with those of other days, files or runs.
    """
    counts = estimate_cube(partial).withColumns({"word_no": F.lit(None).cast("bigint"), "word": F.lit(None).cast("bigint")})
    words = partial.withColumns({"estimate": F.lit(None).cast("double"), "error_bound": F.lit(None).cast("double")})
    return counts.unionByName(words)


def partials_in(kept: DataFrame) -> DataFrame:
    """The partial bitmaps in a result of `counts_with_partials`."""
    return kept.where(F.col("word").isNotNull()).select("day", *DIMS, "word_no", "word", "bits")


def distinct_counts(messages: DataFrame, error: float = 0.01, bits: int | None = None) -> DataFrame:
    """Distinct identifiers per day and combination of site, platform and what; error: one standard deviation, relative."""
    return estimate_cube(bitmaps_of(messages, error, bits))
