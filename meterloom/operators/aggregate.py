"""One flush: the aggregates of all samples of an interval, per type and name.

Every function takes samples (see `functions.protocol`) and optional extra grouping columns, such as a window; all
aggregates but gauges are order-free and combine map-side. Types have name spaces of their own.

Defined cases: samples with null name or type belong to no group; null values and NaN timers are left out; an empty input
gives no rows; repeated samples count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import EngineConfig, Histogram

#: Up to this many members a set counts exactly, and a sketch of this precision then still holds every member's hash.
EXACT_SET, EXACT_PRECISION = 64, 10
GAUGE_BUCKET = 1 << 16


def _weight() -> Column:
    """Events a sample stands for, truncated sample by sample."""
    return F.floor(1.0 / F.col("sample_rate")).cast("bigint")


def counters(samples: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(name, sum, count, rate): scaled sum, weighted count, sum per second of the configured interval."""
    x = samples.where((F.col("type") == "c") & F.col("name").isNotNull() & F.col("value").isNotNull())
    total = F.sum(F.col("value") * (1.0 / F.col("sample_rate")))
    return x.groupBy(*by, "name").agg(total.alias("sum"), F.sum(_weight()).alias("count"), (total / F.lit(float(cfg.flush_interval))).alias("rate"))


def _timer_rows(samples: DataFrame) -> DataFrame:
    return samples.where((F.col("type") == "ms") & F.col("name").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def timers(samples: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(name, sum, sum_sq, mean, lower, upper, count, actual_count, stdev, median, quantiles, rate, sample_rate).

    quantiles: one value per configured quantile, from a mergeable sketch of rank error 1 / accuracy; values of sampled
    timers are not scaled. median is the 0.5 quantile, null unless that is configured.
    """
    v = F.col("value")
    seconds = F.lit(float(cfg.flush_interval))
    qs = [float(q) for q in cfg.quantiles]
    quantiles = F.percentile_approx(v, qs, cfg.accuracy) if qs else F.lit(None).cast("array<double>")
    out = _timer_rows(samples).groupBy(*by, "name").agg(
        F.sum(v).alias("sum"),
        F.sum(v * v).alias("sum_sq"),
        F.avg(v).alias("mean"),
        F.min(v).alias("lower"),
        F.max(v).alias("upper"),
        F.sum(_weight()).alias("count"),
        F.count(v).alias("actual_count"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        (F.first(F.lit(None).cast("array<double>")) if not qs else quantiles).alias("quantiles"),
        (F.sum(v) / seconds).alias("rate"),
        (F.sum(_weight()) / seconds).alias("sample_rate"),
    )
    median = F.element_at("quantiles", qs.index(0.5) + 1) if 0.5 in qs else F.lit(None).cast("double")
    return out.withColumn("median", median)


def scalars(samples: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(type, name, and the columns of counters, timers and sets): all three from one pass over the samples.

    A column that a type lacks is null. With exact_sets, sets are left out: exact counts need a shuffle of their own.
    """
    t, v = F.col("type"), F.when(F.col("type") == "ms", F.col("value"))
    number = t.isin("c", "ms") & F.col("value").isNotNull() & ~((t == "ms") & F.isnan("value"))
    member = (t == "s") & F.col("member").isNotNull() & F.lit(not cfg.exact_sets)
    qs = [float(q) for q in cfg.quantiles]
    seconds = F.lit(float(cfg.flush_interval))
    precision = max(EXACT_PRECISION, cfg.set_precision)
    found = F.when(t == "s", F.col("member"))
    size = lambda p: F.hll_sketch_estimate(F.hll_sketch_agg(found, F.lit(p)))
    coarse = cfg.set_precision < EXACT_PRECISION
    out = samples.where(F.col("name").isNotNull() & (number | member)).groupBy(*by, "type", "name").agg(
        F.sum(F.when(t == "c", F.col("value") * (1.0 / F.col("sample_rate"))).otherwise(v)).alias("sum"),
        F.sum(F.when(t != "s", _weight())).alias("count"),
        F.sum(v * v).alias("sum_sq"),
        F.avg(v).alias("mean"),
        F.min(v).alias("lower"),
        F.max(v).alias("upper"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        (F.percentile_approx(v, qs, cfg.accuracy) if qs else F.first(F.lit(None).cast("array<double>"))).alias("quantiles"),
        (F.lit(None).cast("bigint") if cfg.exact_sets else size(precision)).alias("members"),
        (size(cfg.set_precision) if coarse and not cfg.exact_sets else F.lit(None).cast("bigint")).alias("_coarse"),
    )
    median = F.element_at("quantiles", qs.index(0.5) + 1) if 0.5 in qs else F.lit(None).cast("double")
    members = F.when((F.col("members") > EXACT_SET) & F.col("_coarse").isNotNull(), F.col("_coarse")).otherwise(F.col("members"))
    out = out.withColumns({"rate": F.col("sum") / seconds, "sample_rate": F.col("count") / seconds, "median": median, "members": members})
    return out.drop("_coarse")


def longest_prefix(name: Column, hists: tuple[Histogram, ...], value) -> Column:
    """value(h) of the histogram with the longest prefix of name, null without one: a narrow CASE, no join."""
    out = None
    for h in sorted(hists, key=lambda h: -len(h.prefix)):
        cond = name.startswith(h.prefix)
        out = F.when(cond, value(h)) if out is None else out.when(cond, value(h))
    return F.lit(None) if out is None else out


def _bin(h: Histogram) -> Column:
    v = F.col("value")
    inner = ((v - F.lit(h.min_val)) / F.lit(h.bin_width)).cast("int") + 1
    return F.when(v < h.min_val, 0).when(v >= h.max_val, h.num_bins - 1).otherwise(inner)


def histograms(samples: DataFrame, cfg: EngineConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, bin, label, count): every bin of every timer that a configured prefix matches, empty ones too."""
    hists = cfg.histograms
    if not hists:
        kinds = {"name": "string", "bin": "int", "label": "string", "count": "bigint"}
        return samples.limit(0).select(*by, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    x = _timer_rows(samples).withColumn("bin", longest_prefix(F.col("name"), hists, _bin)).where("bin is not null")
    counted = x.groupBy(*by, "name", "bin").agg(F.count(F.lit(1)).alias("count"))
    # at most MAX_BINS entries a name
    per_name = counted.groupBy(*by, "name").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_found"))
    labels = longest_prefix(F.col("name"), hists, lambda h: F.array(*[F.lit(h.label(i)) for i in range(h.num_bins)]))
    return per_name.select(*by, "name", "_found", F.posexplode(labels).alias("bin", "label")).select(
        *by, "name", "bin", "label", F.coalesce(F.try_element_at("_found", F.col("bin")), F.lit(0)).cast("bigint").alias("count")
    )


def gauges(samples: DataFrame, by: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """(name, value): the last absolute value, or zero, plus the deltas after it, in order of seq.

    Folded in two steps, so that one busy gauge is spread: per (name, stretch of seq), then over a name's stretches.
    """
    x = samples.where(F.col("type").isin("g", "gd") & F.col("name").isNotNull() & F.col("value").isNotNull())
    x = x.select(*by, "name", F.col(seq).alias("_seq"), (F.col("type") == "g").alias("_abs"), "value").withColumn(
        "_part", F.floor(F.col("_seq") / GAUGE_BUCKET)
    )
    in_part = Window.partitionBy(*by, "name", "_part")
    x = x.withColumn("_base", F.max(F.when(F.col("_abs"), F.col("_seq"))).over(in_part))
    parts = x.where(F.col("_base").isNull() | (F.col("_seq") >= F.col("_base"))).groupBy(*by, "name", "_part").agg(
        F.sum("value").alias("value"), F.max("_base").isNotNull().alias("_has")
    )
    of_name = Window.partitionBy(*by, "name")
    parts = parts.withColumn("_from", F.max(F.when(F.col("_has"), F.col("_part"))).over(of_name))
    return parts.where(F.col("_from").isNull() | (F.col("_part") >= F.col("_from"))).groupBy(*by, "name").agg(F.sum("value").alias("value"))


def key_values(samples: DataFrame, by: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """(name, value, seq): passed through; later ones come out first where a text is written."""
    return samples.where((F.col("type") == "kv") & F.col("name").isNotNull() & F.col("value").isNotNull()).select(*by, "name", "value", F.col(seq).alias("seq"))


def sets(samples: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """(name, members): how many different members; a mergeable sketch, exact while small, or exact throughout."""
    x = samples.where((F.col("type") == "s") & F.col("name").isNotNull() & F.col("member").isNotNull())
    if exact:
        return x.groupBy(*by, "name").agg(F.count_distinct("member").alias("members"))
    size = lambda precision: F.hll_sketch_estimate(F.hll_sketch_agg("member", F.lit(precision)))
    if cfg.set_precision >= EXACT_PRECISION:
        return x.groupBy(*by, "name").agg(size(cfg.set_precision).alias("members"))
    # coarse sketches are only asked once a set has outgrown exact counting
    both = x.groupBy(*by, "name").agg(size(EXACT_PRECISION).alias("_small"), size(cfg.set_precision).alias("_large"))
    return both.select(*by, "name", F.when(F.col("_small") <= EXACT_SET, F.col("_small")).otherwise(F.col("_large")).alias("members"))


def count_inputs(samples: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Samples plus one counter sample per message, if the configuration names an input counter.

    Messages whose number is none count too, if the samples were parsed with `counted`.
    """
    if not cfg.input_counter:
        return samples
    one = samples.select(
        *[
            {
                "type": F.lit("c"),
                "name": F.lit(cfg.input_counter),
                "value": F.lit(1.0),
                "member": F.lit(None).cast("string"),
                "sample_rate": F.lit(1.0),
            }.get(c, F.col(c)).alias(c)
            for c in samples.columns
        ]
    )
    return samples.unionByName(one)
