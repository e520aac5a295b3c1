"""Parsing, aggregates and emission against known cases."""

import math

import pytest
from pyspark.sql import functions as F

from meterloom.config import EngineConfig, Histogram, read_ini
from meterloom.functions import protocol
from meterloom.functions.numbers import number_of, number_parts
from meterloom.operators import aggregate as agg
from meterloom.operators import emit
from meterloom.sources import binary, text

ONE = EngineConfig(flush_interval=1, quantiles=(0.5, 0.9, 0.95, 0.99))


def lines(spark, *rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "seq bigint, line string")


def flushed(spark, cfg, *rows):
    x = emit.in_stream_order(emit.flush(protocol.parse_lines(lines(spark, *rows)), cfg, F.lit(7)))
    return [r.line for r in emit.text_records(x).select("line").collect()]


def test_text_cases(spark):
    got = flushed(
        spark, ONE, "tubez:100|kv", "g1:1|g", "g1:50|g", "gd:+50|g", "gd:+50|g", "gn:-50|g", "gn:-50|g", "inventory:100|g", "inventory:-5|g", "inventory:+2|g",
        "foobar:100|c", "foobar:200|c", "foobar:300|c", "sampled:100|c|@0.1", "sampled:200|c|@0.1", "sampled:300|c|@0.1", "signed:+100|c", "signed:+200|c", "signed:-50|c",
        "zip:foo|s", "zip:bar|s", "zip:baz|s", "this is junk data", "foobar10c", "foobar:c", "a:1|c\r",
    )
    assert set(got) == {
        "kv.tubez|100.000000|7", "gauges.g1|50.000000|7", "gauges.gd|100.000000|7", "gauges.gn|-100.000000|7", "gauges.inventory|97.000000|7",
        "counts.foobar|600.000000|7", "counts.sampled|6000.000000|7", "counts.signed|250.000000|7", "sets.zip|3|7",
    }


def test_timer_of_100(spark):
    got = dict(x.split("|")[:2] for x in flushed(spark, ONE, *[f"noobs:{i}|ms" for i in range(100)], *[f"r:{i}|h|@0.5" for i in range(100)]))
    for name, count in (("noobs", 100), ("r", 200)):
        t = {k.removeprefix(f"timers.{name}."): v for k, v in got.items() if k.startswith(f"timers.{name}.")}
        assert t["sum"] == t["rate"] == "4950.000000" and t["sum_sq"] == "328350.000000" and t["mean"] == "49.500000"
        assert (t["lower"], t["upper"], t["count"], t["stdev"]) == ("0.000000", "99.000000", str(count), "29.011492")
        assert t["sample_rate"] == f"{count:f}" and t["median"] == t["p50"] == "49.000000"
        for q, v in ((90, 90), (95, 95), (99, 99)):
            assert abs(float(t[f"p{q}"]) - v) <= 1


def test_single_timer_has_no_deviation(spark):
    got = dict(x.split("|")[:2] for x in flushed(spark, ONE, "one:100|ms"))
    assert got["timers.one.stdev"] == "0.000000" and got["timers.one.sum_sq"] == "10000.000000"


def test_timers_include(spark):
    cfg = read_ini("[e]\nflush_interval = 1\ntimers_include = MEAN,STDEV,SUM,SUM_SQ,LOWER,UPPER,SAMPLE_RATE\nquantiles = 0.5\n")
    got = dict(x.split("|")[:2] for x in flushed(spark, cfg, "f:100|ms", "f:200|ms", "f:300|ms"))
    want = {"mean": 200, "stdev": 100, "sum": 600, "sum_sq": 140000, "lower": 100, "upper": 300, "p50": 200, "sample_rate": 3}
    assert {k.removeprefix("timers.f."): float(v) for k, v in got.items()} == want


@pytest.mark.parametrize(
    ("legacy", "rate", "count", "per_second"),
    [(True, "", "3", "300.000000"), (True, "|@0.1", "30", "3000.000000"), (False, "", "600.000000", "300.000000"), (False, "|@0.1", "6000.000000", "3000.000000")],
)
def test_extended_counters(spark, legacy, rate, count, per_second):
    cfg = EngineConfig(flush_interval=2, extended_counters=True, legacy_extended_counters=legacy)
    got = flushed(spark, cfg, *[f"f:{v}|c{rate}" for v in (100, 200, 300)])
    assert got == [f"counts.f.count|{count}|7", f"counts.f.rate|{per_second}|7"]


def test_histogram(spark):
    cfg = EngineConfig(flush_interval=1, quantiles=(), histograms=(Histogram("has_hist", 10, 90, 10),))
    got = [x for x in flushed(spark, cfg, *[f"has_hist.test:{i}|ms" for i in range(100)], "zip:1|ms") if "histogram" in x]
    labels = ["bin_<10.00", *[f"bin_{i}.00" for i in range(10, 90, 10)], "bin_>90.00"]
    assert got == [f"timers.has_hist.test.histogram.{b}|10|7" for b in labels]


def test_histogram_edges_and_ragged_range(spark):
    cfg = EngineConfig(histograms=(Histogram("baz", 0, 20, 2), Histogram("rag", 0, 10, 3)))
    s = protocol.parse_lines(lines(spark, *[f"baz:{v}|ms" for v in (1, 10, 50)], "rag:9.5|ms", "rag:8.9|ms", "baz:nan|ms"))
    s = s.unionByName(binary.parse_chunks(spark.createDataFrame([(0, bytearray(binary.write_number(3, "baz", -1.0)))], "chunk_no bigint, data binary")).select(F.lit(9).cast("bigint").alias("seq"), "type", "name", "value", "member", "sample_rate"))
    got = {(r.name, r.bin): r["count"] for r in agg.histograms(s, cfg).where("count > 0").collect()}
    assert got == {("baz", 0): 1, ("baz", 1): 1, ("baz", 6): 1, ("baz", 11): 1, ("rag", 4): 1, ("rag", 3): 1}


def test_stream_order(spark):
    got = flushed(spark, EngineConfig(quantiles=()), "test:1|kv", "test2:2|kv", "foo:1|c", "bar:2|c", "baz:1|ms", "g:1|g", "s:a|s")
    kinds = [x.split(".")[0] for x in got]
    assert [x.split("|")[0] for x in got[:2]] == ["kv.test2", "kv.test"]
    assert kinds == sorted(kinds, key=["kv", "counts", "timers", "gauges", "sets"].index)


def test_input_counter(spark):
    got = flushed(spark, EngineConfig(input_counter="numStats"), "a:1|c", "b:2|kv", "s:x|s", "junk")
    assert "counts.numStats|3.000000|7" in got


def test_numbers(spark):
    cases = {
        "1": 1.0, "1.0": 1.0, "2.3456789": 2.3456789, "1.0e5": 1e5, "2.0e05": 2e5, "3.0E05": 3e5, "4.0e-5": 4e-5, "12abc": 12.0, "1e": 1.0, "-": 0.0, "+": 0.0, ".": 0.0, "5.": 5.0, ".5": 0.5, "-7": -7.0,
        "1.964393875E-314": None, "1e400": None, " 5": None, "nan": None, "inf": None, "abc": None, "e5": None, "": None, "1e-400": None, "0e-400": 0.0, "5-": 5.0, "-.5": -0.5, "-5.": -5.0, "+.": 0.0, "1.2.3": 1.2, "--5": 0.0, ".-5": 0.0, "+5": 5.0, "1 2": 1.0, "9" * 400: math.inf,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    for r in df.select("t", "want", number_of(number_parts(F.col("t")), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


def test_sample_rates(spark):
    got = protocol.parse_lines(lines(spark, "a:1|c|@0.5", "b:1|c|@2", "c:1|c|@x", "d:1|c|@xx", "e:1|c|@0", "f:1|ms|@0.25\r", "g:1|g|@0.5", "h:1|c|@1e-400", "i:1|c|@1e400", "j:1|c|@.e5", "k:1|c|@1e-1x"))
    assert {r.name: r.sample_rate for r in got.collect()} == {"a": 0.5, "b": 1.0, "c": 1.0, "e": 1.0, "f": 0.25, "h": 1.0, "i": 1.0, "k": 0.1}


def test_counter_weights_truncate(spark):
    got = agg.counters(protocol.parse_lines(lines(spark, "a:1|c|@0.1", "a:1|c|@0.3", "a:1|c|@0.7", "a:1|c|@0.5"))).first()
    assert got["count"] == 16


def test_condensed_lines(spark):
    got = protocol.to_samples(protocol.match_condensed(lines(spark, "a:1|c:2|c|@0.5:3|ms", "b:1|g", "bad:1|c:x")))
    assert sorted((r.name, r.type, r.value, r.sample_rate) for r in got.collect()) == [("a", "c", 1.0, 1.0), ("a", "c", 2.0, 0.5), ("a", "ms", 3.0, 1.0), ("b", "g", 1.0, 1.0)]


def test_types_have_own_namespaces(spark):
    got = flushed(spark, EngineConfig(quantiles=()), "x:1|c", "x:2|g", "x:3|s")
    assert got == ["counts.x|1.000000|7", "gauges.x|2.000000|7", "sets.x|1|7"]


def test_gauges_across_stretches(spark):
    n = 3 * agg.GAUGE_BUCKET
    rows = spark.range(0, n, 1001).select(
        F.col("id").alias("seq"), F.when(F.col("id") == 1001 * 70, "g").otherwise("gd").alias("type"), F.lit("x").alias("name"), F.lit(1.0).alias("value")
    )
    total = len(range(0, n, 1001))
    assert agg.gauges(rows).first().value == total - 70


def test_sets_small_are_exact_and_large_within_bound(spark):
    x = spark.range(10_000).select(F.lit("s").alias("type"), F.lit("big").alias("name"), F.concat(F.lit("test"), "id").alias("member"))
    x = x.unionByName(spark.range(640).select(F.lit("s").alias("type"), F.lit("small").alias("name"), F.concat(F.lit("test"), (F.col("id") % 64).cast("string")).alias("member")))
    got = {r.name: r.members for r in agg.sets(x, EngineConfig(set_eps=0.01)).collect()}
    assert got["small"] == 64 and 9900 < got["big"] < 10100


def test_coarse_sets_count_exactly_while_small(spark):
    sized = lambda n: spark.range(3 * n).select(F.lit("s").alias("type"), F.lit(f"n{n}").alias("name"), F.concat(F.lit("m"), (F.col("id") % n).cast("string")).alias("member"))
    cfg = EngineConfig(set_eps=0.1)
    assert cfg.set_precision == 7
    got = {r.name: r.members for r in agg.sets(sized(1).unionByName(sized(64)).unionByName(sized(5000)), cfg).collect()}
    assert got["n1"] == 1 and got["n64"] == 64 and abs(got["n5000"] - 5000) <= 3 * 0.1 * 5000


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_quantile_error(spark, order):
    x = spark.range(100_000).select(F.lit("ms").alias("type"), F.lit("q").alias("name"), F.col("id").cast("double").alias("value"), F.lit(1.0).alias("sample_rate"))
    x = x.orderBy(F.col("value").asc() if order == "asc" else F.col("value").desc())
    got = agg.timers(x, EngineConfig(quantiles=(0.5, 0.9, 0.99))).first().quantiles
    assert all(abs(g - w) <= 1000 for g, w in zip(got, (50_000, 90_000, 99_000)))


def test_empty_input(spark):
    assert flushed(spark, ONE) == []
    assert agg.histograms(protocol.parse_lines(lines(spark)), EngineConfig()).count() == 0


def test_null_lines_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a:1|c", "y")], "seq bigint, line string, name string")
    assert [r.name for r in protocol.parse_lines(df.drop("name")).collect()] == ["a"]


def test_binary_messages(spark):
    parts = [binary.write_number(1, "kv", 1.5), binary.write_number(2, "c", 2.0), b"\n", binary.write_number(5, "g", 10.0), binary.write_number(6, "g", -3.0), binary.write_set("s", "me"), binary.write_number(3, "t", math.nan), binary.write_number(3, "t", 4.0)]
    bad = binary.write_number(2, "ok", 1.0) + b"\xaa\x09" + binary.write_number(2, "never", 1.0)
    df = spark.createDataFrame([(1, bytearray(b"".join(parts))), (2, bytearray(bad)), (3, bytearray(b"")), (4, None)], "chunk_no bigint, data binary")
    got = [(r.type, r.name, r.value, r.member) for r in binary.parse_chunks(df).orderBy("chunk_no", "pos").collect()]
    assert got == [("kv", "kv", 1.5, None), ("c", "c", 2.0, None), ("g", "g", 10.0, None), ("gd", "g", -3.0, None), ("s", "s", None, "me"), ("ms", "t", 4.0, None), ("c", "ok", 1.0, None)]


def test_protocol_sniffing(spark):
    df = spark.createDataFrame([(1, bytearray(binary.write_number(2, "b", 2.0))), (2, bytearray(b"a:1|c\nx:5|g"))], "chunk_no bigint, data binary")
    got = [(r.type, r.name, r.value) for r in binary.parse_mixed(df).orderBy("seq").collect()]
    assert got == [("c", "b", 2.0), ("c", "a", 1.0), ("g", "x", 5.0)]


def test_binary_records(spark):
    cfg = EngineConfig(flush_interval=1, quantiles=(0.5, 0.9), histograms=(Histogram("t", 10, 90, 40),), prefix_binary_stream=True)
    s = protocol.parse_lines(lines(spark, *[f"t:{i}|ms" for i in range(100)], "c:5|c|@0.5", "g:3|g", "s:a|s", "k:1|kv"))
    rows = binary.parse_records(emit.binary_records(emit.flush(s, cfg, F.lit(9), binary=True), cfg)).collect()
    got = {(r.key, r.value_type, r.value, r.hist_count) for r in rows}
    assert {("counts.c", 4, 2.0, None), ("counts.c", 11, 10.0, None), ("gauges.g", 0, 3.0, None), ("sets.s", 1, 1.0, None), ("kv.k", 0, 1.0, None)} <= got
    assert {("timers.t", 8, 10.0, 10), ("timers.t", 9, 10.0, 40), ("timers.t", 9, 50.0, 40), ("timers.t", 10, 90.0, 10)} <= got
    assert {r.ts for r in rows} == {9} and ("timers.t", 5, 29.011491975882016, None) in got
    assert 128 | 50 in {r.value_type for r in rows}


def test_text_number_rounding(spark):
    got = flushed(spark, ONE, "a:0.0000005|kv", "b:2.3456789|kv")
    assert set(got) == {"kv.a|0.000000|7", "kv.b|2.345679|7"}


def test_datagrams(spark):
    df = spark.createDataFrame([(1, bytearray(b"zip:100|c")), (2, bytearray(b"zip:200|c\n")), (3, bytearray(b"zip:300|c\nx:1|g"))], "chunk_no bigint, data binary")
    got = agg.counters(protocol.parse_lines(text.split_datagrams(df))).collect()
    assert [(r.name, r["sum"]) for r in got] == [("zip", 600.0)]
