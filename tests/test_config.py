import pytest

from meterloom.config import EngineConfig, Histogram, parse_timers_include, percentile_code, percentile_label, precision_for_error, read_ini, validate


@pytest.mark.parametrize(("args", "bins"), [((100, 200, 10), 12), ((0, 1000, 2), 502), ((0, 100, 5), 22), ((0, 10, 3), 5), ((0, 20, 2), 12)])
def test_bins(args, bins):
    assert Histogram("x", *map(float, args)).num_bins == bins


@pytest.mark.parametrize("args", [(200, 200, 10), (100, 50, 10), (0, 1000, 0.5), (0, 10, 0)])
def test_bad_histograms(args):
    with pytest.raises(ValueError):
        validate(EngineConfig(histograms=(Histogram("x", *map(float, args)),)))


@pytest.mark.parametrize(("eps", "precision"), [(0.02, 12), (0.01, 14), (0.005, 16), (0.2, 5), (0.1, 7), (0.03, 11)])
def test_precision(eps, precision):
    assert precision_for_error(eps) == precision


@pytest.mark.parametrize("eps", [-0.01, 0.0, 1.0, 0.5, 0.001])
def test_bad_set_eps(eps):
    with pytest.raises(ValueError):
        validate(EngineConfig(set_eps=eps))


@pytest.mark.parametrize("bad", [{"flush_interval": 0}, {"timer_eps": 0.5}, {"timer_eps": 0.0}, {"quantiles": (1.0,)}, {"quantiles": (0.0,)}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        validate(EngineConfig(**bad))


def test_duplicate_prefix():
    with pytest.raises(ValueError):
        validate(EngineConfig(histograms=(Histogram("a", 0, 1, 1), Histogram("a", 0, 2, 1))))


def test_ini():
    c = read_ini(
        """
[engine]
port = 9000
flush_interval = 60
quantiles = 0.5, 0.75
extended_counters = YES
legacy_extended_counters = false
global_prefix = app.
counts_prefix = c.
use_type_prefix = 1
timers_include = MEAN,STDEV,SUM,SUM_SQ,LOWER,UPPER,SAMPLE_RATE
daemonize = true

[histogram_api]
prefix = api
min = 0
max = 100
width = 10
"""
    )
    assert (c.tcp_port, c.flush_interval, c.quantiles) == (9000, 60, (0.5, 0.75))
    assert c.extended_counters and not c.legacy_extended_counters
    assert c.prefix("c") == "app.c." and c.prefix("g") == "app.gauges."
    assert c.timers_include == {"mean", "stdev", "sum", "sum_sq", "lower", "upper", "sample_rate"}
    assert c.histograms[0].num_bins == 12


def test_ini_errors():
    with pytest.raises(ValueError):
        read_ini("[a]\nport = 1\n[b]\nport = 2\n")
    with pytest.raises(ValueError):
        read_ini("[a]\nport = 1\n[histogram1]\nprefix = x\nmin = 0\n")
    with pytest.raises(ValueError):
        read_ini("[a]\naligned_flush = maybe\n")


def test_no_type_prefix():
    c = EngineConfig(use_type_prefix=False, global_prefix="g.")
    assert {c.prefix(k) for k in ("kv", "g", "c", "ms", "s")} == {"g."}


def test_timers_include_abbreviations():
    assert parse_timers_include("cou, med, upp") == {"count", "median", "upper"}
    assert parse_timers_include("mean, su, lower") == {"mean"}
    assert parse_timers_include("sum_") == {"sum_sq"}


def test_percentile_names():
    assert [percentile_label(q) for q in (0.5, 0.95, 0.995, 0.125)] == ["p50", "p95", "p100", "p12"]
    assert [percentile_code(q) & 0x7F for q in (0.29, 0.57, 0.99)] == [28, 56, 99]


def test_longest_prefix():
    c = EngineConfig(histograms=tuple(Histogram(p, 0, 1, 1) for p in ("", "api", "site", "api.foo", "site.bar", "api.foo.zip")))
    want = {"api.zoo": "api", "site.other": "site", "api.foo.here": "api.foo", "site.bar.sub": "site.bar", "api.foo.zip.sub.sub.key": "api.foo.zip", "other": ""}
    assert {n: c.histogram_for(n).prefix for n in want} == want
