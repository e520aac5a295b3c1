"""Engine settings: defaults, the INI file, and what makes a setting invalid."""

from __future__ import annotations

import configparser
import math
import re
import warnings
from dataclasses import dataclass, field, fields, replace

#: Names of the timer statistics that can be switched; fixed values, in the order in which abbreviations are resolved.
TIMER_STATS = ("count", "mean", "stdev", "sum", "sum_sq", "lower", "upper", "rate", "median", "sample_rate")
MAX_BINS, MANY_BINS = 1024, 128
HLL_PRECISION = (4, 18)


@dataclass(frozen=True)
class Histogram:
    prefix: str
    min_val: float
    max_val: float
    bin_width: float

    @property
    def num_bins(self) -> int:
        """One below the range, one above, and the bins between; a ragged last bin falls to the one above."""
        return int((self.max_val - self.min_val) / self.bin_width + 2)

    def label(self, i: int) -> str:
        if i == 0:
            return f"bin_<{self.min_val:.2f}"
        if i == self.num_bins - 1:
            return f"bin_>{self.max_val:.2f}"
        return f"bin_{self.min_val + self.bin_width * (i - 1):.2f}"


@dataclass(frozen=True)
class EngineConfig:
    tcp_port: int = 8125
    udp_port: int = 8125
    udp_rcvbuf: int = 0
    bind_address: str = "::"
    parse_stdin: bool = False
    flush_interval: int = 10
    aligned_flush: bool = False
    timer_eps: float = 0.01
    set_eps: float = 0.02
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)
    timers_include: frozenset[str] = frozenset(TIMER_STATS)
    extended_counters: bool = False
    legacy_extended_counters: bool = True
    use_type_prefix: bool = True
    global_prefix: str = ""
    kv_prefix: str = "kv."
    gauges_prefix: str = "gauges."
    counts_prefix: str = "counts."
    timers_prefix: str = "timers."
    sets_prefix: str = "sets."
    binary_stream: bool = False
    prefix_binary_stream: bool = False
    input_counter: str | None = None
    stream_cmd: str = "cat"
    histograms: tuple[Histogram, ...] = field(default=())
    #: Accuracy of the mergeable quantile sketch; None: twice what timer_eps asks for, as merging costs some.
    quantile_accuracy: int | None = None
    #: Count sets of any size exactly, by a shuffle of their members, instead of by a sketch of set_eps.
    exact_sets: bool = False

    @property
    def set_precision(self) -> int:
        return precision_for_error(self.set_eps)

    @property
    def accuracy(self) -> int:
        return self.quantile_accuracy or math.ceil(2 / self.timer_eps)

    def prefix(self, kind: str) -> str:
        """Prefix of a type's keys: kv, g, c, ms or s."""
        own = {"kv": self.kv_prefix, "g": self.gauges_prefix, "c": self.counts_prefix, "ms": self.timers_prefix, "s": self.sets_prefix}[kind]
        return self.global_prefix + (own if self.use_type_prefix else "")

    def histogram_for(self, name: str) -> Histogram | None:
        found = [h for h in self.histograms if name.startswith(h.prefix)]
        return max(found, key=lambda h: len(h.prefix), default=None)


def precision_for_error(error: float) -> int:
    """Bits of a HyperLogLog index for a relative error."""
    if not 0 < error < 1:
        raise ValueError("set_eps must lie between 0 and 1")
    return math.ceil(math.log2((1.04 / error) ** 2))


def percentile_label(q: float) -> str:
    """Label in text records; half-even, so two quantiles may share one."""
    return f"p{q * 100:.0f}"


def percentile_code(q: float) -> int:
    """Value type in binary records; truncates."""
    return 0x80 | int(q * 100)


def validate(c: EngineConfig) -> EngineConfig:
    if c.flush_interval <= 0:
        raise ValueError("flush_interval must be positive")
    if c.flush_interval >= 600:
        warnings.warn("a very long flush_interval risks losing data", stacklevel=2)
    if not 0 < c.timer_eps < 0.5:
        raise ValueError("timer_eps must lie between 0 and 0.5")
    if any(not 0 < q < 1 for q in c.quantiles):
        raise ValueError("quantiles must lie between 0 and 1")
    low, high = HLL_PRECISION
    if not low <= c.set_precision <= high:
        raise ValueError("set_eps needs a precision outside the supported range")
    if len({h.prefix for h in c.histograms}) != len(c.histograms):
        raise ValueError("two histograms share a prefix")
    for h in c.histograms:
        if h.min_val >= h.max_val:
            raise ValueError(f"histogram {h.prefix!r}: min must be below max")
        if h.bin_width <= 0:
            raise ValueError(f"histogram {h.prefix!r}: width must be positive")
        if h.num_bins > MAX_BINS:
            raise ValueError(f"histogram {h.prefix!r}: more than {MAX_BINS} bins")
        if h.num_bins > MANY_BINS:
            warnings.warn(f"histogram {h.prefix!r} has very many bins", stacklevel=2)
    return c


def parse_bool(text: str) -> bool:
    word = text.strip().lower()
    if word in ("true", "yes", "1"):
        return True
    if word in ("false", "no", "0"):
        return False
    raise ValueError(f"no boolean: {text!r}")


def parse_timers_include(text: str) -> frozenset[str]:
    """Comma-separated names, abbreviated to three characters or more; a shorter one ends the list."""
    chosen = set()
    for token in re.findall(r"[^, ]+", text):
        if len(token) < 3:
            break
        full = next((s for s in TIMER_STATS if s.startswith(token.lower())), None)
        if full:
            chosen.add(full)
    return frozenset(chosen)


_BOOLS = {f.name for f in fields(EngineConfig) if f.type == "bool"}
_INTS = {"tcp_port", "udp_port", "udp_rcvbuf", "flush_interval", "quantile_accuracy"}
_FLOATS = {"timer_eps", "set_eps"}
#: Settings of a process, not of a computation; read and ignored.
_PROCESS_ONLY = {"daemonize", "pid_file", "log_level", "log_facility"}


def read_ini(text: str) -> EngineConfig:
    """Settings from INI text: one main section of any name, and histogram sections; unknown keys warn, more sections are an error."""
    ini = configparser.RawConfigParser(strict=False, interpolation=None, inline_comment_prefixes=(";",))
    ini.read_string(text)
    values: dict = {}
    hists: list[Histogram] = []
    main = next((x for x in ini.sections() if not x.lower().startswith("histogram")), None)
    for section in ini.sections():
        options = dict(ini.items(section))
        if section == main:
            for key, raw in options.items():
                key = "tcp_port" if key == "port" else key
                if key in _PROCESS_ONLY:
                    continue
                if key == "quantiles":
                    values[key] = tuple(float(x) for x in raw.split(",") if x.strip())
                elif key == "timers_include":
                    values[key] = parse_timers_include(raw)
                elif key in _BOOLS:
                    values[key] = parse_bool(raw)
                elif key in _INTS:
                    values[key] = int(raw)
                elif key in _FLOATS:
                    values[key] = float(raw)
                elif key in {f.name for f in fields(EngineConfig)} - {"histograms"}:
                    values[key] = raw
                else:
                    warnings.warn(f"unknown setting {key!r}", stacklevel=2)
        elif section.lower().startswith("histogram"):
            missing = {"prefix", "min", "max", "width"} - set(options)
            if missing:
                raise ValueError(f"section {section!r} lacks {sorted(missing)}")
            hists.append(Histogram(options["prefix"].strip('"'), float(options["min"]), float(options["max"]), float(options["width"])))
        else:
            raise ValueError(f"unknown section {section!r}")
    return validate(replace(EngineConfig(), **values, histograms=tuple(hists)))


def load_ini(path: str) -> EngineConfig:
    with open(path) as f:
        return read_ini(f.read())


def with_histogram_table(c: EngineConfig, table, limit: int = 4096) -> EngineConfig:
    """Histograms from a DataFrame of (prefix, min_val, max_val, bin_width), a small configuration table."""
    rows = table.select("prefix", "min_val", "max_val", "bin_width").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many histogram prefixes")
    return validate(replace(c, histograms=tuple(Histogram(r.prefix, r.min_val, r.max_val, r.bin_width) for r in rows)))
