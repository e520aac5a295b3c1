"""Grids, hot keys, rejected rows and implausible readings against brute force, with the awkward cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom.operators import badrows, gridfill, hotkeys, spikes

READINGS = "rec_id bigint, key string, ts bigint, val double, slot string, n string"


# ---- grids


def brute_grid(rows, step=60):
    by = {}
    for rec, key, ts, val in rows:
        if key is not None and ts is not None and val is not None and not math.isnan(val):
            by.setdefault(key, {}).setdefault(ts // step, []).append((ts, rec, val))
    out = []
    for key, slots in by.items():
        last = None
        for s in range(min(slots), max(slots) + 1):
            here = sorted(slots.get(s, []))
            last = here[-1][2] if here else last
            out.append((key, s * step, last, len(here), not here))
    return sorted(out)


@pytest.mark.parametrize("shard_slots", [1, 7, 360])
def test_grid_against_brute_force(spark, shard_slots):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice([None, *[rnd.randrange(0, 90_000) for _ in range(30)]]), rnd.choice([1.5, math.nan, None, math.inf, -2.0, float(i)])) for i in range(400)]
    rows += rows[:50]
    rows += [(9000, "far", 0, 1.0), (9001, "far", 500_000, 2.0), (9002, "one", 77, 5.0), (9003, "neg", -61, 1.0), (9004, "neg", 200, 2.0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], READINGS)
    got = sorted((r.key, r.slot, r.val, r.n, r.gap) for r in gridfill.regular_grid(df, shard_slots=shard_slots).select("key", "slot", "val", "n", "gap").collect())
    assert got == brute_grid(rows)


def test_grid_fills(spark):
    df = spark.createDataFrame([(1, "a", 0, 10.0, "", ""), (2, "a", 240, 50.0, "", "")], READINGS)
    val = lambda fill: [r.val for r in gridfill.regular_grid(df, fill=fill, shard_slots=2).orderBy("slot").collect()]
    assert val("linear") == [10.0, 20.0, 30.0, 40.0, 50.0]
    assert val("mark") == [10.0, None, None, None, 50.0]
    assert val("locf") == [10.0, 10.0, 10.0, 10.0, 50.0]
    with pytest.raises(ValueError):
        val("other")


def test_grid_of_nothing(spark):
    assert gridfill.regular_grid(spark.createDataFrame([], READINGS)).count() == 0


# ---- hot keys


def test_heavy_hitters_exactly(spark):
    rows = [("hot",)] * 333 + [(f"k{i % 97}",) for i in range(500)] + [(None,)] * 134 + [("edge",)] * 33
    df = spark.createDataFrame(rows, "name string")
    got = {(r.hot_key, r.n, r.total) for r in hotkeys.heavy_hitters(df, "name", 0.033).collect()}
    assert got == {("hot", 333, 1000), ("edge", 33, 1000)}


@pytest.mark.parametrize(("share", "total"), [(0.03, 700), (0.07, 300), (0.29, 100), (0.57, 100)])
def test_a_key_at_exactly_the_share_is_hot(spark, share, total):
    n = round(share * total)
    df = spark.createDataFrame([("tie",)] * n + [(f"k{i}",) for i in range(total - n)], "name string")
    assert [r.hot_key for r in hotkeys.heavy_hitters(df, "name", share).collect()] == ["tie"]


def test_shares_too_small_for_a_sketch_are_counted(spark):
    rows = [("a",)] * 50 + [("b",)] * 30 + [(f"k{i}",) for i in range(20)] + [(None,)] * 100
    got = hotkeys.heavy_hitters(spark.createDataFrame(rows, "name string"), "name", 1e-6).collect()
    assert len(got) == 22 and {(r.hot_key, r.n, r.total) for r in got} >= {("a", 50, 200), ("b", 30, 200)}
    assert hotkeys.heavy_hitters(spark.createDataFrame([], "name string"), "name", 1e-6).count() == 0


def test_heavy_hitters_of_nothing(spark):
    assert hotkeys.heavy_hitters(spark.createDataFrame([], "name string"), "name").count() == 0
    assert hotkeys.heavy_hitters(spark.createDataFrame([(None,)] * 5, "name string"), "name").count() == 0


def test_split_aggregate_matches_group_by(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice([None, f"k{rnd.randrange(60)}"]), rnd.choice([None, f"v{rnd.randrange(40)}"]), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, what string, n double")
    partial = {"rows": F.count(F.lit(1)), "different": F.count_distinct("what"), "top": F.max("n")}
    want = df.groupBy("key").agg(*[c.alias(n) for n, c in partial.items()])
    for share in (0.03, None, 0.0003):
        got = hotkeys.split_aggregate(df, "key", partial, {"rows": F.sum, "different": F.sum, "top": F.max}, share, salts=8, salt_on=["what"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert hotkeys.split_aggregate(df.limit(0), "key", partial, {"rows": F.sum, "different": F.sum, "top": F.max}).count() == 0


# ---- rows that fail to parse

GOOD = [("a", "1", "c", None), ("a b/é", "-1.5e3", "c", "0.5"), ("x", "m:1", "s", None), ("x", "+7", "g", None), ("ü", "1", "g", None), ("n", "1e-400", "g", None), ("q", "1", "ms", "1e-2")]
BAD = [
    ((None, "1", "c", None), "name missing"), (("  ", "1", "c", None), "name blank"), (("", "1", "c", None), "name blank"), (("a:b", "1", "c", None), "name has a colon"),
    (("a", "1", "x", None), "type unknown"), (("a", "1", None, None), "type unknown"), (("a", None, "c", None), "value missing"), (("a", "", "s", None), "value empty"),
    (("a", "x|y", "s", None), "set member has a bar"), (("a", " 1", "c", None), "value is no number"), (("a", "1.", "c", None), "value is no number"), (("a", ".5", "c", None), "value is no number"),
    (("a", "1_0", "c", None), "value is no number"), (("a", "٣", "c", None), "value is no number"), (("a", "nan", "c", None), "value is no number"), (("a", "1e400", "c", None), "value not finite"),
    (("a", "1\n", "c", None), "value is no number"), (("a", "1", "g", "0.5"), "rate not allowed for type"), (("a", "1", "c", ""), "rate is no number"), (("a", "1", "c", "0"), "rate out of range"),
    (("a", "1", "c", "1.01"), "rate out of range"), (("a", "1", "c", "-0.5"), "rate out of range"), (("a", "1", "c", "0,5"), "rate is no number"), (("a", "1", "c", "~"), "rate is no number"),
]


def test_reasons():
    assert [badrows.diagnose(*g) for g in GOOD] == [None] * len(GOOD)
    assert [(b, badrows.diagnose(*b)) for b, _ in BAD] == BAD


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('1,a,2,c,"1.0"', None), ('"1",a,"line one\nline two",s,', None), ('1,"a ""q"" b",2,g,', None), ('1,"a,b",2,c,', None), ("1,a,2,c,", None),
        ("1,a,2,c", "too few fields"), ("", "too few fields"), ("1,a,2,c,,", "too many fields"), ('1,a,2,c,"0.5', "quote not closed"), ('1,"a"b,2,c,', "text after closing quote"), ('1,a"b,2,c,', "quote inside unquoted field"),
        (" 1,a,2,c,", "time is not digits"), ("-1,a,2,c,", "time is not digits"), (None, "line missing"), (",a,2,c,", "time is not digits"), ("١,a,2,c,", "time is not digits"),
    ],
)
def test_lines(line, want):
    assert badrows.split_line(line)[1] == want


FIELD = st.one_of(st.none(), st.sampled_from(["a", "", " ", "x:y", "1", "-2.5", "1e400", "+3", "c", "g", "s", "ms", "kv", "0.5", "1.5", "~", "\x1f", "a\nb", "|", "é"]), st.text(max_size=4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(FIELD, FIELD, FIELD, FIELD), max_size=40), st.integers(1, 9))
def test_bisection_agrees_with_the_strict_parser(rows, block):
    cols = [pa.array(range(len(rows)), pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in range(4)]]
    b = pa.RecordBatch.from_arrays(cols, names=["row_id", "name", "value", "type", "samplerate"])
    key = lambda r: (r["row_id"], r["reason"], r["name"], r["type"], r["number"], r["member"], r["rate"])
    got = sorted((key(r) for x in badrows.judge_messages(b, block) for r in x.to_pylist()), key=lambda r: r[0])
    assert got == [badrows._strict(i, n, v, t, r) for i, (n, v, t, r) in enumerate(rows)]


def test_only_failing_records_are_diagnosed(monkeypatch):
    n = 10_000
    rows = [(i, None if i % 125 == 0 else f"n{i}", "1e999" if i % 1000 == 7 else "1.5", "c", None) for i in range(n)]
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.string()] * 4))], names=["row_id", "name", "value", "type", "samplerate"])
    seen = []
    strict = badrows._strict
    monkeypatch.setattr(badrows, "_strict", lambda *r: seen.append(r[0]) or strict(*r))
    out = pa.Table.from_batches(badrows.judge_messages(b, 1024))
    assert out.num_rows == n and sorted(seen) == [i for i in range(n) if i % 125 == 0 or i % 1000 == 7]


PIECE = st.sampled_from(['"', ",", "\n", "\r", "1", "a", "c", "s", "0.5", '""', " ", "1,a,2,c,", "﻿"])

LINE = st.one_of(st.none(), st.lists(PIECE, max_size=8).map("".join), st.sampled_from(["1,a,2,c,", '1,"a,b","x\ny",s,', '"2",a,3,ms,0.5', '1,a,2,g,"']))


@settings(max_examples=80, deadline=None)
@given(st.lists(LINE, max_size=30), st.integers(1, 12))
def test_line_bisection_agrees_with_the_strict_parser(rows, block):
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["row_id", "line"])
    got = sorted((tuple(r.values()) for x in badrows.judge_lines(b, block) for r in x.to_pylist()), key=lambda r: r[0])
    assert got == [badrows._strict_line(i, x) for i, x in enumerate(rows)]


def test_parse_frames(spark):
    rows = [(i, *r, "other") for i, r in enumerate([*GOOD, *[b for b, _ in BAD], ("long", "y" * 200_000, "s", None)])]
    df = spark.createDataFrame(rows, "seq bigint, name string, value string, type string, samplerate string, reason string")
    out = badrows.parse_messages(df, block=4)
    assert out.count() == len(rows)
    assert {(r.row_id, r.reason) for r in badrows.rejected_rows(out).collect()} == {(len(GOOD) + i, why) for i, (_, why) in enumerate(BAD)}
    valid = {r.row_id: r for r in badrows.valid_rows(out).collect()}
    assert valid[1].number == -1500.0 and valid[1].rate == 0.5 and valid[2].member == "m:1" and len(valid[len(rows) - 1].member) == 200_000
    assert badrows.parse_messages(df.limit(0)).count() == 0
    assert badrows.parse_spool(spark.createDataFrame([], "line_id bigint, line string")).count() == 0


# ---- implausible readings


def wave(n, seed=1, noise=1.0, level=100.0):
    rnd = np.random.default_rng(seed)
    x, out = 0.0, []
    for _ in range(n):
        x = 0.9 * x + rnd.normal(0, noise)
        out.append(level + x)
    return np.round(out, 3)


P = spikes.ChartParams()


def codes(v, low=-math.inf, high=math.inf):
    return spikes.judge(np.asarray(v, float), low, high, P).tolist()


def test_quiet_source_has_no_cases():
    assert not any(codes(wave(2000)))


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("at", [5, 300, 990])
def test_spike_is_found(width, at):
    v = wave(1000)
    v[at : at + width] += 60
    assert np.flatnonzero(codes(v)).tolist() == list(range(at, at + width))


def test_level_change_is_no_case():
    v = wave(1000)
    v[500:] += 60
    assert not any(codes(v))


def test_limits_and_infinities():
    v = wave(200)
    v[50], v[60], v[70] = -999, math.inf, -math.inf
    assert np.flatnonzero(codes(v, 0.0, 200.0)).tolist() == [50, 60, 70]
    assert np.flatnonzero(codes(v)).tolist() == [50, 60, 70]


def test_frozen_stretch():
    v = wave(400)
    v[100:112] = v[100]
    v[200:211] = v[200]
    assert [i for i, c in enumerate(codes(v)) if c == 2] == list(range(100, 112))


def test_source_that_repeats_by_nature_is_not_frozen():
    v = np.repeat(np.round(wave(60), 0), 20)
    assert 2 not in codes(v)
    assert not any(codes([5.0] * 50))
    assert codes([]) == [] and codes([1.0]) == [0]


def test_flags_on_frames(spark):
    rows, rec = [], 0
    want = set()
    for k, n in (("s.a.b.temp", 9000), ("s.a.c.temp", 500), ("s.a.d.ph", 60)):
        v = wave(n, seed=n)
        bad = {n // 2: 300.0, n // 3: -500.0}
        for i, x in enumerate(v):
            x = float(x) + bad.get(i, 0.0)
            for _ in range(3 if i in bad else 1):
                rows.append((rec, k, 60 * i, x))
                if i in bad:
                    want.add(rec)
                rec += 1
    rows += [(rec, None, 5, 1.0), (rec + 1, "s.a.b.temp", None, 1.0), (rec + 2, "s.a.b.temp", 7, None), (rec + 3, "s.a.b.temp", 8, math.nan)]
    df = spark.createDataFrame(rows, "rec_id bigint, key string, ts bigint, val double")
    kinds = spark.createDataFrame([("temp", 0.0, None), ("other", None, 5.0), (None, None, None)], "kind string, low double, high double")
    for shard_rows in (4096, 1000):
        got = spikes.flag_records(df, kinds, spikes.ChartParams(shard_rows=shard_rows)).collect()
        assert {r.rec_id for r in got} == want and len(got) == len(want)
    reasons = {r.reason for r in spikes.flag_records(df, kinds).collect()}
    assert reasons == {"limit", "spike"}
    assert spikes.flag_records(df.limit(0), kinds).count() == 0


def test_frozen_over_whole_shards_is_flagged(spark):
    rnd = random.Random(4)
    n, a, b = 4000, 900, 3300
    rows = [(i, "web.busy.latency", i, 5.0 if a <= i < b else round(rnd.uniform(1, 9), 6)) for i in range(n)]
    # a source that repeats its readings as a whole, but not in every shard
    rows += [(n + i, "web.coarse.latency", i, 3.0 if 1500 <= i < 1530 else float(rnd.randrange(1000) if 1400 < i < 1700 else rnd.randrange(2))) for i in range(n)]
    df = spark.createDataFrame(rows, "rec_id bigint, key string, ts bigint, val double")
    kinds = spark.createDataFrame([("latency", None, None)], "kind string, low double, high double")
    for shard_rows in (4096, 256):
        got = spikes.flag_records(df, kinds, spikes.ChartParams(shard_rows=shard_rows)).where("reason = 'frozen'").collect()
        assert {r.rec_id for r in got} == set(range(a, b)), shard_rows


@pytest.mark.parametrize("shard_rows", [100_000, 4096, 700])
def test_half_of_a_large_source_frozen(spark, shard_rows):
    rnd = np.random.default_rng(2)
    n, a, b = 20_000, 6_000, 16_000
    v = np.round(rnd.normal(50, 2, n), 6)
    v[a:b] = 50.0
    df = spark.createDataFrame([(i, "one.source.load", i, float(x)) for i, x in enumerate(v)], "rec_id bigint, key string, ts bigint, val double")
    kinds = spark.createDataFrame([], "kind string, low double, high double")
    got = spikes.flag_records(df, kinds, spikes.ChartParams(shard_rows=shard_rows)).collect()
    assert {r.rec_id for r in got} == set(range(a, b)) and {r.reason for r in got} == {"frozen"}


def test_shards_are_cut_by_readings_not_by_time(spark):
    """A source that sends nearly everything in one stretch of its time is spread all the same."""
    n = 20_000
    df = spark.createDataFrame([("burst", i if i < n - 1 else 10**8, float(i % 7)) for i in range(n)], "key string, ts bigint, val double")
    cut = spikes._cut(df, spikes.ChartParams(shard_rows=1000))
    sizes = [r["count"] for r in cut.groupBy("_shard").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1016 and len(sizes) == 20
    assert spikes._with_context(cut).where("not own").groupBy("shard").count().agg(F.max("count")).first()[0] <= 2 * (125 + 16)


def test_clipped_values_hardly_move_the_chart():
    v = wave(600, noise=0.5)
    v[300:303] += 500
    assert np.flatnonzero(codes(v)).tolist() == [300, 301, 302]
    # two spikes close together are both seen
    v[306] -= 400
    assert np.flatnonzero(codes(v)).tolist() == [300, 301, 302, 306]


def test_what_does_not_come_back_is_no_spike():
    v = wave(300)
    v[-2:] += 80
    assert not any(codes(v))
    # down to a new level by way of a deeper reading
    v = wave(300)
    v[150:] -= 40
    v[150] -= 15
    assert not any(codes(v))
    v = wave(300)
    v[0] += 80
    assert np.flatnonzero(codes(v)).tolist() == [0]


def generated_source(rnd, kind, n):
    """Readings of a source, and the size of their usual variation."""
    if kind == "steady":
        return 50 + rnd.normal(0, 1, n), 1.0
    if kind == "wandering":
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = 0.98 * x[i - 1] + rnd.normal(0, 1)
        return 200 + x, 1.0
    if kind == "daily":
        return 20 + 8 * np.sin(np.arange(n) / 40) + rnd.normal(0, 0.7, n), 0.7
    if kind == "steps":
        return 300 + np.repeat(rnd.normal(0, 15, n // 100 + 1), 100)[:n] + rnd.normal(0, 1.5, n), 1.5
    return np.exp(rnd.normal(4, 0.35, n)), 21.0


@pytest.mark.parametrize("kind", ["steady", "wandering", "daily", "steps", "heavy"])
def test_held_out_spikes_of_generated_sources(kind):
    """Recall and precision on sources and spikes drawn anew: 1 to 3 readings, 15 to 40 times the usual variation away."""
    hits = wrong = missed = 0
    for seed in range(40):
        rnd = np.random.default_rng(seed)
        n = int(rnd.integers(150, 1500))
        v, usual = generated_source(rnd, kind, n)
        truth = np.zeros(n, bool)
        for at in rnd.choice(np.arange(5, n - 8), max(1, n // 150), replace=False):
            width = int(rnd.integers(1, 4))
            if not truth[max(0, at - 8) : at + width + 8].any():
                v[at : at + width] += rnd.choice([1] if kind == "heavy" else [-1, 1]) * usual * rnd.uniform(15, 40)
                truth[at : at + width] = True
        got = np.array(codes(np.round(v, 4))) == 3
        hits, wrong, missed = hits + (got & truth).sum(), wrong + (got & ~truth).sum(), missed + (~got & truth).sum()
    assert hits / (hits + missed) >= 0.98 and hits / (hits + wrong) >= 0.99, (hits, wrong, missed)
