import random

from pyspark.sql import functions as F

from meterloom.llm import bitmaps

SCHEMA = "seq bigint, ts timestamp, name string, value string, type string, day string"


def messages(spark, rows):
    return spark.createDataFrame([(i, t, n, v, k, "x") for i, (t, n, v, k) in enumerate(rows)], "seq bigint, t string, name string, value string, type string, day string").select(
        "seq", F.to_timestamp("t").alias("ts"), "name", "value", "type", "day"
    )


def test_sizing():
    for n in (10, 1000, 10**6, 10**8):
        m = bitmaps.bits_for(n, 0.01)
        assert bitmaps.relative_error(n, m) <= 0.01 and n <= 9 * m
        if m > 1 << 12:
            assert bitmaps.relative_error(n, m // 2) > 0.01 or n > 9 * m // 2
    assert bitmaps.bits_for(10**15, 1e-7) > 1 << 40 and bitmaps.bits_for(1 << 62, 1e-12) == bitmaps.MOST_BITS


def brute(rows):
    out = {}
    for t, n, v, k in rows:
        p = (n or "").split(".")
        if k != "s" or len(p) != 4 or p[0] != "uniq" or not all(p) or not v or "|" in v:
            continue
        for keep in range(8):
            key = (t and t[:10], *[x if keep >> i & 1 else None for i, x in enumerate(p[1:])])
            out.setdefault(key, set()).add(v)
    return {k: len(v) for k, v in out.items()}


def test_every_combination_against_exact_counts(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(6000):
        day = rnd.choice(["2022-03-01 10:00:00", "2022-03-02 23:59:59", None])
        name = rnd.choice(["uniq.a.ios.users"] * 4 + ["uniq.b.ios.users", "uniq.a.web.carts", "uniq.a.ios", None, "other.a.b.c", "uniq.a.b.c.d"])
        rows.append((day, name, rnd.choice([None, "", "x|y", *[f"id{rnd.randrange(900)}" for _ in range(20)]]), rnd.choice(["s", "s", "s", "c", None])))
    got = {(r.day and str(r.day), r.site, r.platform, r.what): (r.estimate, r.error_bound) for r in bitmaps.distinct_counts(messages(spark, rows)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, n in want.items():
        assert abs(got[k][0] - n) <= got[k][1] * got[k][0], (k, n, got[k])


def test_partials_merge_and_fold(spark):
    rows = [("2022-03-01 00:00:00", "uniq.a.b.c", f"id{i}", "s") for i in range(3000)]
    ids = bitmaps.identifiers(messages(spark, rows))
    whole = bitmaps.build(ids, 1 << 13)
    a = bitmaps.build(ids.where("id < 'id2'"), 1 << 15)
    b = bitmaps.build(ids.where("id >= 'id15'"), 1 << 13)
    key = lambda df: sorted(map(tuple, df.select("day", "site", "word_no", "word", "bits").collect()))
    assert key(bitmaps.merge(a, b)) == key(whole)
    est = bitmaps.estimate_cube(bitmaps.merge(a, b)).where("site is null and platform is null and what is null").first()
    assert abs(est.estimate - 3000) / 3000 < est.error_bound


def test_counts_come_with_bitmaps_that_merge(spark):
    rows = [(f"2022-03-0{1 + i % 2} 00:00:00", f"uniq.{'ab'[i % 3 == 0]}.b.c", f"id{i % 700}", "s") for i in range(3000)]
    day = lambda k: bitmaps.counts_with_partials(bitmaps.bitmaps_of(messages(spark, [r for r in rows if r[0][9] in k]), bits=1 << 12))
    whole, kept = day("12"), [day("1"), day("2")]
    united = bitmaps.merge(*map(bitmaps.partials_in, kept))
    key = lambda df: sorted(map(str, df.select("day", *bitmaps.DIMS, "word_no", "word", "bits").collect()))
    assert key(united) == key(bitmaps.partials_in(whole)) and united.count()
    counts = lambda df: sorted(map(str, df.select("day", *bitmaps.DIMS, "estimate", "error_bound").collect()))
    assert counts(whole.where("word is null")) == counts(bitmaps.estimate_cube(united))


def test_nothing(spark):
    assert bitmaps.counts_with_partials(bitmaps.bitmaps_of(messages(spark, [("2022-03-01 00:00:00", "a", "b", "c")]))).count() == 0
    assert bitmaps.distinct_counts(messages(spark, [("2022-03-01 00:00:00", "a", "b", "c")])).count() == 0
