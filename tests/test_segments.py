"""Scans, trailing windows and looks ahead against plain loops, with ties, gaps, nulls and many parts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.operators import segments as op
from tickloom.operators.paths import outlook
from tickloom.operators.temporal import asof

SECOND = 1_000_000


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(9)
    rows, seq = [], 0
    for day in ("a", "b"):
        us = 0
        for _ in range(160):
            us += rng.choice([0, 1, 5, 20, 90]) * SECOND
            rows.append((day, us, seq, rng.choice([None, *range(-3, 9)]), rng.randrange(1, 5)))
            seq += 1
    df = spark.createDataFrame(rows, "day string, us long, seq long, x long, volume long").repartition(3)
    return rows, df


def test_scans_of_all_kinds(ticks):
    rows, df = ticks
    x = F.col("x")
    kinds = ["sum", "count", "max", "min", "last", "previous", "lag"]
    got = {r.seq: r for r in op.scan(df, ["day"], ["us", "seq"], {k: (k, x) for k in kinds}, 60 * SECOND).collect()}
    sums = {r.seq: r for r in op.scan(df, ["day"], ["us", "seq"], {"sum": ("sum", x), "count": ("count", x)}, 60 * SECOND).collect()}
    assert len(got) == len(rows)
    for day in ("a", "b"):
        seen, all_seen = [], []
        for _, _, seq, value, _ in sorted(r for r in rows if r[0] == day):
            before, lag = (seen[-1] if seen else None), (all_seen[-1] if all_seen else None)
            all_seen.append(value)
            seen += [value] if value is not None else []
            want = (sum(seen) if seen else None, len(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None, before, lag)
            assert tuple(got[seq][k] for k in kinds) == want
            assert (sums[seq]["sum"], sums[seq]["count"]) == want[:2]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_over_parts(ticks, spark, forward):
    rows, df = ticks
    right = [("a", us, i, i if i % 4 else None) for i, us in enumerate(range(0, 4000 * SECOND, 70 * SECOND))] + [("a", 140 * SECOND, 900, 900)]
    quotes = spark.createDataFrame(right, "day string, us long, seq long, v long")
    got = {r.seq: r.q for r in asof(df, quotes, ["day"], ["v"], "q", lag_us=3 * SECOND, forward=forward, width=50 * SECOND).collect()}
    for day, us, seq, _, _ in rows:
        at = us - 3 * SECOND
        near = [(u, i, v) for d, u, i, v in right if d == day and (u >= at if forward else u <= at)]
        found = (min(near) if forward else max(near)) if near else None
        assert (got[seq] is None) == (found is None) and (found is None or got[seq].v == found[2])


def test_trailing_windows(ticks):
    rows, df = ticks
    on, seconds = ["day"], 40
    d = op.numbered(op.haloed(df, "us", seconds * SECOND), on)
    d = d.withColumn("change", F.when(F.col("_i") > 1, F.col("volume") - F.lag("volume").over(op.Window.partitionBy("day", "_part").orderBy("us", "seq"))))
    d = d.withColumns({"total": op.trailing_sum(F.col("x"), on, seconds), "n": op.trailing_sum(F.lit(1), on, seconds),
                       "inner": op.trailing_changes(F.col("change"), on, seconds), "first": op.trailing_first(F.col("volume"), on, seconds)})
    big = op.whole(F.col("volume").cast("double"), 0.5)
    d = d.withColumns({"s": op.trailing_sum(big, on, seconds), "q": op.trailing_sum(big * big, on, seconds)})
    got = {r.seq: r for r in op.own(d).withColumn("sd", op.deviation(F.col("n"), F.col("s"), F.col("q"), 0.5)).collect()}
    assert len(got) == len(rows)
    for day, us, seq, _, _ in rows:
        window = sorted(r for r in rows if r[0] == day and us - seconds * SECOND <= r[1] <= us)
        volumes = [r[4] for r in window]
        r = got[seq]
        assert (r.total, r.n, r.inner, r["first"]) == (sum(v[3] or 0 for v in window), len(window), volumes[-1] - volumes[0], volumes[0])
        assert (r.sd is None) == (len(window) < 2) and (r.sd is None or abs(r.sd - statistics.stdev(volumes)) < 1e-12)


def extremes(window):
    known = [r[3] for r in window if r[3] is not None]
    return len(window), max(known, default=None), min(known, default=None)


def test_next_extremes(ticks):
    rows, df = ticks
    for seconds in (7, 100):
        got = {r.seq: r for r in op.next_extremes(df, ["day"], "x", seconds * SECOND).collect()}
        assert len(got) == len(rows)
        for day, us, seq, _, _ in rows:
            window = [r for r in rows if r[0] == day and us <= r[1] < us + seconds * SECOND]
            assert (got[seq].n, got[seq].high, got[seq].low) == extremes(window)


def test_outlook(ticks):
    rows, df = ticks
    reaches = [10, 45, 100, 700]
    prints = df.select("day", "us", "seq", F.col("x").alias("price"))
    got = outlook(df.filter("seq % 3 = 0").withColumn("id", F.col("seq") * 2), prints, ["id"], [r * SECOND for r in reaches]).collect()
    assert len(got) == 4 * len([r for r in rows if r[2] % 3 == 0])
    by = {r[2]: r for r in rows}
    for r in got:
        day, us = by[r.seq][:2]
        window = sorted(x for x in rows if x[0] == day and us <= x[1] < us + r.reach)
        assert (r.id, r.n, r.high, r.low, r.at_end) == (2 * r.seq, *extremes(window), window[-1][3])


def test_empty_tables(ticks):
    _, df = ticks
    none = df.limit(0)
    assert op.scan(none, ["day"], ["us", "seq"], {"y": ("last", F.col("x"))}).count() == 0
    assert op.next_extremes(none, ["day"], "x", SECOND).count() == 0
    assert asof(df, none, ["day"], ["x"], "q").filter("q IS NOT NULL").count() == 0
