"""Ranks, picks, running counts and mergeable drawdowns against sorted lists."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ranks
from tickloom.operators.paths import drawdowns, longest_runs


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(11)
    pool = [0.0, -0.0, 1e-12, -1e-12, 1e300, -1e300, 3.5, 3.5, 3.5, None]
    rows = [(g, i, rng.choice(pool) if rng.random() < 0.4 else rng.uniform(-1000, 1000)) for i in range(400) for g in [rng.choice("aab")]] + [("c", 900, None), ("d", 901, 7.0)]
    return rows, spark.createDataFrame(rows, "g string, i long, x double").repartition(3)


@pytest.mark.parametrize("descending", [False, True])
def test_ranked(values, descending):
    rows, df = values
    got = {r.i: (r["rank"], r.n) for r in ranks.ranked(df, ["g"], "x", ["i"], descending).collect()}
    for g in "abcd":
        mine = [r for r in rows if r[0] == g and r[2] is not None]
        mine.sort(key=lambda r: (-r[2] if descending else r[2], r[1]))
        assert [got[r[1]] for r in mine] == [(k + 1, len(mine)) for k in range(len(mine))]
    assert len(got) == sum(r[2] is not None for r in rows)


def test_picked_and_interpolated(values):
    rows, df = values
    places = {"first": F.lit(0), "middle": F.floor((F.col("n") - 1) / 2), "last": F.col("n") - 1}
    got = {r.g: r for r in ranks.picked(df, ["g"], "x", places).collect()}
    between = {r.g: r for r in ranks.interpolated(df.filter("abs(x) < 1e6 OR x IS NULL"), ["g"], "x", {"median": 0.5, "tenth": 0.1}).collect()}
    for g in "abd":
        mine = sorted(r[2] for r in rows if r[0] == g and r[2] is not None)
        assert (got[g]["first"], got[g].middle, got[g]["last"]) == (mine[0], mine[(len(mine) - 1) // 2], mine[-1])
        mine = [x for x in mine if abs(x) < 1e6]
        assert math.isclose(between[g].median, statistics.median(mine), abs_tol=1e-9)
        at = (len(mine) - 1) * 0.1
        low, high = mine[math.floor(at)], mine[math.ceil(at)]
        assert math.isclose(between[g].tenth, low + (high - low) * (at - math.floor(at)), abs_tol=1e-9)
    assert "c" not in got
    assert ranks.picked(df.limit(0), ["g"], "x", places).count() == 0


def test_slots_keep_the_order(spark):
    xs = sorted([0.0, 1e-300, -1e-300, *(s * 1.07**k for k in range(-400, 400) for s in (1, -1))])
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").select("i", ranks.slot(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 800


def test_cumulative(spark):
    rows = [(x, x % 7, 1) for x in range(-40, 90)]
    df = spark.createDataFrame(rows, "x long, a long, b long").repartition(4)
    for descending in (False, True):
        for r in ranks.cumulative(df, [], "x", ["a", "b"], descending).collect():
            mine = [q for q in rows if (q[0] >= r.x if descending else q[0] <= r.x)]
            assert (r.upto_a, r.upto_b) == (sum(q[1] for q in mine), len(mine))


def test_drawdowns_and_runs(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(60), i, rng.choice([-30, -5, 0, 4, 25])) for i in range(300) for k in [i % 4]] + [(9, 0, 1000, -50)]
    df = spark.createDataFrame(rows, "k long, day long, i long, pnl long").withColumn("won", F.col("pnl") > 0)
    downs = {r.k: r for r in drawdowns(df, ["k"], ["day", "i"], "pnl", 7).collect()}
    runs = {r.k: r for r in longest_runs(df, ["k"], ["day", "i"], "won", 7).collect()}
    for k in (0, 1, 2, 3, 9):
        at, peak, worst, longest, run, last = 0, None, 0, {True: 0, False: 0}, 0, None
        for *_, pnl in sorted(r for r in rows if r[0] == k):
            at += pnl
            peak = at if peak is None else max(peak, at)
            worst = max(worst, peak - at)
            run = run + 1 if last == (pnl > 0) else 1
            last = pnl > 0
            longest[last] = max(longest[last], run)
        assert (downs[k].total, downs[k].peak, downs[k].max_drawdown) == (at, peak, worst)
        assert (runs[k].longest_true, runs[k].longest_false) == (longest[True], longest[False])
