"""Path, fold and book operators on small rows with known answers."""

import random

from pyspark.sql import functions as F

from tickloom.functions.exprs import chunks
from tickloom.operators import paths
from tickloom.operators.book import look_up, sweep
from tickloom.operators.temporal import asof

SECOND = 1_000_000


def test_exits_take_the_first_of_target_stop_and_time(spark):
    prints = spark.createDataFrame([("d", s * SECOND, s, p) for s, p in ((0, 10.0), (1, 11.0), (2, 8.0), (3, 13.0), (9, 12.5), (11, 20.0))] + [("e", 0, 20, 99.0)], "day string, us long, seq long, price double")
    events = spark.createDataFrame([("a", "d", 0, 10.0), ("b", "d", 3 * SECOND, 13.0), ("c", "d", 2 * SECOND, 8.0)], "id string, day string, us long, price double")
    found = paths.exits(paths.ahead(events, prints, 7), ["id"], F.col("px") - F.col("price"), 3, 2).collect()
    assert sorted(map(tuple, found)) == [("a", "stop", 2 * SECOND, -2.0), ("b", "time", 9 * SECOND, -0.5), ("c", "target", 3 * SECOND, 3.0)]
    assert paths.exits(paths.ahead(events.limit(0), prints, 7), ["id"], F.col("px"), 3, 2).count() == 0


def test_lockout_starts_after_the_last_exit(spark):
    rows = [("k", 0, 1, 10), ("k", 10, 2, 12), ("k", 11, 3, 30), ("k", 20, 4, 21), ("m", 5, 5, 6)]
    kept = paths.lockout(spark.createDataFrame(rows, "key string, us long, seq long, exit_us long"), ["key"])
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 5]


def test_positions_run_over_the_whole_table(spark):
    rows = [(i % 7, (i * 37) % 50) for i in range(50)]
    found = paths.positions(spark.createDataFrame(rows, "day int, id int"), "day", ["id"]).collect()
    assert [(r.day, r.id) for r in sorted(found, key=lambda r: r.i)] == sorted(rows)
    assert sorted(r.i for r in found) == list(range(50)) and {r.n for r in found} == {50}


def test_nearest_quantile_picks_elements(spark):
    values = [5.0, 1.0, 1.0, 9.0, None, 7.0, 3.0]
    frame = spark.createDataFrame([("g", x) for x in values] + [("none", None)], "g string, x double")
    found = {r.g: (r.q10, r.q50, r.q90) for r in paths.nearest_quantile(frame, ["g"], "x", [10, 50, 90]).collect()}
    ordered = sorted(x for x in values if x is not None)
    assert found == {"g": tuple(ordered[(5 * q + 50) // 100] for q in (10, 50, 90))}


def test_draws_are_the_same_arithmetic(spark):
    def plain(*parts):
        x = 12345
        for part in parts:
            x = ((x + part) * 1103515245 + 12345) % 2**31
            x ^= x // 65536
        return x

    rows = spark.range(50).select("id", paths.draw(F.lit(3), F.col("id")).alias("x")).collect()
    assert [r.x for r in rows] == [plain(3, r.id) for r in rows]


def test_asof_carries_nulls_of_the_right_row(spark):
    left = spark.createDataFrame([("d", 5, 1), ("d", 10, 2), ("d", 1, 3)], "day string, us long, seq long")
    right = spark.createDataFrame([("d", 2, 1, 7.0), ("d", 9, 2, None)], "day string, us long, seq long, v double")
    found = {r.seq: r.q for r in asof(left, right, ["day"], ["v"], "q").collect()}
    assert found[1].v == 7.0 and found[2].v is None and found[2] is not None and found[3] is None


def test_golden_ladder_and_chunks(spark):
    levels = [(1, "m", 10.00, 10_000), (2, "m", 10.01, 10_000), (3, "m", 10.02, 10_000)]
    r = sweep(spark.createDataFrame(levels, "level_id int, venue string, price double, qty long"), ["venue"], 25_000).first()
    assert (r.used, r.vwap, r.worst, r.covered) == (25_000, 10.008, 10.02, True)
    found = spark.range(1).select(chunks(F.lit(72_000), 25_000).alias("a"), chunks(F.lit(74_000), 10_000).alias("b")).first()
    assert found.a == [25_000, 25_000, 22_000] and found.b == [10_000] * 7 + [4_000]


LEVELS = "venue string, side string, level_id long, cents long, qty long"


def test_blocks_of_any_size_find_their_price(spark):
    levels = spark.createDataFrame([("v", "bid", 1, 1000, 10), ("v", "bid", 2, 990, 10), ("v", "bid", 3, 995, 0)], LEVELS)
    sizes = (0, 1, 10, 11, 20, 21, None, 11)
    rows = [(i, "v", "bid", q) for i, q in enumerate(sizes)] + [(9, "w", "bid", 1), (10, None, "bid", 1), (3, "v", "bid", 11)]
    blocks = spark.createDataFrame(rows, "id long, venue string, side string, q long")
    found = look_up(levels, blocks, ["venue", "side"], {"x": F.col("q")}).collect()
    got = sorted((r.id, r.x.filled, r.x.paid, r.x.covered) for r in found)
    eleven = (11, 10990, True)
    assert got == [(0, 0, 0, True), (1, 1, 1000, True), (2, 10, 10000, True), (3, *eleven), (3, *eleven), (4, 20, 19900, True), (5, 20, 19900, False), (7, *eleven)]
    assert look_up(levels.limit(0), blocks, ["venue", "side"], {"x": F.col("q")}).count() == 0
    assert look_up(levels, blocks.limit(0), ["venue", "side"], {"x": F.col("q")}).count() == 0


def test_look_up_equals_walking_every_ladder(spark):
    import random

    random.seed(7)
    levels = [(v, s, i, random.randrange(90, 110), random.randrange(0, 6)) for i, (v, s) in enumerate((v, s) for v in "ab" for s in ("ask", "bid") for _ in range(40))]
    blocks = [(i, random.choice("aab"), random.choice(("ask", "bid")), random.randrange(1, 160), random.randrange(85, 115)) for i in range(400)]

    def walked(venue, side, quantity, limit):
        filled = paid = within = worst = 0
        named = 0.0
        sign = 1 if side == "ask" else -1
        for _, _, i, cents, qty in sorted((x for x in levels if x[:2] == (venue, side)), key=lambda x: (sign * x[3], x[2])):
            within += qty if sign * cents <= sign * limit else 0
            take = min(qty, quantity - filled)
            if take > 0:
                filled, paid, worst, named = filled + take, paid + take * cents, cents, named + take * (i % 3) / qty
        return filled, paid, worst, filled >= quantity, round(named, 9), within

    made = spark.createDataFrame(blocks, "id long, venue string, side string, q long, cents long")
    got = look_up(spark.createDataFrame(levels, LEVELS), made, ["venue", "side"], {"x": F.col("q"), "half": F.floor(F.col("q") / 2)}, {"within": F.col("cents")}, {"named": F.col("level_id") % 3})
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(blocks)
    for i, venue, side, q, limit in blocks:
        r = found[i]
        assert (r.x.filled, r.x.paid, r.x.worst, r.x.covered, round(r.x.named, 9), r.within) == walked(venue, side, q, limit)
        assert r.q < 2 or (r.half.filled, r.half.paid) == walked(venue, side, q // 2, limit)[:2]


def test_look_up_shuffles_blocks_once_and_pairs_none_with_levels(spark):
    levels = spark.createDataFrame([("v", "bid", 1, 1000, 10)], LEVELS)
    blocks = spark.createDataFrame([(1, "v", "bid", 5, 900)], "id long, venue string, side string, q long, cents long")
    plan = look_up(levels, blocks, ["venue", "side"], {"x": F.col("q")}, {"y": F.col("cents")})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_spacing_and_lockout_by_runs_equal_plain_loops(spark):
    import random

    from tickloom.operators.paths import lockout
    from tickloom.operators.temporal import greedy_spacing

    random.seed(5)
    rows = [(k, random.randrange(300), i, random.randrange(1, 40)) for i in range(400) for k in [i % 3]]
    trades = spark.createDataFrame([(k, u, i, u + h) for k, u, i, h in rows], "key long, us long, seq long, exit_us long")
    spaced, locked = set(), set()
    for key in range(3):
        last = until = None
        for u, i, h in sorted((u, i, h) for k, u, i, h in rows if k == key):
            if last is None or u - last >= 10:
                spaced.add((key, i))
                last = u
            if until is None or u > until:
                locked.add((key, i))
                until = u + h
    assert {(r.key, r.seq) for r in greedy_spacing(trades, ["key"], 10).collect()} == spaced
    assert {(r.key, r.seq) for r in lockout(trades, ["key"]).collect()} == locked


def test_smoothed_equals_recursion(spark):
    """20,000 rows: weights stay finite because parts start anew."""
    from tickloom.operators.temporal import smoothed

    values = [float((i * 37) % 101) for i in range(20_000)]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "key long, i long, x double")
    for alpha, seed in ((1 / 14, 1), (1 / 14, 14), (2 / 10, 1), (0.9, 3)):
        want = sum(values[:seed]) / seed
        got = {r.i: r.y for r in smoothed(frame, ["key"], "i", {"y": (F.col("x"), alpha, seed)}).select("i", "y").collect()}
        assert len(got) == len(values)
        for i in range(seed - 1, len(values)):
            if i >= seed:
                want += (values[i] - want) * alpha
            assert abs(got[i] - want) < 1e-6


def test_outlook_sorts_no_lists(spark, monkeypatch):
    """What the as-of read sorts, a row for each event and reach and one for each print, has no list of buckets; and no print is lost."""
    rng, seen = random.Random(8), []
    prints = [("d", rng.randrange(0, 40_000), i, float(rng.randrange(60))) for i in range(300)]
    asof = paths.asof
    monkeypatch.setattr(paths, "asof", lambda left, right, *a, **k: seen.extend([*left.dtypes, *right.dtypes]) or asof(left, right, *a, **k))
    df = spark.createDataFrame(prints, "day string, us long, seq long, price double")
    got = paths.outlook(df.filter("seq % 5 = 0"), df, ["us"], [700, 1500, 9000]).collect()
    assert seen and not [c for c, kind in seen if "array" in kind]
    want = set()
    for _, us, seq, _ in prints[::5]:
        for reach in (700, 1500, 9000):
            held = [p for _, u, _, p in prints if us <= u < us + reach]
            want.add((seq, reach, len(held), max(held), min(held)))
    assert {(r.seq, r.reach, r.n, r.high, r.low) for r in got} == want and len(got) == len(want)
