"""First hits and last prints against plain loops over all pairs."""

import math
import random

from pyspark.sql import functions as F

from tickloom.operators.follow import LATER, SAME_TIME, follow

HITS = {"up": (1, ">=", 3.0), "down": (-1, ">=", 3.0), "lost": (1, "<=", -2.0)}
LASTS = {"near": 40, "far": 90}


def test_follow_equals_a_loop_over_all_pairs(spark):
    rng = random.Random(5)
    second = 1_000_000
    prices = [None, math.nan, math.inf, *[x / 2 for x in range(200, 216)] * 2]
    prints = [("a" if i % 9 else "b", 10_700 * second + rng.randrange(0, 300) * second, i, rng.choice(prices)) for i in range(400)]
    events = [(i, day, us, rng.choice([None, *[x / 2 for x in range(200, 216)]]), rng.choice([1, -1]), rng.randrange(0, 400)) for i, (day, us, _, _) in enumerate(prints[:150])]
    events += [(900, "c", 5, 1.0, 1, 0), (901, None, 5, 1.0, 1, 0), (902, "a", None, 1.0, 1, 0)]
    p = spark.createDataFrame(prints, "day string, us long, seq long, price double")
    e = spark.createDataFrame(events, "id long, day string, us long, price double, d int, mine long")
    for after, start in ((SAME_TIME, lambda r: -1), (LATER, lambda r: math.inf), (F.col("mine"), lambda r: r[5])):
        got = {r["id"]: r for r in follow(e, p, 90, HITS, LASTS, after).collect()}
        assert set(got) == {r[0] for r in events if r[1] is not None and r[2] is not None}
        for r in events:
            if r[0] not in got:
                continue
            path = sorted((us, seq, px) for day, us, seq, px in prints if day == r[1] and (us, seq) >= (r[2], start(r)) and us <= r[2] + 90 * second)
            for name, (sign, op, amount) in HITS.items():
                hit = None
                for us, seq, px in path:
                    if px is None or r[3] is None:
                        continue
                    gain = sign * r[4] * (px - r[3])
                    if (gain >= amount or math.isnan(gain)) if op == ">=" else gain <= amount:
                        hit = (us, seq)
                        break
                assert (got[r[0]][name] and tuple(got[r[0]][name])[:2]) == hit, (r, name)
            for name, within in LASTS.items():
                last = max(((us, seq) for us, seq, _ in path if us <= r[2] + within * second), default=None)
                assert (got[r[0]][name] and tuple(got[r[0]][name])[:2]) == last, (r, name)


def test_no_event_is_paired_with_its_path(spark):
    """A thousand entries and prints of one second would be a million pairs; no operator of the plan puts out more than it takes."""
    import tickloom.plans.research as research
    from tickloom.plans import market, strategy

    sf = "/root/testdata/sf0.001"
    for query in (research.exit_simulation, market.first_passage, strategy.refined_entry):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "_bucket#" in plan
        assert not [line for line in plan.splitlines() if "Join" in line and ("at#" in line or "_bucket" in line)]
