"""Walls at touches against a loop over all states of the book."""

import random

from tickloom.operators.walls import walls


def test_walls_equal_a_loop_over_all_states(spark):
    rng = random.Random(3)
    second, seconds, depths = 1_000_000, 50, 3
    updates = []
    for i in range(300):
        gone = rng.random() < 0.2
        side, depth = rng.choice([0, 1]), rng.choice([None, 0, 1, 2, 3, 4])
        # a gap of several windows, over which the book is carried
        at = rng.randrange(0, 200) if i % 3 else rng.randrange(600, 700)
        updates.append(("a" if i % 7 else "b", at * second, i, side, depth, None if gone else rng.randrange(90, 110) / 2, None if gone else rng.randrange(1, 9)))
    touches = [(i, 1, u[0], u[1], rng.randrange(90, 110) / 2, bool(i % 2)) for i, u in enumerate(updates[::2])] + [(999, 1, "a", 450 * second, 50.0, True), (998, 1, None, 5, 50.0, True)]
    u = spark.createDataFrame(updates, "day string, us long, seq long, side int, depth int, px double, sz long")
    t = spark.createDataFrame(touches, "seq long, band int, day string, us long, price double, upper boolean")
    plan = walls(t, u, depths, 2.0, seconds, (4, 5))
    got = {r["seq"]: tuple(r)[2:] for r in plan.collect()}
    want = {}
    for seq, _, day, us, price, upper in touches:
        book, states = {}, []
        for _, at, _, side, depth, px, sz in sorted((x for x in updates if x[0] == day and x[1] <= us), key=lambda x: x[1:3]):
            book[side, depth] = (px, sz)
            if at >= us - seconds * second:
                near = [s for (b, d), (p, s) in book.items() if b == int(upper) and d in range(1, depths + 1) and p is not None and 0 <= (p - price if upper else price - p) <= 2.0]
                states.append(sum(near))
        if states:
            want[seq] = (len(states), states[-1], sum(states), sum(4 * s > 5 * sum(states) / len(states) for s in states))
    assert got == want
    # touches and states are grouped, not joined
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
