"""Value areas of growing profiles against a profile built anew for every event."""

import random

import numpy as np

from tickloom.operators.profile import area, value_areas

PRINTS, EVENTS = "day string, us long, level long, volume long", "day string, us long, id long"


def anew(prints, day, us):
    volumes = {}
    for d, at, level, volume in prints:
        if d == day and us is not None and at <= us:
            volumes[level] = volumes.get(level, 0) + volume
    if not sum(volumes.values()):
        return None, None, None
    levels = sorted(volumes)
    low = high = top = max(range(len(levels)), key=lambda i: (volumes[levels[i]], -i))
    while 10 * sum(volumes[x] for x in levels[low : high + 1]) < 7 * sum(volumes.values()):
        below = volumes[levels[low - 1]] if low else -1
        above = volumes[levels[high + 1]] if high + 1 < len(levels) else -1
        low, high = (low, high + 1) if above > below else (low - 1, high)
    return levels[top], levels[low], levels[high]


def test_areas_equal_profiles_built_anew(spark):
    random.seed(3)
    for span, volumes in ((400, (1, 2, 3)), (40, (0, 1, 1, 500))):
        prints = [(random.choice("aab"), random.randrange(span), random.randrange(-8, 9) ** 3 // 40, random.choice(volumes)) for _ in range(600)]
        events = [(random.choice("abc"), random.randrange(-5, span + 30), i % 150) for i in range(160)]
        events += events[:5]
        for width in (7, 100, 10_000):
            found = value_areas(spark.createDataFrame(prints, PRINTS), spark.createDataFrame(events, EVENTS), ["day"], width).collect()
            got = sorted((r.day, r.us, r.id, (r.poc, r.val, r.vah)) for r in found)
            assert [x[:3] for x in got] == sorted(events)
            wrong = [(x, anew(prints, *x[:2])) for x in got if x[3] != anew(prints, *x[:2])]
            assert not wrong


def test_nulls_are_left_out_and_empty_tables_work(spark):
    prints = spark.createDataFrame([("a", 1, 5, 2), ("a", None, 5, 2), ("a", 1, None, 2), ("a", 1, 7, None), (None, 1, 7, 9)], PRINTS)
    events = spark.createDataFrame([("a", 3, None), ("a", None, 1), (None, 3, 2)], EVENTS)
    assert [tuple(r) for r in value_areas(prints, events, ["day"]).collect()] == [("a", 3, None, 5, 5, 5)]
    assert value_areas(prints, events.limit(0), ["day"]).count() == 0
    assert [tuple(r) for r in value_areas(prints.limit(0), events, ["day"]).collect()] == [("a", 3, None, None, None, None)]


def test_area_goes_down_on_a_tie():
    assert area(np.array([1, 2, 3]), np.array([2, 5, 2])) == (2, 1, 2)
    assert area(np.array([1, 2, 3]), np.array([1, 5, 2])) == (2, 2, 3)
    assert area(np.array([4]), np.array([0])) is None
