"""Replays of streams with keyed state and timers against plain loops, in several batches, out of order and with late rows."""

import datetime as dt
import random

import pandas as pd

from tickloom.streaming import orders
from tickloom.streaming.ticks import journal

START = dt.datetime(2024, 1, 2)
START_US = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000


def replayed(spark, tmp_path, rows, schema, build):
    """Rows by batch, each a file of its own, in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", orders.PROVIDER)
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    journal(build(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()


def at(second):
    return START + dt.timedelta(seconds=second), START_US + second * 1_000_000


def test_order_ages(spark, tmp_path):
    rng = random.Random(2)
    shown, rows = {t: set() for t in "ab"}, []
    want = set()
    for second in range(0, 400, 10):
        for ticker in "ab":
            shown[ticker] = {o for o in shown[ticker] if rng.random() < 0.7} | {rng.randrange(8)}
            rows += [(*at(second)[:1], ticker, at(second)[1], o) for o in shown[ticker]]
    first = {t: {} for t in "ab"}
    for us in sorted({r[2] for r in rows}):
        for t in "ab":
            live = {r[3] for r in rows if r[2] == us and r[1] == t}
            first[t] = {o: first[t].get(o, us) for o in live}
            want |= {(t, us, o, us - s) for o, s in first[t].items()}
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        rng.shuffle(b)
    batches += [[(START, "a", START_US, 99)], [(at(900)[0], "z", at(900)[1], 1)]]  # a row too late, and one that moves the watermark
    got = replayed(spark, tmp_path, batches, "ts timestamp, ticker string, us long, order_id long", lambda s: orders.order_ages(s, "30 seconds"))
    found = {tuple(r) for r in got}
    assert (sorted(found - want)[:3], sorted(want - found)[:3], len(got)) == ([], [], len(want))


def test_followups(spark, tmp_path):
    rng = random.Random(4)
    rows = [(*at(s)[:1], "d" if s < 300 else "e", at(s)[1], i, i % 3 == 0, float(rng.randrange(50)) if i % 7 else None) for i, s in enumerate(sorted(rng.sample(range(600), 90)))]
    horizons, want = (10, 60), set()
    for _, day, us, seq, quote, price in rows:
        for h in horizons if not quote else ():
            found = min(((q[2], q[3], q[5]) for q in rows if q[4] and q[1] == day and q[2] >= us + h * 1_000_000), default=None)
            if found:
                want.add((day, seq, h, found[1], None if price is None or found[2] is None else found[2] - price))
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for b in batches:
        rng.shuffle(b)
    batches.append([(at(2000)[0], "z", at(2000)[1], 999, True, 1.0)])
    got = replayed(spark, tmp_path, batches, "ts timestamp, day string, us long, seq long, quote boolean, price double", lambda s: orders.followups(s, horizons, "5 minutes"))
    clean = {(r.day, r.seq, r.horizon, r.quote_seq, None if r.delta is None or r.delta != r.delta else r.delta) for r in got}
    assert clean == want and len(got) == len(want)


class Kept(dict):
    """A map or list state in memory."""

    exists = dict.__len__
    getValue, updateValue, removeKey, iterator = dict.get, dict.__setitem__, dict.pop, lambda self: list(self.items())  # noqa: N815

    def get(self):
        return self["list"]

    def put(self, rows):
        self["list"] = rows

    def clear(self):
        self.pop("list", None)


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):  # noqa: N802
        return Kept()

    getListState = getMapState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_rows_of_a_key_are_handled_a_slot_at_a_time():
    """Many waiting rows of one key: a step sees one slot, and nothing is left behind in the state."""
    rng, steps = random.Random(3), []

    class Watched(orders.OrderAges):
        def step(self, key, rows):
            steps.append(rows.num_rows)
            return super().step(key, rows)

    times = [START_US + i * 21_600_000_000 for i in range(40)]
    rows = sorted({(us, rng.randrange(2000)) for us in times for _ in range(1000)}, key=lambda r: hash((r[1], r[0])))
    state, handle = Watched(), Handle()
    state.init(handle)
    frame = pd.DataFrame(rows, columns=["us", "order_id"])
    for part in (frame[:15_000], frame[15_000:]):
        state.handleInputRows(("a",), iter([part[i : i + 10_000] for i in range(0, len(part), 10_000)]), None)
    assert handle.timers == [times[0] // 1000 + 1]
    first, want = {}, set()
    for us in times[:-1]:
        live = {o for u, o in rows if u == us}
        first = {o: first.get(o, us) for o in live}
        want |= {("a", us, o, us - s) for o, s in first.items()}
    mark = type("Mark", (), {"getCurrentWatermarkInMs": lambda self: times[-1] // 1000})()
    got = [tuple(r) for df in state.handleExpiredTimer(("a",), mark, None) for r in df.itertuples(index=False)]
    assert len(got) == len(want) and set(got) == want
    assert len(steps) == 39 and max(steps) <= 1000
    assert [k for k, _ in state.slots.iterator()] == [(times[-1] // orders.SLOT_US,)] == list({(k[0],) for k, _ in state.blocks.iterator()})
    assert handle.timers == [times[-1] // 1000 + 1]


def test_an_order_without_id_is_an_order(spark, tmp_path):
    rows = [(at(s)[0], "a", at(s)[1], o) for s, live in ((0, (1, None)), (10, (None,)), (20, (1, None)), (30, (5,))) for o in live]
    got = replayed(spark, tmp_path, [rows], "ts timestamp, ticker string, us long, order_id long", lambda s: orders.order_ages(s, "0 seconds"))
    ages = {((r.us - START_US) // 1_000_000, r.order_id): r.age_us // 1_000_000 for r in got}
    assert ages == {(0, 1): 0, (0, None): 0, (10, None): 10, (20, 1): 0, (20, None): 20} and len(got) == 5
