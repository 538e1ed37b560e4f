"""Keyed state over event time: ages of visible orders, and follow-ups at due times.

Rows wait in a key's state until the watermark has passed them, and are then handled in event order, whatever order they
came in. One event-time timer per key stands at its earliest waiting row. So a stream gives what a batch over the same
rows gives, but for rows that came later than the watermark allows.

Waiting rows are kept as Arrow blocks by slots of time, and one slot is read, handled and forgotten after the other, so
that Python never holds more than a slot of a key, however many rows wait.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

#: Keyed state with timers is kept in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Length of a slot in microseconds, and rows that are collected in Python before they go to their slots' blocks.
SLOT_US, FLUSH_ROWS = 900_000_000, 200_000


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class InOrder(StatefulProcessor):
    """Hands rows of a key, an Arrow table with us, to step() in event order once the watermark has passed them.

    step() gets the rows of one slot of time at a time, sorted; begin() and end() stand around the slots of a timer.
    """

    def __init__(self, waiting: pa.Schema, order: list[str]):
        self.schema, self.order = waiting, [(c, "ascending") for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Of each slot the next block's number and its earliest row's time, and the blocks.
        self.slots = handle.getMapState("slots", _longs("slot"), _longs("blocks", "first"))
        self.blocks = handle.getMapState("blocks", _longs("slot", "block"), StructType([StructField("rows", BinaryType())]))

    def begin(self) -> None:
        pass

    def step(self, key: tuple, rows: pa.Table) -> pd.DataFrame | None:
        raise NotImplementedError

    def end(self) -> None:
        pass

    def _known(self) -> dict[int, tuple[int, int]]:
        return {k[0]: tuple(v) for k, v in self.slots.iterator()} if self.slots.exists() else {}

    def _wake(self, known: dict[int, tuple[int, int]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if known:
            self.handle.registerTimer(known[min(known)][1] // 1000 + 1)

    def _keep(self, rows: pa.Table, known: dict[int, tuple[int, int]]) -> None:
        """Adds a block to each slot that the rows touch."""
        us = rows["us"].to_numpy()
        places = np.argsort(us // SLOT_US, kind="stable")
        slots, starts = np.unique(us[places] // SLOT_US, return_index=True)
        rows, us = rows.take(pa.array(places)), us[places]
        for slot, start, stop in zip(slots.tolist(), starts, [*starts[1:], len(us)], strict=True):
            number, first = known.get(slot, (0, us[start].item()))
            self.blocks.updateValue((slot, number), (_packed(rows.slice(start, stop - start)),))
            known[slot] = number + 1, min(first, us[start:stop].min().item())
            self.slots.updateValue((slot,), known[slot])

    def _take(self, slot: int, blocks: int) -> pa.Table:
        """The rows of a slot, which forgets them."""
        tables = []
        for number in range(blocks):
            tables.append(pa.ipc.open_stream(self.blocks.getValue((slot, number))[0]).read_all())
            self.blocks.removeKey((slot, number))
        self.slots.removeKey((slot,))
        return pa.concat_tables(tables)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, held, size = self._known(), [], 0
        for df in rows:
            held.append(pa.Table.from_pandas(df[self.schema.names], self.schema, preserve_index=False).replace_schema_metadata())
            size += len(df)
            if size >= FLUSH_ROWS:
                self._keep(pa.concat_tables(held), known)
                held, size = [], 0
        if size:
            self._keep(pa.concat_tables(held), known)
        self._wake(known)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        self.begin()
        for slot in sorted(s for s, (_, first) in known.items() if first // 1000 < mark):
            rows = self._take(slot, known.pop(slot)[0])
            passed = rows["us"].to_numpy() // 1000 < mark
            if not passed.all():
                self._keep(rows.filter(pa.array(~passed)), known)
                rows = rows.filter(pa.array(passed))
            out = self.step(key, rows.sort_by(self.order))
            if out is not None and len(out):
                yield out
        self.end()
        self._wake(known)

    def close(self) -> None:
        pass


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class OrderAges(InOrder):
    """Rows of one ticker: us is the snapshot's time, order_id an order that it shows. An order that a snapshot doesn't show is gone."""

    def __init__(self):
        super().__init__(pa.schema({"us": pa.int64(), "order_id": pa.int64()}), ["us", "order_id"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getListState("seen", _longs("order_id", "us"))

    def begin(self) -> None:
        """The orders of the last snapshot, in order, and since when each has been visible."""
        seen = np.array([tuple(r) for r in self.seen.get()] if self.seen.exists() else [], np.int64).reshape(-1, 2)
        self.live, self.since = seen.T

    def step(self, key: tuple, rows: pa.Table) -> pd.DataFrame | None:
        us, orders = rows["us"].to_numpy(), rows["order_id"].to_numpy()
        starts = np.flatnonzero(np.diff(us, prepend=us[0] - 1))
        out = []
        for start, stop in zip(starts, [*starts[1:], len(us)], strict=True):
            shown = np.unique(orders[start:stop])
            since = np.full(len(shown), us[start])
            _, new, old = np.intersect1d(shown, self.live, assume_unique=True, return_indices=True)
            since[new] = self.since[old]
            self.live, self.since = shown, since
            out.append(pd.DataFrame({"ticker": key[0], "us": us[start], "order_id": shown, "age_us": us[start] - since}))
        return pd.concat(out)

    def end(self) -> None:
        self.seen.put(list(zip(self.live.tolist(), self.since.tolist(), strict=True)))


def order_ages(snapshots: DataFrame, late: str) -> DataFrame:
    """How long each order of snapshots(ts, ticker, us, order_id) has been visible without a snapshot that lacks it.

    A snapshot is final, and comes out, once the watermark on ts has passed it; ts and us are the same time. A null
    order_id is an order like others; within the state it is the least whole number.
    """
    none = F.lit(-(1 << 63)).cast("long")
    rows = snapshots.select("ts", "ticker", "us", F.coalesce(F.col("order_id").cast("long"), none).alias("order_id")).withWatermark("ts", late)
    ages = rows.groupBy("ticker").transformWithStateInPandas(OrderAges(), "ticker string, us long, order_id long, age_us long", "Append", "EventTime")
    return ages.withColumn("order_id", F.nullif("order_id", none))


class Followups(InOrder):
    """Rows of one day: trades wait for the first quote at or after each of their due times."""

    output = ["day", "seq", "horizon", "quote_seq", "delta"]

    def __init__(self, horizons: tuple[int, ...]):
        super().__init__(pa.schema({"us": pa.int64(), "seq": pa.int64(), "quote": pa.bool_(), "price": pa.float64()}), ["us", "seq"])
        self.horizons = horizons

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", StructType([*_longs("due", "seq", "horizon"), StructField("price", DoubleType())]))

    def begin(self) -> None:
        self.due = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        heapq.heapify(self.due)

    def step(self, key: tuple, rows: pa.Table) -> pd.DataFrame | None:
        due, out = self.due, []
        for us, seq, quote, price in zip(*(rows[c].to_pylist() for c in ("us", "seq", "quote", "price")), strict=True):
            for h in self.horizons if not quote else ():
                heapq.heappush(due, (us + h * 1_000_000, seq, h, price))
            while quote and due and due[0][0] <= us:
                _, s, h, p = heapq.heappop(due)
                out.append((key[0], s, h, seq, None if price is None or p is None else price - p))
        return pd.DataFrame(out, columns=self.output)

    def end(self) -> None:
        if self.due:
            self.open.put(self.due)
        else:
            self.open.clear()


def followups(ticks: DataFrame, horizons: tuple[int, ...], late: str) -> DataFrame:
    """The first quote of the day at or after each due time of every trade of ticks(ts, day, us, seq, quote, price).

    What a trade waits for is state of its day, and comes out once the watermark has passed the quote that answers it;
    due times that no quote of the day answers give no row.
    """
    rows = ticks.select("ts", "day", "us", "seq", "quote", "price").withWatermark("ts", late)
    return rows.groupBy("day").transformWithStateInPandas(Followups(horizons), "day string, seq long, horizon long, quote_seq long, delta double", "Append", "EventTime")
