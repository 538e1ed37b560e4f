"""First hits and last prints after events, without a pair of an event and each print that follows it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Least length of a bucket of time in seconds, so that sparse tables don't fall into very many groups.
LEAST_WIDTH = 10_800
#: ``after`` of events that look at prints from their own time on, and of those that look at later times only.
SAME_TIME, LATER = -(1 << 63), (1 << 63) - 1


class Peaks:
    """Extremes over halves of halves of a sequence, to find the first value from a place on that passes a test."""

    def __init__(self, values: np.ndarray, fold: np.ufunc, empty: float):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = np.full(2 * self.size, empty)
        self.tree[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            self.tree[level >> 1 : level] = fold(self.tree[level : 2 * level : 2], self.tree[level + 1 : 2 * level : 2])
            level >>= 1

    def first(self, start: np.ndarray, passes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Places of the first values from start on that pass, a place behind the last value where there is none.

        ``passes`` takes values and the queries that they are compared for; an extreme passes if one of its values does.
        """
        found = np.full(len(start), self.size)
        which = np.flatnonzero(start < self.size)
        at = start[which] + self.size
        while which.size:
            at = at // (at & -at)
            hit = passes(self.tree[at], which)
            asked, node = which[hit], at[hit]
            while (inner := np.flatnonzero(node < self.size)).size:
                left = 2 * node[inner]
                node[inner] = left + ~passes(self.tree[left], asked[inner])
            found[asked] = node - self.size
            which, at = which[~hit], at[~hit] + 1
            more = (at & -at) != at
            which, at = which[more], at[more]
        return found


def follow(events: DataFrame, prints: DataFrame, seconds: int, hits: dict[str, tuple[int, str, float]], lasts: dict[str, int], after: Column | int = SAME_TIME) -> DataFrame:
    """events(day, us, price, d) with a struct (at, at_seq, px) for each of ``hits`` and ``lasts``, null where there is none.

    prints(day, us, seq, price) of an event's day count from (us, after) on up to us + seconds, both ends included. A hit
    (sign, op, amount) is the first print whose gain, sign * d * (px - price), is >= or <= amount, with NaN as the
    largest value; d is 1 or -1. A last is the latest print within that many seconds. Events without a day or time are
    left out.

    Events are shuffled once to their day and a bucket of time, and prints to the buckets that look at them. A bucket is at
    least twice as long as the reach, so that at most half of the prints are there twice; there a search over extremes
    takes steps as the logarithm of its prints.
    """
    reach, width = seconds * 1_000_000, max(2 * seconds, LEAST_WIDTH) * 1_000_000
    bucket = F.floor(F.col("us") / width)
    given = events.withColumn("_after", F.lit(after).cast("long")).withColumn("_bucket", bucket).filter("day IS NOT NULL AND us IS NOT NULL")
    seen = prints.filter("day IS NOT NULL AND us IS NOT NULL").select(
        "day", F.explode(F.sequence(F.floor((F.col("us") - reach) / width), bucket)).alias("_bucket"), F.col("us").alias("at"), F.col("seq").alias("at_seq"), F.col("price").cast("double").alias("px")
    )
    kinds = {"at": LongType(), "at_seq": LongType(), "px": DoubleType()}
    schema = StructType([*events.schema.fields, *(StructField(f"_{n}_{c}", kind) for n in [*hits, *lasts] for c, kind in kinds.items())])
    kept = events.columns

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("at", "ascending"), ("at_seq", "ascending")])
        at, seq, px, unknown = (x.to_numpy() for x in (right["at"], right["at_seq"], right["px"], right["px"].is_null()))
        us, later = left["us"].to_numpy(), left["_after"].to_numpy()
        d, price = (left[c].cast(pa.float64()).to_numpy() for c in ("d", "price"))
        known = ~left["price"].is_null().to_numpy()
        # events come before prints of the same time and seq, so that they count what is earlier
        order = np.lexsort((np.r_[np.zeros(len(us)), np.ones(len(at))], np.r_[later, seq], np.r_[us, at]))
        start = np.empty(len(us), np.int64)
        mine = order < len(us)
        start[order[mine]] = np.cumsum(~mine)[mine]
        end = np.searchsorted(at, us + reach, "right")
        columns = [left[c] for c in kept]

        def add(place: np.ndarray, there: np.ndarray) -> None:
            columns.extend(right[c].take(pa.array(place, mask=~there)) for c in kinds)

        peaks = {}
        for sign, op, amount in hits.values():
            place, there = np.zeros(len(us), np.int64), np.zeros(len(us), bool)
            for way in (1, -1):
                rows = np.flatnonzero(known & (sign * d == way))
                if not rows.size:
                    continue
                if (way, op) not in peaks:
                    values = np.where(unknown | (np.isnan(px) if op == "<=" else False), -np.inf if op == ">=" else np.inf, way * px)
                    peaks[way, op] = Peaks(values, np.maximum if op == ">=" else np.minimum, -np.inf if op == ">=" else np.inf)
                base = way * price[rows]
                passes = (lambda x, i, b=base, m=amount: ~(x - b[i] < m)) if op == ">=" else (lambda x, i, b=base, m=amount: x - b[i] <= m)
                place[rows] = peaks[way, op].first(start[rows], passes)
                there[rows] = place[rows] < end[rows]
            add(place, there)
        for within in lasts.values():
            place = np.searchsorted(at, us + within * 1_000_000, "right") - 1
            add(place, place >= start)
        return pa.Table.from_arrays(columns, schema.names)

    done = given.groupBy("day", "_bucket").cogroup(seen.groupBy("day", "_bucket")).applyInArrow(run, schema)
    point = lambda n: F.when(F.col(f"_{n}_at").isNotNull(), F.struct(*(F.col(f"_{n}_{c}").alias(c) for c in kinds))).alias(n)
    return done.select(*kept, *map(point, [*hits, *lasts]))
