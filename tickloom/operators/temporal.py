"""As-of joins, averages and spacing over ordered streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.segments import PART_US, haloed, own, scan


def asof(
    left: DataFrame, right: DataFrame, on: list[str], values: list[str], name: str = "asof", lag_us: int = 0, forward: bool = False, width: int = PART_US, **more: tuple[str, str]
) -> DataFrame:
    """left with a struct ``name`` of the last right row at or before us - lag_us (forward: the first at or after).

    Both sides are stacked and the nearest right row is carried along the order, in parts of ``width`` microseconds, so
    that a busy key is spread over its parts. Forward is backward on negated times. The struct is null where no right
    row exists, and may hold nulls where the right row does. Both sides need us and seq; us must not be null. ``more``
    names further scans (kind, column) of left's own columns along the same order.
    """
    sign = -1 if forward else 1
    at = lambda us: (sign * us).cast("long").alias("_at")
    kind = right.select(F.struct(*values)).schema[0].dataType
    kept = [c for c in left.columns if c not in on]
    probe = left.select(*on, at(F.col("us") - lag_us), F.lit(1).alias("_side"), (sign * F.col("seq")).alias("_seq"), F.struct(*kept).alias("_left"), F.lit(None).cast(kind).alias("_value"))
    none = F.lit(None).cast(probe.schema["_left"].dataType).alias("_left")
    build = right.select(*on, at(F.col("us")), F.lit(0).alias("_side"), (sign * F.col("seq")).alias("_seq"), none, F.struct(*values).alias("_value"))
    scans = {n: (how, F.col(f"_left.{c}")) for n, (how, c) in more.items()}
    carried = scan(probe.union(build), on, ["_at", "_side", "_seq"], {"_last": ("last", F.col("_value"))} | scans, width)
    found = carried.filter("_left IS NOT NULL").select(*on, "_left.*", F.col("_last").alias(name), *more)
    return found.select(*left.columns, name, *more)


#: Natural logarithm of the largest weight in a part of smoothed(); weights of what a part leaves out are below exp(-45).
WEIGHTS = 300


def smoothed(rows: DataFrame, on: list[str], place: str, averages: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """rows with exponential averages (value, alpha, seed) along ``place``, which counts a key's rows from 0.

    An average is seeded with the mean of its first ``seed`` values and meaningless before them. It is a running sum of
    values weighted by powers of 1 / (1 - alpha). These grow, so rows are cut into parts in which they stay within
    doubles; a part also holds the rows of the one before it, and what is older counts for nothing in a double.
    """
    keeps = [1 - alpha for _, alpha, _ in averages.values()]
    width = math.floor(WEIGHTS / -math.log(min(keeps)))
    if width * -math.log(max(keeps)) < 45:
        raise ValueError("averages of so different lengths need calls of their own")
    cut = haloed(rows, place, width, width)
    order = Window.partitionBy(*on, "_part").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    found = {}
    for name, (value, alpha, seed) in averages.items():
        keep, at = F.lit(1 - alpha), F.col(place)
        base = F.greatest((F.col("_part") - 1) * width - (seed - 1), F.lit(0))
        age = F.greatest(at - (seed - 1), F.lit(0)) - base
        term = F.when(at < 0, F.lit(0.0)).when(at < seed, value / seed).otherwise(alpha * value * F.pow(keep, -age))
        found[name] = F.pow(keep, age) * F.sum(term).over(order)
    return own(cut.withColumns(found))


def greedy_spacing(entries: DataFrame, on: list[str], gap_us: int) -> DataFrame:
    """Of entries(us, seq) those at least gap_us after the last accepted one, per key; ties keep the lower seq.

    An entry that far from the one before it is accepted whatever came earlier, so it starts a run. Runs are folded each
    on its own: an array holds the entries of one run, not of a key.
    """
    order = Window.partitionBy(*on).orderBy("us", "seq")
    gap = F.col("us") - F.lag("us").over(order)
    begins = F.coalesce((gap >= gap_us).cast("int"), F.lit(1))
    runs = entries.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    empty = F.array().cast("array<struct<us:bigint,seq:bigint>>")
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x.us - F.element_at(acc, -1).us >= gap_us), F.concat(acc, F.array(x))).otherwise(acc)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("us").cast("long").alias("us"), F.col("seq").cast("long").alias("seq"))))
    kept = runs.groupBy(*on, "_run").agg(F.aggregate(ordered, empty, step).alias("kept"))
    return kept.select(*on, F.explode("kept").alias("e")).select(*on, "e.us", "e.seq")
