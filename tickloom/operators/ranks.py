"""Ranks, quantiles and counts below a value over groups of any size.

A value's slot is a step of its logarithm, so that slots follow from values alone and keep their order. Slots are
counted, their counts are summed up in order (a row for each group and slot), and rows are ranked within their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots for each step of the natural logarithm.
FINENESS = 64


def slot(value: Column) -> Column:
    """A whole number that never falls as the value rises; of nulls null. NaN is the largest, as in Spark's order."""
    number = value.cast("double")
    size = F.floor(F.log1p(F.abs(number)) * FINENESS)
    return F.when(F.isnan(number), F.lit(1 << 40)).otherwise(F.when(number < 0, -size - 1).otherwise(size)).cast("long")


def ranked(rows: DataFrame, on: list[str], value: str, ties: list[str], descending: bool = False) -> DataFrame:
    """rows whose value isn't null with rank (from 1, ties in the order of ``ties``) and n, the rows of their group."""
    known = rows.filter(F.col(value).isNotNull()).withColumn("_slot", -slot(F.col(value)) if descending else slot(F.col(value)))
    starts = slot_starts(known.groupBy(*on, "_slot").agg(F.count("*").alias("_m")), on)
    first = F.desc(value) if descending else F.asc(value)
    inside = F.row_number().over(Window.partitionBy(*on, "_slot").orderBy(first, *ties))
    return known.withColumn("rank", inside).join(starts, [*on, "_slot"]).withColumn("rank", F.col("rank") + F.col("_start")).drop("_slot", "_start", "_m")


def slot_starts(slots: DataFrame, on: list[str]) -> DataFrame:
    """slots(on, _slot, _m) with _start, what is in lower slots, and n, what is in all of the group."""
    group = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumns({"_start": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(group)})


def picked(rows: DataFrame, on: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """A row for each group with its elements at ``places``: columns over n, the number of values, counting from 0.

    Only the slots that hold a wanted place are looked into.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*on, F.col(value).alias("_value"), slot(F.col(value)).alias("_slot"))
    starts = slot_starts(known.groupBy(*on, "_slot").agg(F.count("*").alias("_m")), on)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items()))
    held = F.filter(wanted, lambda w: (w["at"] >= F.col("_start")) & (w["at"] < F.col("_start") + F.col("_m")))
    inside = starts.withColumn("_wanted", held).filter(F.size("_wanted") > 0)
    values = known.groupBy(*on, "_slot", "_value").agg(F.count("*").alias("_k")).join(inside, [*on, "_slot"])
    upto = F.sum("_k").over(Window.partitionBy(*on, "_slot").orderBy("_value"))
    values = values.withColumn("_upto", F.col("_start") + upto)
    hits = values.withColumn("_w", F.explode("_wanted")).filter((F.col("_w.at") < F.col("_upto")) & (F.col("_w.at") >= F.col("_upto") - F.col("_k")))
    found = [F.max(F.when(F.col("_w.name") == name, F.col("_value"))).alias(name) for name in places]
    return hits.groupBy(*on).agg(*found) if on else hits.agg(*found)


def interpolated(rows: DataFrame, on: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles between the two elements around (n - 1) * share, as percentile() and median() give them."""
    n = F.col("n") - 1
    places = {f"_{side}{name}": edge(n * share) for name, share in shares.items() for side, edge in (("low", F.floor), ("high", F.ceil))}
    sizes = rows.groupBy(*on).agg(F.count(value).alias("n"))
    found = picked(rows, on, value, places).join(sizes, on)
    columns = {}
    for name, share in shares.items():
        low, high, part = F.col(f"_low{name}"), F.col(f"_high{name}"), n * share - F.floor(n * share)
        columns[name] = low + (high - low) * part
    return found.select(*on, *(c.cast("double").alias(name) for name, c in columns.items()))


def cumulative(counts: DataFrame, on: list[str], value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """counts, a row for each group and value, with upto_<c>: each sum over this and lower (or higher) values."""
    cut = counts.withColumn("_slot", -slot(F.col(value)) if descending else slot(F.col(value)))
    few = cut.groupBy(*on, "_slot").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    group = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    few = few.select(*on, "_slot", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    here = Window.partitionBy(*on, "_slot").orderBy(F.desc(value) if descending else F.asc(value))
    local = cut.withColumns({f"upto_{c}": F.sum(c).over(here) for c in sums})
    return local.join(few, [*on, "_slot"]).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_{c}") for c in sums}).drop("_slot", *(f"_{c}" for c in sums))
