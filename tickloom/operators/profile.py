"""Volume profiles that grow along the prints, and the area around the busiest level at given moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.segments import PART_US

#: Share of the volume, in tenths, that an area holds.
TENTHS = 7


def area(levels: np.ndarray, volumes: np.ndarray) -> tuple[int, int, int] | None:
    """Busiest level (the lowest of several), lowest and highest of the range around it with 70% of the volume.

    levels ascend. The range grows to the side with more volume, down where both have the same; None without volume.
    """
    total = int(volumes.sum())
    if total <= 0:
        return None
    low = high = int(volumes.argmax())
    covered = int(volumes[low])
    while 10 * covered < TENTHS * total:
        below = int(volumes[low - 1]) if low > 0 else -1
        above = int(volumes[high + 1]) if high + 1 < len(volumes) else -1
        if above > below:
            high, covered = high + 1, covered + above
        else:
            low, covered = low - 1, covered + below
    return int(levels[volumes.argmax()]), int(levels[low]), int(levels[high])


def value_areas(prints: DataFrame, events: DataFrame, on: list[str], width: int = PART_US // 4) -> DataFrame:
    """events with poc, val and vah of all prints at or before each; null where there is none with volume.

    prints(*on, us, level, volume) and events(*on, us, ...) have whole numbers without nulls; on, level and volume of a
    print with a null in them are left out, as are events with a null key or time. Volumes aren't negative. Equal events
    all stay; prints at an event's own time count.

    Prints are summed up by moment and level. A key's time is cut into parts; every part that may hold an event starts
    from the running sums of the parts before it, one row a level, so that a task holds the levels and one part's prints,
    not a day. Within a part the profile is one array that the prints are added to in order.
    """
    keep, parts = events.columns, [*on, "_part"]
    part = F.floor(F.col("us") / width).alias("_part")
    asked = events.dropna(subset=[*on, "us"]).select("*", part, F.lit(2).alias("_kind"), F.col("us").alias("_at"))
    moments = prints.dropna(subset=[*on, "us", "level", "volume"]).groupBy(*on, "us", "level").agg(F.sum("volume").cast("long").alias("_volume"))
    moments = moments.select(*on, part, F.lit(1).alias("_kind"), F.col("us").alias("_at"), F.col("level").cast("long").alias("_level"), "_volume")
    needed = asked.groupBy(*on).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last"))
    ends = moments.groupBy(*parts, "_level").agg(F.sum("_volume").alias("_volume"))
    by_level = "PARTITION BY " + ", ".join(f"`{c}`" for c in [*on, "_level"]) + " ORDER BY _part"
    grown = ends.join(needed, on).withColumns({"_volume": F.expr(f"sum(_volume) OVER ({by_level})"), "_until": F.expr(f"coalesce(lead(_part) OVER ({by_level}), _last)")})
    grown = grown.withColumn("_from", F.greatest(F.col("_part") + 1, F.col("_first"))).filter("_from <= least(_until, _last)")
    base = grown.select(*on, F.explode(F.sequence("_from", F.least("_until", "_last"))).alias("_part"), F.lit(0).alias("_kind"), "_level", "_volume")
    rows = base.unionByName(moments, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("_kind").to_numpy()
        wanted, traded = table.filter(pa.array(kind == 2)), table.filter(pa.array(kind < 2))
        level, volume, at = (np.asarray(traded.column(c).fill_null(0)) for c in ("_level", "_volume", "_at"))
        started = kind[kind < 2] == 0
        # what earlier parts hold comes before every print of this one
        order = np.lexsort((at, ~started))
        level, volume, at, begun = level[order], volume[order], at[order], int(started.sum())
        levels, place = np.unique(level, return_inverse=True)
        sums, seen, done = np.zeros(len(levels), np.int64), np.zeros(len(levels), bool), 0
        times = np.asarray(wanted.column("_at"))
        found: list[tuple[int, int, int] | None] = [None] * len(times)
        for i in np.argsort(times, kind="stable"):
            now = begun + int(np.searchsorted(at[begun:], times[i], side="right"))
            np.add.at(sums, place[done:now], volume[done:now])
            seen[place[done:now]] = True
            done = now
            found[i] = area(levels[seen], sums[seen])
        made = wanted.select(keep)
        for j, name in enumerate(("poc", "val", "vah")):
            made = made.append_column(name, pa.array([x and x[j] for x in found], pa.int64()))
        return made

    schema = events.withColumns({n: F.lit(None).cast("long") for n in ("poc", "val", "vah")}).schema
    return rows.groupBy(*parts).applyInArrow(run, schema)
