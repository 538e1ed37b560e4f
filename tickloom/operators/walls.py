"""Size near a price over a trailing window of the book, without a pair of a touch and each state of the book."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _carried(updates: DataFrame, width: int) -> DataFrame:
    """What each slot holds before the part that precedes ``_part``, as an update one microsecond earlier; few rows a part."""
    ends = updates.filter("slot >= 0").groupBy("day", "slot", F.floor(F.col("us") / width).alias("_q")).agg(F.max(F.struct("us", "seq", "px", "sz")).alias("x"))
    following = F.lead("_q").over(Window.partitionBy("day", "slot").orderBy("_q"))
    last = F.max("_q").over(Window.partitionBy("day"))
    # an end is what part q + 2 starts with, and all later ones up to that after the slot's next end
    parts = F.sequence(F.col("_q") + 2, F.least(F.coalesce(F.col("_next") + 1, F.col("_last")), F.col("_last")))
    held = ends.withColumns({"_next": following, "_last": last}).filter(F.col("_q") + 2 <= F.col("_last")).withColumn("_part", F.explode(parts))
    return held.select("day", "_part", ((F.col("_part") - 1) * width - 1).alias("us"), F.lit(-1).cast("long").alias("seq"), "slot", "x.px", "x.sz")


def walls(touches: DataFrame, updates: DataFrame, depths: int, reach: float, seconds: int, factor: tuple[int, int]) -> DataFrame:
    """touches(seq, band, day, us, price, upper) with n, wall, total and often of the book after each update of [us - seconds, us].

    A wall is the size of the slots whose price is 0 to ``reach`` beyond the touch's: asks above an upper touch, bids below
    a lower one. Of these there are n, the last, their sum, and how many times factor[0] are above factor[1] times the mean.
    updates(day, us, seq, side, depth, px, sz) have a null price and size where a slot is emptied; those of
    no side or depth leave the book as it is, and count as a state. Touches without an update
    in their window are left out.

    Touches are shuffled to parts of a day as long as the window; updates go to their own part and the next one. The book
    is rebuilt there from what slots held before. The work is a touch times the states of its window, in memory that
    grows with the updates of two parts only.
    """
    width = seconds * 1_000_000
    slot = F.when(F.col("side").isin(0, 1) & F.col("depth").between(1, depths), F.col("side") * depths + F.col("depth") - 1)
    u = updates.select("day", "us", "seq", F.coalesce(slot, F.lit(-1)).cast("int").alias("slot"), F.col("px").cast("double").alias("px"), F.col("sz").cast("long").alias("sz"))
    u = u.filter("day IS NOT NULL AND us IS NOT NULL")
    part = F.floor(F.col("us") / width)
    seen = u.withColumn("_part", F.explode(F.array(part, part + 1))).select("day", "_part", "us", "seq", "slot", "px", "sz").unionByName(_carried(u, width))
    given = touches.filter("day IS NOT NULL AND us IS NOT NULL").select("day", part.alias("_part"), "seq", "band", "us", "price", "upper")
    schema = "seq long, band int, n long, wall long, total long, often long"
    names = ["seq", "band", "n", "wall", "total", "often"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("us", "ascending"), ("seq", "ascending")])
        us, slot, px = (right[c].to_numpy() for c in ("us", "slot", "px"))
        sz = right["sz"].fill_null(0).to_numpy()
        price, upper, until = (left[c].to_numpy() for c in ("price", "upper", "us"))
        begin, end = np.searchsorted(us, until - width), np.searchsorted(us, until, "right")
        found = np.zeros((4, len(until)), np.int64)
        for above in (True, False):
            rows = np.flatnonzero((upper == above) & (end > begin))
            if not rows.size:
                continue
            # where each slot of the side was last set, at every state of the book
            at = np.stack([np.maximum.accumulate(np.where(slot == s, np.arange(len(us)), -1)) for s in range(depths * above, depths * (1 + above))])
            book_px, book_sz = np.where(at >= 0, px[at], np.nan), np.where(at >= 0, sz[at], 0)
            for i in rows:
                away = book_px[:, begin[i] : end[i]] - price[i]
                away = away if above else -away
                wall = (book_sz[:, begin[i] : end[i]] * ((away >= 0) & (away <= reach))).sum(axis=0)
                total = int(wall.sum())
                found[:, i] = len(wall), wall[-1], total, np.count_nonzero(factor[0] * wall > factor[1] * (total / len(wall)))
        there = pa.array(found[0] > 0)
        return pa.Table.from_arrays([left["seq"], left["band"], *map(pa.array, found)], names).filter(there)

    return given.groupBy("day", "_part").cogroup(seen.groupBy("day", "_part")).applyInArrow(run, schema)
