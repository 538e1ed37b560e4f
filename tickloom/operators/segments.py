"""Scans and windows over long keys, cut into parts of time so that no task holds a whole day.

A scan runs within each part; what a part ends with is one row, these rows are scanned in order, and what comes before a
part is joined to its rows. A trailing window copies the rows near a part's start into it and takes the difference of
two running sums, so that a row costs the same however long its window is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Length of a part in microseconds, and in rows where order is by position.
PART_US, PART_ROWS = 3_600_000_000, 100_000


def scan(rows: DataFrame, on: list[str], order: list[str], scans: dict[str, tuple[str, Column]], width: int = PART_US) -> DataFrame:
    """rows with running values along ``order``, each row's own included, per key; keys and order must not be null.

    ``scans`` names what to add: ("sum", c), ("count", c) of values that aren't null, ("max", c), ("min", c), ("last", c)
    of values that aren't null, ("previous", c), the same before the row, or ("lag", c), whatever the row before has.
    Parts are ``width`` long in the first column of order.

    Totals of sums and extremes come from a hash aggregate of the rows. Where a last value is asked for, the last row of
    every part is taken from the sorted parts themselves, with all columns, so that Spark reuses their exchange.
    """
    parts = [*on, "_part"]
    here = Window.partitionBy(*parts).orderBy(*order)
    upto, until = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    cut = rows.withColumn("_part", F.floor(F.col(order[0]) / width))
    local: dict[str, Column] = {}
    ends: dict[str, Column] = {}
    for name, (kind, c) in scans.items():
        if kind in plain:
            local[f"_{name}"] = plain[kind](c).over(upto)
            ends[f"_{name}_in"] = plain["sum" if kind == "count" else kind](f"_{name}").over(before)
            continue
        value = F.struct(c.alias("x")) if kind == "lag" else F.when(c.isNotNull(), F.struct(c.alias("x")))
        frame = upto if kind == "last" else until
        local[f"_{name}"] = F.lag(value).over(here) if kind == "lag" else F.last(value, ignorenulls=True).over(frame)
        if kind != "last":
            local[f"_{name}_end"] = value if kind == "lag" else F.last(value, ignorenulls=True).over(upto)
        ends[f"_{name}_in"] = F.last(f"_{name}" if kind == "last" else f"_{name}_end", ignorenulls=True).over(before)
    if all(kind in plain for kind, _ in scans.values()):
        run = cut.withColumns(local)
        last = cut.groupBy(*parts).agg(*(plain[kind](c).alias(f"_{name}") for name, (kind, c) in scans.items()))
    else:
        run = cut.withColumns(local | {"_more": F.lead(F.lit(True)).over(here)})
        whole_row = F.max(F.struct(*order, *(c for c in rows.columns if c not in order), *local)).alias("_end")
        last = run.filter("_more IS NULL").groupBy(*parts).agg(whole_row).select(*parts, *(f"_end.{c}" for c in local))
    carried = last.select(*parts, *(c.alias(n) for n, c in ends.items()))
    done: dict[str, Column] = {}
    for name, (kind, _) in scans.items():
        own, earlier = F.col(f"_{name}"), F.col(f"_{name}_in")
        if kind in ("max", "min"):
            done[name] = (F.greatest if kind == "max" else F.least)(own, earlier)
        else:
            done[name] = F.coalesce(own + earlier, own, earlier) if kind in plain else F.coalesce(own, earlier)["x"]
    return run.join(carried, parts, "left").select(*rows.columns, *(c.alias(n) for n, c in done.items()))


def haloed(rows: DataFrame, along: str, reach: int, width: int | None = None) -> DataFrame:
    """rows with _part and _own: each in its own part, and again (_own false) in later parts whose windows reach back to it.

    Parts are ``width`` long in ``along``, four times the reach unless told otherwise, so that a quarter is copied.
    """
    width = max(width or 4 * reach, reach)
    first, last = F.floor(F.col(along) / width), F.floor((F.col(along) + reach) / width)
    return rows.withColumn("_part", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_part") == first)


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_part", "_own")


def upto(on: list[str], back: int = 0, along: str = "us") -> WindowSpec:
    """All rows of the part at or before now - back. Such a frame only grows, so that a row is added to it once."""
    return Window.partitionBy(*on, "_part").orderBy(along).rangeBetween(Window.unboundedPreceding, -back)


def trailing_sum(c: Column, on: list[str], seconds: float) -> Column:
    """Sum over [t - seconds, t] of haloed rows; 0 where there is nothing."""
    back = int(seconds * 1e6) + 1
    zero = lambda x: F.coalesce(x, F.lit(0))
    return zero(F.sum(c).over(upto(on))) - zero(F.sum(c).over(upto(on, back)))


def trailing_changes(change: Column, on: list[str], seconds: float) -> Column:
    """Sum over [t - seconds, t] of changes against the row before, those that cross the left edge left out.

    A change also belongs to the row before it: what rows before the window changed to their next ones is taken off.
    """
    back = int(seconds * 1e6) + 1
    following = F.lead(change).over(Window.partitionBy(*on, "_part").orderBy("us", "seq"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return zero(F.sum(change).over(upto(on))) - zero(F.sum(following).over(upto(on, back)))


def numbered(rows: DataFrame, on: list[str]) -> DataFrame:
    """Haloed rows with _i, their place in the part: the change of a part's first row crosses every window's edge."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*on, "_part").orderBy("us", "seq")))


def trailing_first(c: Column, on: list[str], seconds: float) -> Column:
    """c of the first row of [t - seconds, t] of haloed rows: of the one that follows the last row before it."""
    following = F.lead(F.struct(c.alias("x"))).over(Window.partitionBy(*on, "_part").orderBy("us", "seq"))
    return F.coalesce(F.last(following).over(upto(on, int(seconds * 1e6) + 1)), F.first(F.struct(c.alias("x"))).over(upto(on)))["x"]


def deviation(n: Column, total: Column, squares: Column, unit: float = 1.0) -> Column:
    """Sample deviation from whole sums of values and squares in ``unit``; null below two values."""
    spread = (n * squares - total * total).cast("double") / (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread)) * unit)


def whole(c: Column, unit: float) -> Column:
    """c in whole units, as a decimal whose sums and squares are exact."""
    return F.round(c / unit).cast("decimal(18,0)")


def next_extremes(rows: DataFrame, on: list[str], value: str, reach: int, along: str = "us") -> DataFrame:
    """rows with n, high and low of ``value`` over [x, x + reach) for each row's x, every row added to a frame twice.

    A window as long as a bucket is what is left of its own bucket and the start of the next one. Rows of the next
    bucket are laid over the own one, ``reach`` earlier, so that both are frames that only grow.
    """
    bucket, x = F.floor(F.col(along) / reach), F.col(along)
    copies = F.array(F.struct(bucket.alias("_b"), x.alias("_x"), F.lit(True).alias("_own")), F.struct((bucket - 1).alias("_b"), (x - reach).alias("_x"), F.lit(False).alias("_own")))
    laid = rows.withColumn("_copy", F.explode(copies)).select(*rows.columns, "_copy.*")
    here = Window.partitionBy(*on, "_b")
    rest, begun = here.orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0), here.orderBy("_x").rangeBetween(Window.unboundedPreceding, -1)
    mine, following = F.when(F.col("_own"), F.col(value)), F.when(~F.col("_own"), F.col(value))
    count = F.count_if(F.col("_own")).over(rest) + F.count_if(~F.col("_own")).over(begun)
    high, low = F.greatest(F.max(mine).over(rest), F.max(following).over(begun)), F.least(F.min(mine).over(rest), F.min(following).over(begun))
    return laid.withColumns({"n": count, "high": high, "low": low}).filter("_own").drop("_b", "_x", "_own")
