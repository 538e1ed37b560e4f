"""Order-book state and pricing over ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.segments import scan


def book_state(updates: DataFrame, on: list[str], depths: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The book after every update: price and size of each slot, null where it was removed or never set.

    ``keep`` names further columns of the updates to return.

    A removal is a struct of nulls, not a null, so that carrying the last state forward doesn't skip it.
    """
    gone = (F.col("action") == 2) | (F.col("size") <= 0)
    slot = F.struct(F.when(~gone, F.col("price")).alias("px"), F.when(~gone, F.col("size")).alias("sz"))
    slots = [(side, name, d) for side, name in ((0, "bid"), (1, "ask")) for d in range(1, depths + 1)]
    scans = {f"{name}{d}": ("last", F.when((F.col("side") == side) & (F.col("depth") == d), slot)) for side, name, d in slots}
    narrow = updates.select(*dict.fromkeys([*on, "us", "seq", *(keep or []), "side", "depth", "action", "price", "size"]))
    columns = [F.col(f"{name}{d}.{field}").alias(f"{name}_{field}{d}") for _, name, d in slots for field in ("px", "sz")]
    return scan(narrow, on, ["us", "seq"], scans).select(*on, "us", "seq", *(keep or []), *columns)


def sweep(levels: DataFrame, on: list[str], quantity: int) -> DataFrame:
    """What buying ``quantity`` from each ladder takes: used, vwap, worst price and whether it is fully covered."""
    order = Window.partitionBy(*on).orderBy("price", "level_id")
    before = F.coalesce(F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("qty"), F.lit(quantity) - before))
    taken = levels.withColumn("take", take).filter("take > 0")
    out = taken.groupBy(*on).agg(F.sum("take").alias("used"), F.sum(F.col("take") * F.col("price")).alias("cost"), F.max("price").alias("worst"))
    return out.select(*on, "used", F.round(F.col("cost") / F.col("used"), 4).alias("vwap"), "worst", (F.col("used") >= quantity).alias("covered"))


#: Copies of every ladder, so that the blocks of a busy venue are dealt over as many groups; more of them make tasks larger
#: where ladders have as many levels as there are blocks.
SALTS = 4


def look_up(
    levels: DataFrame, blocks: DataFrame, on: list[str], sizes: dict[str, Column], limits: dict[str, Column] | None = None, parts: dict[str, Column] | None = None
) -> DataFrame:
    """blocks with what they find on their ladder, without a pair of a block and each level.

    levels(*on, level_id, cents, qty) are cheapest first for offers, dearest first for bids; ``on`` holds ``side``. Each
    name of ``sizes`` becomes a struct for that many shares: filled, paid, worst (price) and covered, and a sum for each
    of ``parts``, amounts of a level that are consumed in proportion. Each of ``limits`` becomes the quantity at prices
    in cents no worse than it. Sizes of 0 or less fill nothing; beyond its depth a ladder fills what it has. Blocks with
    a null key or size, or without a level of at least one share, are left out; equal blocks all stay.

    A level knows the sums up to it, so a block needs the last level that begins before its size and the last one within
    its limit. Both lie in one shuffle of blocks and levels by key and salt; there they are sorted by size and by price
    and the last level is carried along.
    """
    limits, parts = limits or {}, parts or {}
    key = F.when(F.col("side") == "ask", F.col("cents")).otherwise(-F.col("cents"))
    upto = Window.partitionBy(*on).orderBy(key, "level_id").rowsBetween(Window.unboundedPreceding, 0)
    shares = F.col("qty").cast("long")
    steps = levels.filter("qty > 0").select(
        *on, key.alias("_key"),
        F.struct(
            F.sum(shares).over(upto).alias("upto"), F.sum(shares * F.col("cents")).over(upto).alias("amount"), F.col("cents").alias("cents"), shares.alias("qty"),
            *(c.cast("double").alias(n) for n, c in parts.items()), *(F.sum(c.cast("double")).over(upto).alias(f"{n}_upto") for n, c in parts.items()),
        ).alias("_step"),
    )

    def place(by_price: bool, at: Column, later: bool, ask: int) -> Column:
        return F.struct(F.lit(by_price).alias("_by_price"), at.cast("long").alias("_at"), F.lit(later).alias("_later"), F.lit(ask).alias("_ask"))

    # a level begins after the sizes that end where it begins, and comes before the limits that are its price
    begins, priced = place(False, F.col("_step.upto") - F.col("_step.qty"), True, -1), place(True, F.col("_key"), False, -1)
    steps = steps.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"), "_step", F.array(begins, *([priced] if limits else [])).alias("_places"))
    asks = [place(False, F.when(q < 1, 1).otherwise(q), False, i) for i, q in enumerate(sizes.values())]
    asks += [place(True, F.when(F.col("side") == "ask", c).otherwise(-c), True, i) for i, c in enumerate(limits.values(), len(sizes))]
    row = F.struct(*blocks.columns, F.struct(*(q.cast("long").alias(n) for n, q in sizes.items())).alias("_sizes"))
    asked = blocks.dropna(subset=on).select(*on, F.pmod(F.xxhash64(*blocks.columns), F.lit(SALTS)).alias("_salt"), row.alias("_row"), F.array(*asks).alias("_places"))
    group = [*on, "_salt"]
    both = steps.unionByName(asked, allowMissingColumns=True).repartition(*group).select(*group, "_row", "_step", F.inline("_places"))
    order = Window.partitionBy(*group, "_by_price").orderBy("_at", "_later", "_step.upto").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_step", F.last("_step", ignorenulls=True).over(order)).filter("_row IS NOT NULL")
    found = seen.groupBy(*group, "_row").agg(
        F.count_if(F.col("_ask") == 0).alias("_copies"), *(F.max(F.when(F.col("_ask") == i, F.col("_step"))).alias(f"_found{i}") for i in range(len(asks)))
    )
    found = found.filter(" AND ".join(f"_found{i} IS NOT NULL" for i in range(len(sizes))))
    found = found.withColumn("_copies", F.explode(F.expr("array_repeat(0, int(_copies))")))

    def filled(i: int, name: str) -> Column:
        at, size = F.col(f"_found{i}"), F.greatest(F.col(f"_row._sizes.{name}"), F.lit(0))
        rest = at["upto"] - F.least(size, at["upto"])
        of_parts = [(at[f"{n}_upto"] - rest * at[n] / at["qty"]).alias(n) for n in parts]
        return F.struct(F.least(size, at["upto"]).alias("filled"), (at["amount"] - rest * at["cents"]).alias("paid"), at["cents"].alias("worst"), (size <= at["upto"]).alias("covered"), *of_parts)

    within = (F.coalesce(F.col(f"_found{i}.upto"), F.lit(0)).cast("long").alias(n) for i, n in enumerate(limits, len(sizes)))
    return found.select(*(F.col(f"_row.{c}") for c in blocks.columns), *(filled(i, n).alias(n) for i, n in enumerate(sizes)), *within)
