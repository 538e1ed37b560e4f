"""Paths after an entry, lockouts, positions over all rows, and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import picked
from tickloom.operators.segments import PART_ROWS, PART_US, scan
from tickloom.operators.temporal import asof


def ahead(events: DataFrame, prints: DataFrame, seconds: int) -> DataFrame:
    """events joined with the prints (at, at_seq, px) of [us, us + seconds] on the same day.

    An equi-join on the day and time buckets as long as the horizon: an event looks into two of them, so that a busy day
    is spread over its buckets.
    """
    width = seconds * 1_000_000
    first = F.floor(F.col("us") / width)
    a = events.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    b = prints.select("day", F.floor(F.col("us") / width).alias("_bucket"), F.col("us").alias("at"), F.col("seq").alias("at_seq"), F.col("price").alias("px"))
    return a.join(b, ["day", "_bucket"]).filter((F.col("at") >= F.col("us")) & (F.col("at") <= F.col("us") + width)).drop("_bucket")


#: Longest reach of a group of reaches by the shortest.
SPAN = 16


def outlook(events: DataFrame, prints: DataFrame, key: list[str], reaches: list[int], along: str = "us") -> DataFrame:
    """events by horizon with n, high, low and at_end of the prints in [x, x + reach) of their day, x in ``along``.

    events are prints themselves: both have day, seq and ``along``; prints have price. Buckets are as long as the least
    reach. A window is the rest of its first bucket, whole buckets, and the start of the last one up to the last print
    before its end, which an as-of read finds. Reaches are looked at in groups, so that an event looks at SPAN buckets
    at most; it meets them after the as-of read, whose sorts hold no buckets.
    """
    width = min(reaches)
    if max(reaches) > SPAN * width:
        near = [r for r in reaches if r <= SPAN * width]
        return outlook(events, prints, key, near, along).union(outlook(events, prints, key, [r for r in reaches if r not in near], along))
    p = prints.select("day", "seq", F.col(along).alias("us"), "price").withColumn("bucket", F.floor(F.col("us") / width))
    here = Window.partitionBy("day", "bucket")
    so_far, rest = here.orderBy("us").rangeBetween(Window.unboundedPreceding, 0), here.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({
        "high": F.max("price").over(so_far), "low": F.min("price").over(so_far), "held": F.count("*").over(so_far),
        "rest_high": F.max("price").over(rest), "rest_low": F.min("price").over(rest), "earlier": F.rank().over(here.orderBy("us")) - 1,
    })
    buckets = prints.groupBy("day", F.floor(F.col(along) / width).alias("bucket")).agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("m"))
    before = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy("day").orderBy("bucket").rowsBetween(1, SPAN + 1)
    between = buckets.select("day", "bucket", F.collect_list(F.struct("bucket", "high", "low")).over(following).alias("between"))
    starts = buckets.select("day", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    e = events.select("day", "seq", *key, F.col(along).alias("at")).join(p.select("day", "seq", "bucket", "rest_high", "rest_low", "earlier"), ["day", "seq"])
    e = e.join(starts, ["day", "bucket"])
    probes = e.withColumn("reach", F.explode(F.array(*map(F.lit, reaches)))).withColumn("us", F.col("at") + F.col("reach") - 1)
    states = p.join(starts, ["day", "bucket"]).select("day", "us", "seq", "bucket", "high", "low", "price", (F.col("start") + F.col("held")).alias("upto"))
    found = asof(probes, states, ["day"], ["bucket", "high", "low", "price", "upto"], "end", width=max(width, PART_US if along == "us" else PART_ROWS)).join(between, ["day", "bucket"])
    inner = F.filter("between", lambda b: b.bucket < F.col("end.bucket"))
    last = F.col("end.bucket") > F.col("bucket")
    high = F.greatest("rest_high", F.array_max(F.transform(inner, lambda b: b.high)), F.when(last, F.col("end.high")))
    low = F.least("rest_low", F.array_min(F.transform(inner, lambda b: b.low)), F.when(last, F.col("end.low")))
    n = F.col("end.upto") - F.col("start") - F.col("earlier")
    return found.select("day", "seq", *key, "reach", n.alias("n"), high.alias("high"), low.alias("low"), F.col("end.price").alias("at_end"))


def exits(paths: DataFrame, on: list[str], gain: Column, target: float, stop: float) -> DataFrame:
    """Per entry the first print that gains ``target`` or loses ``stop``, else the last print: reason, exit_us and pnl."""
    at = F.struct("at", "at_seq")
    p = paths.withColumn("gain", gain)
    hits = p.groupBy(*on).agg(
        F.min(F.when(F.col("gain") >= target, at)).alias("won"), F.min(F.when(F.col("gain") <= -stop, at)).alias("lost"), F.max(F.struct("at", "at_seq", "gain")).alias("last")
    )
    return ended(hits.withColumn("final", F.col("last")), on, F.col("last.gain"), target, stop)


def ended(hits: DataFrame, on: list[str], gain: Column, target: float, stop: float) -> DataFrame:
    """reason, exit_us and pnl of entries from the points (at, at_seq) won, lost and final; ``gain`` is that at the final one."""
    point = lambda n: F.when(F.col(n).isNotNull(), F.struct(f"{n}.at", f"{n}.at_seq"))
    won, lost = F.col("won"), F.col("lost")
    by_target = won.isNotNull() & (lost.isNull() | (point("won") < point("lost")))
    return hits.select(
        *on,
        F.when(by_target, "target").when(lost.isNotNull(), "stop").otherwise("time").alias("reason"),
        F.when(by_target, won["at"]).when(lost.isNotNull(), lost["at"]).otherwise(F.col("final.at")).alias("exit_us"),
        F.when(by_target, F.lit(float(target))).when(lost.isNotNull(), F.lit(-float(stop))).otherwise(gain).alias("pnl"),
    )


def lockout(trades: DataFrame, on: list[str]) -> DataFrame:
    """One trade at a time per key: of trades(us, seq, exit_us) those that start after the last accepted one's exit.

    A trade that starts after all earlier exits is accepted whatever came before, so it starts a run, and runs are folded
    each on its own.
    """
    order = Window.partitionBy(*on).orderBy("us", "seq")
    before = F.max("exit_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("us") > before).cast("int"), F.lit(1))
    runs = trades.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    empty = F.array().cast("array<struct<us:bigint,seq:bigint,exit_us:bigint>>")
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x.us > F.element_at(acc, -1).exit_us), F.concat(acc, F.array(x))).otherwise(acc)
    ordered = F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("us", "seq", "exit_us")))))
    kept = runs.groupBy(*on, "_run").agg(F.aggregate(ordered, empty, step).alias("kept"))
    return kept.select(*on, F.explode("kept").alias("e")).select(*on, "e.us", "e.seq", "e.exit_us")


def positions(df: DataFrame, coarse: str, order: list[str]) -> DataFrame:
    """df with i, its place from 0 in the order (coarse, *order), and n, the number of rows.

    Rows are ranked within each value of ``coarse`` only; the counts of its values, a row each, give the offsets. So no
    task sorts the whole table.
    """
    whole = Window.orderBy(coarse)
    counts = df.groupBy(coarse).agg(F.count("*").alias("_m"))
    starts = counts.select(coarse, (F.sum("_m").over(whole) - F.col("_m")).alias("_start"), F.sum("_m").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(coarse).orderBy(*order)) - 1)
    return ranked.join(starts, coarse).withColumn("i", F.col("_start") + F.col("_r")).drop("_start", "_r")


def draw(*parts: Column) -> Column:
    """A reproducible number below 2^31 from integers below 2^20: the same arithmetic in any engine, no hash or rand()."""
    x = F.lit(12345).cast("long")
    for part in parts:
        x = ((x + part.cast("long")) * 1103515245 + 12345) % 2147483648
        x = (x.bitwiseXOR(F.floor(x / 65536))) % 2147483648
    return x


def nearest_quantile(values: DataFrame, on: list[str], value: str, percents: list[int]) -> DataFrame:
    """The element at round((n - 1) q) of each group's sorted values."""
    return picked(values, on, value, {f"q{p}": F.floor(((F.col("n") - 1) * p + 50) / 100) for p in percents})


def drawdowns(trades: DataFrame, on: list[str], order: list[str], pnl: str, width: int) -> DataFrame:
    """total, peak and max_drawdown of each key's running sum of ``pnl``; the peak starts at the first value of it.

    A part, ``width`` long in the first column of order, comes down to its sum, its highest and lowest running sum and
    its worst drop. Parts are merged in order: a drop from an earlier peak needs only where a part starts and its low.
    """
    parts = [*on, "_part"]
    cut = trades.withColumn("_part", F.floor(F.col(order[0]) / width))
    so_far = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("_at", F.sum(pnl).over(so_far)).withColumn("_drop", F.max("_at").over(so_far) - F.col("_at"))
    few = run.groupBy(*parts).agg(F.sum(pnl).alias("_sum"), F.max("_at").alias("_high"), F.min("_at").alias("_low"), F.max("_drop").alias("_worst"))
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    few = few.withColumn("_peak", F.max(F.col("_start") + F.col("_high")).over(before))
    drop = F.greatest("_worst", F.col("_peak") - F.col("_start") - F.col("_low"))
    return few.groupBy(*on).agg(F.sum("_sum").alias("total"), F.max(F.col("_start") + F.col("_high")).alias("peak"), F.max(drop).alias("max_drawdown"))


def longest_runs(rows: DataFrame, on: list[str], order: list[str], flag: str, width: int) -> DataFrame:
    """longest_true and longest_false: the longest runs of equal flags of each key along ``order``."""
    r = scan(rows.select(*on, *order, flag), on, order, {"was": ("lag", F.col(flag))}, width)
    r = scan(r.withColumn("_new", (~F.col(flag).eqNullSafe(F.col("was"))).cast("int")), on, order, {"run": ("sum", F.col("_new"))}, width)
    lengths = r.groupBy(*on, flag, "run").agg(F.count("*").alias("_m"))
    longest = lambda want: F.coalesce(F.max(F.when(F.col(flag) == want, F.col("_m"))), F.lit(0))
    return lengths.groupBy(*on).agg(longest(True).alias("longest_true"), longest(False).alias("longest_false"))
