"""Registered queries on indicators of bars, depth of the book, order flow and volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import safe_div
from tickloom.operators.book import book_state
from tickloom.operators.profile import value_areas
from tickloom.operators.segments import PART_ROWS, deviation, haloed, numbered, own, scan, trailing_changes, trailing_first, trailing_sum, upto, whole
from tickloom.operators.temporal import smoothed
from tickloom.operators.walls import walls
from tickloom.plans import views as v
from tickloom.plans.market import AGGRESSOR, BANDED, BARS, aggressor, bars, by_day, entries, query, sided, so_far, with_vwap

DEPTHS = range(1, 11)
SIDES = ("bid", "ask")
NEAR, MIDDLE, FAR = range(1, 4), range(4, 7), range(7, 11)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with i, their place in the day from 0."""
    return bars(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("bar")) - 1)


@query(f"""
WITH RECURSIVE {BARS},
b AS MATERIALIZED (SELECT day, bar, close, row_number() OVER (PARTITION BY day ORDER BY bar) - 1 AS i FROM bars),
e(day, bar, i, fast, slow, signal) AS (
  SELECT day, bar, i, close, close, CAST(0 AS DOUBLE) FROM b WHERE i = 0
  UNION ALL
  SELECT day, bar, i, fast, slow, signal + (fast - slow - signal) * 2 / 10.0 FROM (
    SELECT b.day, b.bar, b.i, e.fast + (b.close - e.fast) * 2 / 13.0 AS fast,
      e.slow + (b.close - e.slow) * 2 / 27.0 AS slow, e.signal
    FROM e JOIN b ON b.day = e.day AND b.i = e.i + 1))
SELECT bar, round(fast - slow, 4) AS macd, round(signal, 4) AS signal, round(fast - slow - signal, 4) AS hist FROM e""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the averages over 12 and 26 bars, its own average over 9, and what is between the two."""
    lines = smoothed(placed(spark, sf_dir), ["day"], "i", {"fast": (F.col("close"), 2 / 13, 1), "slow": (F.col("close"), 2 / 27, 1)})
    lines = lines.withColumn("macd", F.col("fast") - F.col("slow"))
    lines = smoothed(lines, ["day"], "i", {"signal": (F.col("macd"), 2 / 10, 1)})
    return lines.select("bar", F.round("macd", 4).alias("macd"), F.round("signal", 4).alias("signal"), F.round(F.col("macd") - F.col("signal"), 4).alias("hist"))


@query(f"""
WITH RECURSIVE {BARS},
b AS MATERIALIZED (SELECT day, bar, i, coalesce(greatest(d, 0), 0) AS gain, coalesce(greatest(-d, 0), 0) AS loss FROM (
  SELECT day, bar, close - lag(close) OVER w AS d, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY day ORDER BY bar))),
e(day, bar, i, up, down) AS (
  SELECT day, max(bar) AS bar, CAST(14 AS BIGINT), sum(gain) / 14, sum(loss) / 14 FROM b WHERE i <= 14 GROUP BY day HAVING count(*) = 15
  UNION ALL
  SELECT b.day, b.bar, b.i, (e.up * 13 + b.gain) / 14, (e.down * 13 + b.loss) / 14 FROM e JOIN b ON b.day = e.day AND b.i = e.i + 1)
SELECT bar, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi FROM e""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative strength over 14 bars of a day, whose averages start from the plain mean of the first 14 changes."""
    order = Window.partitionBy("day").orderBy("i")
    b = placed(spark, sf_dir).withColumn("d", F.coalesce(F.col("close") - F.lag("close").over(order), F.lit(0.0))).withColumn("at", F.col("i") - 1)
    averages = {name: (F.greatest(sign * F.col("d"), F.lit(0.0)), 1 / 14, 14) for name, sign in (("up", 1), ("down", -1))}
    averages = smoothed(b, ["day"], "at", averages).filter("i >= 14")
    strength = F.when(F.col("down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("up") / F.col("down")))
    return averages.select("bar", F.round(strength, 4).alias("rsi"))


@query(f"""
WITH {BARS},
k AS (SELECT day, bar, CASE WHEN count(*) OVER w = 14 THEN CASE WHEN max(high) OVER w = min(low) OVER w THEN 50
    ELSE least(100, greatest(0, 100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w))) END END AS k
  FROM bars WINDOW w AS (PARTITION BY day ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT bar, round(k, 4) AS k, CASE WHEN count(k) OVER w = 3 THEN round(avg(k) OVER w, 4) END AS d
FROM k WINDOW w AS (PARTITION BY day ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the close in the range of 14 bars, 50 where that is flat, and its mean over 3."""
    order = Window.partitionBy("day").orderBy("bar")
    w, three = order.rowsBetween(-13, 0), order.rowsBetween(-2, 0)
    high, low = F.max("high").over(w), F.min("low").over(w)
    place = F.when(high == low, F.lit(50.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (F.col("close") - low) / (high - low))))
    k = bars(spark, sf_dir).select("day", "bar", F.when(F.count("*").over(w) == 14, place).alias("k"))
    return k.select("bar", F.round("k", 4).alias("k"), F.when(F.count("k").over(three) == 3, F.round(F.avg("k").over(three), 4)).alias("d"))


_W = "PARTITION BY day ORDER BY us, seq"
_SLOTS = ",\n  ".join(
    f"last_value(CASE WHEN side = {s} AND depth = {d} THEN struct_pack(px := CASE WHEN action <> 2 AND size > 0 THEN price END, "
    f"sz := CASE WHEN action <> 2 AND size > 0 THEN size END) END IGNORE NULLS) OVER ({_W}) AS {n}{d}"
    for s, n in enumerate(SIDES) for d in DEPTHS
)
BOOK10 = v.BOOK + f", slots AS (SELECT day, us, seq, price,\n  {_SLOTS} FROM book)"


def book10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-level book after every update, with the price of the update itself."""
    return book_state(v.book_updates(spark, sf_dir), ["day"], 10, ["price"])


def total(side: str, depths: range) -> Column:
    """Size over some levels; levels that are empty count as 0."""
    return sum((F.coalesce(F.col(f"{side}_sz{d}"), F.lit(0)) for d in depths), F.lit(0))


def _total(side: str, depths: range) -> str:
    return "(" + " + ".join(f"coalesce({side}{d}.sz, 0)" for d in depths) + ")"


def _imbalance(depths: range) -> str:
    b, a = _total("bid", depths), _total("ask", depths)
    return f"round(CASE WHEN {b} + {a} <> 0 THEN ({b} - {a}) / ({b} + {a}) END, 6)"


@query(f"WITH {BOOK10} SELECT seq, " + ", ".join(f"{_imbalance(range(1, n + 1))} AS obi{n}" for n in (1, 3, 5, 10)) + f""",
  round(CASE WHEN wb + wa <> 0 THEN (wb - wa) / (wb + wa) END, 6) AS weighted
FROM (SELECT *, {' + '.join(f'coalesce(bid{d}.sz / nullif(abs(price - bid{d}.px), 0), 0)' for d in DEPTHS)} AS wb,
  {' + '.join(f'coalesce(ask{d}.sz / nullif(abs(price - ask{d}.px), 0), 0)' for d in DEPTHS)} AS wa FROM slots)""")
def weighted_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance of size over 1, 3, 5 and 10 levels, and over all with sizes divided by their distance from the price."""
    s = book10(spark, sf_dir)
    for side in SIDES:
        near = [F.coalesce(safe_div(F.col(f"{side}_sz{d}"), F.abs(F.col("price") - F.col(f"{side}_px{d}"))), F.lit(0.0)) for d in DEPTHS]
        s = s.withColumn(f"w{side}", sum(near[1:], near[0]))
    levels = {n: (total("bid", range(1, n + 1)), total("ask", range(1, n + 1))) for n in (1, 3, 5, 10)}
    plain = [F.round(safe_div(b - a, b + a), 6).alias(f"obi{n}") for n, (b, a) in levels.items()]
    return s.select("seq", *plain, F.round(safe_div(F.col("wbid") - F.col("wask"), F.col("wbid") + F.col("wask")), 6).alias("weighted"))


def _profile(side: str) -> str:
    sizes = [f"coalesce({side}{d}.sz, 0)" for d in DEPTHS]
    slope = " + ".join(f"({2 * i - 9}) * {s}" for i, s in enumerate(sizes))
    far = _total(side, range(8, 11))
    return f"""{_total(side, NEAR)} AS {side}_near, {_total(side, MIDDLE)} AS {side}_middle, {_total(side, FAR)} AS {side}_far,
  round(({slope}) / 165.0, 6) AS {side}_slope, round(({sizes[9]} - {sizes[8]} - {sizes[1]} + {sizes[0]}) / 8.0, 6) AS {side}_curvature,
  round(CASE WHEN {far} <> 0 THEN {_total(side, NEAR)} / {far} END, 6) AS {side}_convexity"""


@query(f"WITH {BOOK10} SELECT seq, {_profile('bid')},\n  {_profile('ask')} FROM slots")
def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's size near, in the middle and far, its slope and mean second difference over ten levels, and near by far."""
    columns = []
    for side in SIDES:
        y = [F.coalesce(F.col(f"{side}_sz{d}"), F.lit(0)) for d in DEPTHS]
        slope = sum(((2 * i - 9) * s for i, s in enumerate(y)), F.lit(0))
        columns += [total(side, part).alias(f"{side}_{name}") for part, name in ((NEAR, "near"), (MIDDLE, "middle"), (FAR, "far"))]
        columns += [
            F.round(slope / 165.0, 6).alias(f"{side}_slope"),
            F.round((y[9] - y[8] - y[1] + y[0]) / 8.0, 6).alias(f"{side}_curvature"),
            F.round(safe_div(total(side, NEAR), total(side, range(8, 11))), 6).alias(f"{side}_convexity"),
        ]
    return book10(spark, sf_dir).select("seq", *columns)


FLOW = BOOK10 + f""", near AS (SELECT *, bid - lag(bid) OVER w AS dbid, ask - lag(ask) OVER w AS dask,
  coalesce(bid - lag(bid) OVER w - (ask - lag(ask) OVER w), 0) AS ofi, CASE WHEN bid + ask <> 0 THEN (bid - ask) / (bid + ask) END AS imbalance
  FROM (SELECT day, us, seq, {_total('bid', NEAR)} AS bid, {_total('ask', NEAR)} AS ask FROM slots) WINDOW w AS ({_W}))"""


def flow(spark: SparkSession, sf_dir: str, window: int | None = None) -> DataFrame:
    """Sizes near the touch after every update, their changes, the order-flow imbalance and the queue imbalance.

    With a ``window`` in seconds rows are haloed for it and numbered, and the changes of a part's first row are null.
    """
    s = book10(spark, sf_dir).select("day", "us", "seq", total("bid", NEAR).alias("bid"), total("ask", NEAR).alias("ask"))
    s = scan(s, ["day"], ["us", "seq"], {"was": ("lag", F.struct("bid", "ask"))})
    s = s.withColumns({f"d{side}": F.col(side) - F.col(f"was.{side}") for side in SIDES}).drop("was")
    s = s.withColumns({"ofi": F.coalesce(F.col("dbid") - F.col("dask"), F.lit(0)), "imbalance": safe_div(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask"))})
    if window is None:
        return s
    s = numbered(haloed(s, "us", window * 1_000_000), ["day"])
    return s.withColumns({f"d{side}": F.when(F.col("_i") > 1, F.col(f"d{side}")) for side in SIDES})


def _range(seconds: int) -> str:
    return f"PARTITION BY day ORDER BY us RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW"


@query(f"WITH {FLOW} SELECT seq, ofi, " + ", ".join(f"CAST(sum(ofi) OVER ({_range(s)}) AS BIGINT) AS ofi_{s}" for s in (300, 600, 3600)) + " FROM near")
def ofi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-flow imbalance of each update near the touch, and its sums over three trailing windows."""
    rows = flow(spark, sf_dir, 3600)
    return own(rows.withColumns({f"ofi_{s}": trailing_sum(F.col("ofi"), ["day"], s) for s in (300, 600, 3600)})).select("seq", "ofi", "ofi_300", "ofi_600", "ofi_3600")


@query(f"""
WITH {FLOW}, x AS (SELECT *, first_value(CASE WHEN imbalance IS NOT NULL THEN struct_pack(t := us, x := imbalance) END IGNORE NULLS) OVER w AS one,
  last_value(CASE WHEN imbalance IS NOT NULL THEN struct_pack(t := us, x := imbalance) END IGNORE NULLS) OVER w AS two
  FROM near WINDOW w AS ({_range(3600)}))
SELECT seq, round(avg(imbalance) OVER w, 6) AS mean, round(stddev_samp(imbalance) OVER w, 6) AS deviation,
  round(CASE WHEN two.t > one.t THEN (two.x - one.x) / ((two.t - one.t) / 1000000.0) END, 9) AS slope,
  round(avg(CASE WHEN imbalance IS NOT NULL THEN CAST(imbalance > 0 AS DOUBLE) END) OVER w, 6) AS positive
FROM x WINDOW w AS ({_range(3600)})""")
def snapshot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, slope a second from first to last, and positive share of the queue imbalance over an hour."""
    x, unit, hour = F.col("imbalance"), 1e-12, 3_600_000_000
    point = F.when(x.isNotNull(), F.struct(F.col("us").alias("t"), x.alias("x")))
    after = Window.partitionBy("day", "_part").orderBy(F.desc("us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    s = flow(spark, sf_dir, 3600).withColumns({"point": point, "next": F.struct(F.last(point, ignorenulls=True).over(after).alias("p"))})
    # the first point of the window follows the last row before it; where there is no such row it is the part's first
    before = F.last("next").over(upto(["day"], hour + 1))
    one = F.when(before.isNotNull(), before["p"]).otherwise(F.first("point", ignorenulls=True).over(upto(["day"])))
    two = F.last("point", ignorenulls=True).over(upto(["day"]))
    big = whole(x, unit)
    sums = {"n": F.when(x.isNotNull(), 1), "total": big, "squares": big * big, "above": (x > 0).cast("int")}
    s = own(s.withColumns({"one": one, "two": two} | {n: trailing_sum(c, ["day"], 3600) for n, c in sums.items()}))
    slope = F.when((F.col("two.t") > F.col("one.t")) & (F.col("two.t") >= F.col("us") - hour), (F.col("two.x") - F.col("one.x")) / ((F.col("two.t") - F.col("one.t")) / 1_000_000.0))
    n = F.col("n")
    mean, spread = F.when(n > 0, F.col("total").cast("double") * unit / n), deviation(n, F.col("total"), F.col("squares"), unit)
    return s.select("seq", F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("deviation"), F.round(slope, 9).alias("slope"), F.round(safe_div(F.col("above"), n), 6).alias("positive"))


@query(f"""
WITH {FLOW}
SELECT seq, {", ".join(f"CASE WHEN count(*) OVER w > 1 THEN CAST(sum(greatest({sign}d{side}, 0)) OVER w - greatest(coalesce(first_value({sign}d{side}) OVER w, 0), 0) AS BIGINT) END AS {side}_{name}"
                       for side in SIDES for sign, name in (('', 'added'), ('-', 'taken')))}
FROM near WINDOW w AS ({_range(3600)})""")
def replenishment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added to and taken from each side near the touch over an hour, from changes inside the window only; null with one update."""
    s, changes = flow(spark, sf_dir, 3600), {}
    for side in SIDES:
        for sign, name in ((1, "added"), (-1, "taken")):
            d = F.col(f"d{side}")
            changes[f"{side}_{name}"] = F.when(d.isNotNull(), F.greatest(sign * d, F.lit(0)))
    s = s.withColumns(changes)
    s = s.withColumn("n", trailing_sum(F.lit(1), ["day"], 3600)).withColumns({n: trailing_changes(F.col(n), ["day"], 3600) for n in changes})
    return own(s).select("seq", *(F.when(F.col("n") > 1, F.col(n).cast("long")).alias(n) for n in changes))


@query(f"""
WITH {FLOW}, m AS (SELECT seq, bid, ask, avg(bid) OVER w AS mb, avg(ask) OVER w AS ma, stddev_samp(bid) OVER w AS sb, stddev_samp(ask) OVER w AS sa
  FROM near WINDOW w AS ({_range(3600)})),
z AS (SELECT seq, CASE WHEN sb > 1e-6 THEN (bid - mb) / sb ELSE bid - mb END AS zb, CASE WHEN sa > 1e-6 THEN (ask - ma) / sa ELSE ask - ma END AS za FROM m)
SELECT seq, round(zb, 4) AS bid_shock, round(za, 4) AS ask_shock, round(zb - za, 4) AS net_shock FROM z""")
def liquidity_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations of each side's size near the touch from its mean over an hour; plain distance where it doesn't vary."""
    s, sums = flow(spark, sf_dir, 3600), {}
    for side in SIDES:
        c = F.col(side).cast("decimal(18,0)")
        sums |= {f"n_{side}": F.when(c.isNotNull(), 1), f"sum_{side}": c, f"squares_{side}": c * c}
    s, z = own(s.withColumns({n: trailing_sum(c, ["day"], 3600) for n, c in sums.items()})), {}
    for side in SIDES:
        n, total_size = F.col(f"n_{side}"), F.col(f"sum_{side}")
        away, spread = F.col(side) - total_size.cast("double") / n, deviation(n, total_size, F.col(f"squares_{side}"))
        z[side] = F.when(spread > 1e-6, away / spread).otherwise(away)
    s = s.select("seq", *(c.alias(side) for side, c in z.items()))
    return s.select("seq", F.round("bid", 4).alias("bid_shock"), F.round("ask", 4).alias("ask_shock"), F.round(F.col("bid") - F.col("ask"), 4).alias("net_shock"))


@query(f"""
WITH {AGGRESSOR}, s2 AS MATERIALIZED (SELECT day, us, seq, sign, row_number() OVER (PARTITION BY day ORDER BY us, seq) AS i FROM a WHERE sign <> 0),
p AS (SELECT x.seq, y.sign AS y, lag(y.sign) OVER (PARTITION BY x.seq ORDER BY y.i) AS before
  FROM s2 x JOIN s2 y ON x.day = y.day AND y.us BETWEEN x.us - 7200000000 AND x.us),
n AS (SELECT seq, count(*) AS m, sum(y) AS sy, sum(before) AS sx, sum(y * before) AS sxy FROM p WHERE before IS NOT NULL GROUP BY seq)
SELECT seq, CASE WHEN m >= 2 AND m * m <> sx * sx AND m * m <> sy * sy
  THEN round((m * sxy - sx * sy) / sqrt(CAST(m * m - sx * sx AS DOUBLE) * (m * m - sy * sy)), 6) END AS autocorr
FROM s2 LEFT JOIN n USING (seq)""")
def sign_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each trade sign with the one before it, over the signs of two hours; null below three signs.

    Signs are 1 or -1, so sums over the window say it: m pairs have squares that add up to m.
    """
    on, hours = ["day"], 7200
    s = numbered(haloed(aggressor(spark, sf_dir).filter("sign <> 0"), "us", hours * 1_000_000), on)
    s = s.withColumn("pair", F.col("sign") * F.lag("sign").over(Window.partitionBy("day", "_part").orderBy("us", "seq")))
    s = s.withColumns({"m": trailing_sum(F.lit(1), on, hours) - 1, "all": trailing_sum(F.col("sign"), on, hours), "sxy": trailing_changes(F.col("pair"), on, hours),
                       "latest": F.last("sign").over(upto(on)), "first": trailing_first(F.col("sign"), on, hours)})
    s = own(s).select("seq", "m", (F.col("all") - F.col("latest")).alias("sx"), (F.col("all") - F.col("first")).alias("sy"), "sxy")
    m, sx, sy = F.col("m"), F.col("sx"), F.col("sy")
    known = (m >= 2) & (m * m != sx * sx) & (m * m != sy * sy)
    return s.select("seq", F.when(known, F.round((m * F.col("sxy") - sx * sy) / F.sqrt((m * m - sx * sx).cast("double") * (m * m - sy * sy)), 6)).alias("autocorr"))


@query(f"""
WITH {AGGRESSOR}, w AS (SELECT seq, {", ".join(f"count(*) OVER r{s} AS n{s}, sum(volume) OVER r{s} AS v{s}, sum(sign * volume) OVER r{s} AS s{s}, sum(sign) OVER r{s} AS i{s}, sum(abs(sign)) OVER r{s} AS c{s}" for s in (600, 3600))}
  FROM a WINDOW {", ".join(f"r{s} AS ({_range(s)})" for s in (600, 3600))})
SELECT seq, round((n600 / 600.0) / (n3600 / 3600.0), 6) AS trades, round((v600 / 600.0) / (v3600 / 3600.0), 6) AS volume,
  CAST(s600 AS BIGINT) AS signed, round(s600 / 600.0 - s3600 / 3600.0, 6) AS acceleration,
  round(CASE WHEN c600 <> 0 THEN i600 / c600 END, 6) AS imbalance_600, round(CASE WHEN c3600 <> 0 THEN i3600 / c3600 END, 6) AS imbalance_3600 FROM w""")
def burst_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of trades and volume over ten minutes by those over an hour, signed volume and its acceleration, imbalance of counts."""
    s = haloed(aggressor(spark, sf_dir), "us", 3_600_000_000)
    sums = {"n": F.lit(1), "v": F.col("volume"), "s": F.col("sign") * F.col("volume"), "i": F.col("sign"), "c": F.abs("sign")}
    s = own(s.withColumns({f"{name}{seconds}": trailing_sum(c, ["day"], seconds) for seconds in (600, 3600) for name, c in sums.items()}))
    rate = lambda name: F.round((F.col(f"{name}600") / 600.0) / (F.col(f"{name}3600") / 3600.0), 6)
    return s.select(
        "seq", rate("n").alias("trades"), rate("v").alias("volume"), F.col("s600").alias("signed"),
        F.round(F.col("s600") / 600.0 - F.col("s3600") / 3600.0, 6).alias("acceleration"),
        *(F.round(safe_div(F.col(f"i{n}"), F.col(f"c{n}")), 6).alias(f"imbalance_{n}") for n in (600, 3600)),
    )


PROFILE = v.TRADES + ", profile AS (SELECT day, CAST(floor(price) AS BIGINT) AS level, CAST(sum(volume) AS BIGINT) AS volume FROM trades GROUP BY ALL)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.trades(spark, sf_dir).groupBy("day", F.floor("price").alias("level")).agg(F.sum("volume").alias("volume"))


@query(f"WITH {PROFILE} SELECT * FROM profile")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume traded a day at each whole point."""
    return profile(spark, sf_dir)


@query(f"""
WITH RECURSIVE {PROFILE},
d AS MATERIALIZED (SELECT day, list(level ORDER BY level) AS l, list(volume ORDER BY level) AS v, CAST(sum(volume) AS BIGINT) AS total FROM profile GROUP BY day),
e(day, lo, hi, covered) AS (
  SELECT day, list_position(v, list_max(v)), list_position(v, list_max(v)), list_max(v) FROM d
  UNION ALL
  SELECT e.day, CASE WHEN coalesce(d.v[e.hi + 1], -1) > CASE WHEN e.lo > 1 THEN d.v[e.lo - 1] ELSE -1 END THEN e.lo ELSE e.lo - 1 END,
    CASE WHEN coalesce(d.v[e.hi + 1], -1) > CASE WHEN e.lo > 1 THEN d.v[e.lo - 1] ELSE -1 END THEN e.hi + 1 ELSE e.hi END,
    e.covered + greatest(coalesce(d.v[e.hi + 1], -1), CASE WHEN e.lo > 1 THEN d.v[e.lo - 1] ELSE -1 END)
  FROM e JOIN d USING (day) WHERE 10 * e.covered < 7 * d.total)
SELECT day, l[list_position(v, list_max(v))] AS poc, l[lo] AS val, l[hi] AS vah FROM e JOIN d USING (day) WHERE 10 * covered >= 7 * total""")
def value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest level of a day (the lowest of several), and the range around it that holds 70% of the volume.

    The range grows to the side with more volume, left where both have the same. A day's levels are one array; the fold
    carries two places and a sum, no list.
    """
    levels = F.sort_array(F.collect_list(F.struct("level", "volume")))
    d = profile(spark, sf_dir).groupBy("day").agg(levels.alias("x"), F.sum("volume").alias("total"))
    d = d.withColumn("poc", F.array_position(F.transform("x", lambda s: s.volume), F.array_max(F.transform("x", lambda s: s.volume))).cast("int"))
    at = lambda i: F.when((i >= 1) & (i <= F.size("x")), F.try_element_at("x", F.greatest(i, F.lit(1))).volume).otherwise(F.lit(-1).cast("long"))
    state = lambda lo, hi, covered: F.struct(lo.alias("lo"), hi.alias("hi"), covered.alias("covered"))

    def grow(s: Column, _: Column) -> Column:
        left, right = at(s.lo - 1), at(s.hi + 1)
        wider = F.when(right > left, state(s.lo, s.hi + 1, s.covered + right)).otherwise(state(s.lo - 1, s.hi, s.covered + left))
        return F.when((10 * s.covered >= 7 * F.col("total")) | ((left < 0) & (right < 0)), s).otherwise(wider)

    start = state(F.col("poc"), F.col("poc"), F.element_at("x", F.col("poc")).volume)
    area = d.withColumn("area", F.aggregate("x", start, grow))
    level = lambda i: F.element_at("x", i).level
    return area.select("day", level(F.col("poc")).alias("poc"), level(F.col("area.lo")).alias("val"), level(F.col("area.hi")).alias("vah"))


def _wall(side: str) -> str:
    away = "s.ask{d}.px - e.price" if side == "upper" else "e.price - s.bid{d}.px"
    name = "ask" if side == "upper" else "bid"
    return " + ".join(f"CASE WHEN {away.format(d=d)} BETWEEN 0 AND 20 THEN s.{name}{d}.sz ELSE 0 END" for d in DEPTHS)


# Regular hours, in microseconds since midnight; both ends belong to them.
OPENS, CLOSES = 34_200_000_000, 57_600_000_000


@query(f"""
WITH RECURSIVE {BANDED}, p AS (SELECT e.seq, e.band, CAST(floor(t.price) AS BIGINT) AS level, CAST(sum(t.volume) AS BIGINT) AS volume
  FROM entries e JOIN trades t ON t.day = e.day AND t.us <= e.us AND t.us % 86400000000 BETWEEN {OPENS} AND {CLOSES} GROUP BY ALL),
d AS MATERIALIZED (SELECT seq, band, list(level ORDER BY level) AS l, list(volume ORDER BY level) AS v, CAST(sum(volume) AS BIGINT) AS total FROM p GROUP BY ALL),
e(seq, band, lo, hi, covered) AS (
  SELECT seq, band, list_position(v, list_max(v)), list_position(v, list_max(v)), list_max(v) FROM d
  UNION ALL
  SELECT seq, band, CASE WHEN above > below THEN lo ELSE lo - 1 END, CASE WHEN above > below THEN hi + 1 ELSE hi END, covered + greatest(above, below)
  FROM (SELECT e.*, coalesce(d.v[e.hi + 1], -1) AS above, CASE WHEN e.lo > 1 THEN d.v[e.lo - 1] ELSE -1 END AS below FROM e JOIN d USING (seq, band) WHERE 10 * e.covered < 7 * d.total)),
f AS (SELECT seq, band, l[list_position(v, list_max(v))] AS poc, l[lo] AS val, l[hi] AS vah FROM e JOIN d USING (seq, band) WHERE 10 * covered >= 7 * total)
SELECT seq, CAST(band AS INTEGER) AS band, poc, val, vah, round(price - poc, 6) AS from_poc, CAST(price BETWEEN val AND vah AS INTEGER) AS inside FROM entries LEFT JOIN f USING (seq, band)""")
def touch_value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busiest level and value area of regular hours as known at each touch, distance from the one, whether in the other."""
    t = v.trades(spark, sf_dir).filter((F.col("us") % 86_400_000_000).between(OPENS, CLOSES))
    prints = t.select("day", "us", F.floor("price").alias("level"), "volume")
    known = value_areas(prints, entries(spark, sf_dir).select("day", "us", "seq", "band", "price"), ["day"])
    inside = F.col("price").between(F.col("val"), F.col("vah")).cast("int")
    return known.select("seq", "band", "poc", "val", "vah", F.round(F.col("price") - F.col("poc"), 6).alias("from_poc"), inside.alias("inside"))


@query(f"""
WITH {BANDED}, {BOOK10.replace(v.TICKS + ", ", "", 1)},
j AS (SELECT e.seq, CAST(e.band AS INTEGER) AS band, s.us, s.seq AS at_seq, CASE WHEN e.side = 'upper' THEN {_wall('upper')} ELSE {_wall('lower')} END AS wall
  FROM entries e JOIN slots s ON e.day = s.day AND s.us BETWEEN e.us - 7200000000 AND e.us),
m AS (SELECT *, avg(wall) OVER (PARTITION BY seq, band) AS mean FROM j)
SELECT seq, band, CAST(arg_max(wall, (us, at_seq)) AS BIGINT) AS wall, round(any_value(mean), 4) AS mean, round(avg(CAST(4 * wall > 5 * mean AS DOUBLE)), 6) AS persistence
FROM m GROUP BY seq, band""")
def wall_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size within 20 points beyond each touch's price: now, on average over two hours, and how often above 1.25 times that."""
    e = entries(spark, sf_dir).select("seq", F.col("band").cast("int").alias("band"), "day", "us", "price", (F.col("side") == "upper").alias("upper"))
    gone = (F.col("action") == 2) | (F.col("size") <= 0)
    slots = v.book_updates(spark, sf_dir).select("day", "us", "seq", "side", "depth", F.when(~gone, F.col("price")).alias("px"), F.when(~gone, F.col("size")).alias("sz"))
    w = walls(e, slots, len(DEPTHS), 20, 7200, (4, 5))
    return w.select("seq", "band", "wall", F.round(F.col("total") / F.col("n"), 4).alias("mean"), F.round(F.col("often") / F.col("n"), 6).alias("persistence"))


_VWAP = f"sum(price * volume) OVER ({_W}) / sum(volume) OVER ({_W})"


@query(f"""
WITH {v.TRADES}, r AS (SELECT *, price - {_VWAP} AS resid FROM trades),
s AS (SELECT seq, CASE WHEN count(resid) OVER w >= 100 THEN stddev_samp(resid) OVER w END AS sr, CASE WHEN count(price) OVER w >= 100 THEN stddev_samp(price) OVER w END AS sp
  FROM r WINDOW w AS ({_W} ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW))
SELECT seq, round(CASE WHEN sr > 0 THEN sr ELSE sp END, 4) AS sigma FROM s""")
def rolling_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the last 5000 distances from the running VWAP, from 100 on; of the prices where that is 0 or unknown."""
    last, unit = 5000, 1e-9
    r = haloed(with_vwap(spark, sf_dir), "i", last - 1, PART_ROWS)
    order = Window.partitionBy("day", "_part").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for name, c in (("r", F.col("price") - F.col("vwap")), ("p", F.col("price"))):
        big = whole(c, unit)
        sums |= {f"n{name}": F.count(big).over(so_far), f"s{name}": F.sum(big).over(so_far), f"q{name}": F.sum(big * big).over(so_far)}
    # a window of rows is a running sum less the one so many rows before
    r = r.withColumns(sums)
    r = own(r.withColumns({n: F.col(n) - F.coalesce(F.lag(n, last).over(order), F.lit(0)) for n in sums}))
    known = lambda x: F.when(F.col(f"n{x}") >= 100, deviation(F.col(f"n{x}"), F.col(f"s{x}"), F.col(f"q{x}"), unit))
    return r.select("seq", known("r").alias("sr"), known("p").alias("sp")).select("seq", F.round(F.when(F.col("sr") > 0, F.col("sr")).otherwise(F.col("sp")), 4).alias("sigma"))


@query(f"""
WITH {BANDED}
SELECT seq, CAST(band AS INTEGER) AS band, us - lag(us) OVER (PARTITION BY day, band, side ORDER BY us, seq) AS since_same_us,
  us - lag(us) OVER (PARTITION BY day ORDER BY us, seq, band) AS since_any_us FROM entries""")
def touch_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the day's last touch of the same band and side, and since the last of any."""
    same, every = Window.partitionBy("day", "band", "side").orderBy("us", "seq"), Window.partitionBy("day").orderBy("us", "seq", "band")
    gap = lambda w: F.col("us") - F.lag("us").over(w)
    return entries(spark, sf_dir).select("seq", "band", gap(same).alias("since_same_us"), gap(every).alias("since_any_us"))


@query(f"""
WITH {BANDED}, i AS (SELECT *, count(side) OVER (PARTITION BY day, band ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island,
  lag(side) OVER (PARTITION BY day, band ORDER BY us, seq) AS last_side FROM sides),
s AS (SELECT *, min(CASE WHEN side IS NULL THEN us END) OVER (PARTITION BY day, band, island) AS inside_from,
  max(CASE WHEN side IS NULL THEN us END) OVER (PARTITION BY day, band, island) AS inside_to FROM i)
SELECT seq, CAST(band AS INTEGER) AS band, side FROM s WHERE side IS NOT NULL AND last_side IS NULL AND (inside_to - inside_from >= 1800000000 OR island = 0)""")
def touch_rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches after at least half an hour inside the band without a break, or the first of the day that comes from inside."""
    order = Window.partitionBy("day", "band").orderBy("us", "seq")
    inside = F.when(F.col("side").isNull(), F.col("us"))
    s = sided(spark, sf_dir).withColumns({"island": F.count("side").over(order.rowsBetween(Window.unboundedPreceding, -1)), "last_side": F.lag("side").over(order)})
    w = Window.partitionBy("day", "band", "island")
    s = s.withColumn("inside_us", F.max(inside).over(w) - F.min(inside).over(w))
    return s.filter(F.col("side").isNotNull() & F.col("last_side").isNull() & ((F.col("inside_us") >= 1_800_000_000) | (F.col("island") == 0))).select("seq", "band", "side")
