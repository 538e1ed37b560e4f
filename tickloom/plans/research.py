"""Registered queries on levels, lagged states, path simulation, folds, policies and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import edge_bucket, safe_div
from tickloom.operators.follow import follow
from tickloom.operators.paths import draw, drawdowns, ended, lockout, nearest_quantile, positions
from tickloom.operators.ranks import cumulative, interpolated, picked, ranked
from tickloom.operators.segments import haloed, own, trailing_changes, trailing_sum, upto
from tickloom.operators.temporal import asof
from tickloom.plans import views as v
from tickloom.plans.market import BANDED, BARS, bars, by_day, entries, query

#: Paths of the bootstrap.
PATHS = 1000
_W = "PARTITION BY day ORDER BY us, seq"
_U = "PARTITION BY day ORDER BY us"


@query(f"""WITH {v.TRADES}, r AS (SELECT key, price, row_number() OVER (PARTITION BY key ORDER BY price) AS i, count(*) OVER (PARTITION BY key) AS n FROM trades WHERE price IS NOT NULL)
 SELECT key, max(CASE WHEN i = 1 + ((n - 1) * 10 + 50) // 100 THEN price END) AS q10, max(CASE WHEN i = 1 + ((n - 1) * 50 + 50) // 100 THEN price END) AS q50, max(CASE WHEN i = 1 + ((n - 1) * 90 + 50) // 100 THEN price END) AS q90 FROM r GROUP BY key""")
def quantile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_quantile(v.trades(spark, sf_dir), ["key"], "price", [10, 50, 90])


@query(f"WITH {v.TRADES} SELECT key, round(quantile_cont(price, 0.1), 4) AS q10, round(quantile_cont(price, 0.9), 4) AS q90, round(stddev_samp(price), 4) AS sd, round(stddev_pop(price), 4) AS sd0 FROM trades GROUP BY key")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles and both deviations."""
    t = v.trades(spark, sf_dir)
    spread = t.groupBy("key").agg(F.round(F.stddev_samp("price"), 4).alias("sd"), F.round(F.stddev_pop("price"), 4).alias("sd0"))
    q = interpolated(t, ["key"], "price", {"q10": 0.1, "q90": 0.9})
    return q.select("key", F.round("q10", 4).alias("q10"), F.round("q90", 4).alias("q90")).join(spread, "key")


@query("SELECT count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (ts IS NULL) AS ts, count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (event_type IS NULL) AS event_type, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (props IS NULL) AS props FROM events")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))


_M = "us // 60000000 % 1440"


def _minute():
    return F.floor(F.col("us") / 60_000_000) % 1440


@query(f"""WITH {v.TRADES}, o AS (SELECT day, max(price) AS high, min(price) AS low FROM trades WHERE {_M} >= 570 AND {_M} < 600 GROUP BY day)
 SELECT seq, CASE WHEN {_M} >= 600 THEN high END AS or_high, CASE WHEN {_M} >= 600 THEN low END AS or_low, CASE WHEN {_M} >= 600 AND high <> low THEN round((price - low) / (high - low), 4) END AS or_position FROM trades LEFT JOIN o USING (day)""")
def opening_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the first half-hour from 9:30, and where later prints lie in it; earlier prints know nothing of it."""
    t, m = v.trades(spark, sf_dir), _minute()
    o = t.filter((m >= 570) & (m < 600)).groupBy("day").agg(F.max("price").alias("high"), F.min("price").alias("low"))
    known = m >= 600
    high, low = F.when(known, F.col("high")), F.when(known, F.col("low"))
    return t.join(o, "day", "left").select("seq", high.alias("or_high"), low.alias("or_low"), F.round(safe_div(F.col("price") - low, high - low), 4).alias("or_position"))


@query(f"""WITH {v.TRADES}, d AS (SELECT day, max(price) FILTER ({_M} >= 960) AS ph, min(price) FILTER ({_M} >= 960) AS pl, max(price) FILTER ({_M} < 570) AS h, min(price) FILTER ({_M} < 570) AS l FROM trades GROUP BY day)
 SELECT day, greatest(lag(ph) OVER (ORDER BY day), h) AS overnight_high, least(lag(pl) OVER (ORDER BY day), l) AS overnight_low FROM d""")
def overnight_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the event day before after 16:00 and of the day before 9:30; the window runs over one row a day."""
    m, p, w = _minute(), F.col("price"), Window.orderBy("day")
    late, early = F.when(m >= 960, p), F.when(m < 570, p)
    d = v.trades(spark, sf_dir).groupBy("day").agg(F.max(late).alias("ph"), F.min(late).alias("pl"), F.max(early).alias("h"), F.min(early).alias("l"))
    return d.select("day", F.greatest(F.lag("ph").over(w), "h").alias("overnight_high"), F.least(F.lag("pl").over(w), "l").alias("overnight_low"))


@query(f"""WITH {v.TRADES}, o AS (SELECT day AS d, us AS u, price AS was FROM trades QUALIFY row_number() OVER (PARTITION BY day, us ORDER BY seq DESC) = 1)
 SELECT seq, CASE WHEN price > 0 AND was > 0 THEN round(ln(price / was), 5) END AS ret FROM trades ASOF LEFT JOIN o ON day = d AND us - 300000000 >= u""")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log return against the last price at least 300 s old; a null price there stays null."""
    t = v.trades(spark, sf_dir)
    old = t.select("day", "us", "seq", F.col("price").alias("px"))
    r = asof(t, old, ["day"], ["px"], "was", lag_us=300_000_000)
    return r.select("seq", F.when((F.col("price") > 0) & (F.col("was.px") > 0), F.round(F.ln(F.col("price") / F.col("was.px")), 5)).alias("ret"))


@query(f"""WITH {v.TRADES}, s AS (SELECT seq, sum(price * volume) OVER a AS pa, sum(volume) OVER a AS va, sum(price * volume) OVER b AS pb, sum(volume) OVER b AS vb FROM trades
 WINDOW a AS ({_U} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS ({_U} RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING))
 SELECT seq, CASE WHEN round((pa / va - pb / vb) / 3600, 6) = 0 THEN 0.0::DOUBLE ELSE round((pa / va - pb / vb) / 3600, 6) END AS slope FROM s""")
def vwap_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change a second of the session VWAP, before now against an hour ago."""
    at = lambda us: Window.partitionBy("day").orderBy("us").rangeBetween(Window.unboundedPreceding, -us)
    vwap = lambda us: safe_div(F.sum(F.col("price") * F.col("volume")).over(at(us)), F.sum("volume").over(at(us)))
    return v.trades(spark, sf_dir).select("seq", F.round((vwap(1) - vwap(3_600_000_000)) / 3600, 6).alias("slope"))


@query(f"""WITH {v.TRADES}, d AS (SELECT *, power(price - lag(price) OVER ({_W}), 2) AS d2 FROM trades)
 SELECT seq, round(sqrt(greatest(0, sum(d2) OVER n - coalesce(first_value(d2) OVER n, 0))) - sqrt(greatest(0, sum(d2) OVER o - coalesce(first_value(d2) OVER o, 0))), 3) AS dsigma FROM d
 WINDOW n AS ({_U} RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), o AS ({_U} RANGE BETWEEN 7200000000 PRECEDING AND 3600000000 PRECEDING)""")
def dsigma_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of realised volatility between the two last hours."""
    on, hour = ["day"], 3_600_000_000
    d = haloed(v.trades(spark, sf_dir).select("day", "us", "seq", "price"), "us", 2 * hour)
    order = Window.partitionBy("day", "_part").orderBy("us", "seq")
    d = d.withColumn("d2", F.pow(F.col("price") - F.lag("price").over(order), 2))
    earlier = F.coalesce(F.sum("d2").over(upto(on, hour)), F.lit(0.0)) - F.coalesce(F.sum(F.lead("d2").over(order)).over(upto(on, 2 * hour + 1)), F.lit(0.0))
    d = own(d.withColumns({"now": trailing_changes(F.col("d2"), on, 3600), "then": earlier}))
    vol = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col(c)))
    return d.select("seq", F.round(vol("now") - vol("then"), 3).alias("dsigma"))


@query(f"WITH {BARS} SELECT seq, bars.bar, bars.close FROM trades ASOF LEFT JOIN bars ON trades.day = bars.day AND us // 3600000000 > bars.bar")
def last_completed_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar that ended before a print's own: each print's bar exists, so the one before it is a lag."""
    w = Window.partitionBy("day").orderBy("bar")
    b = bars(spark, sf_dir).select("day", F.col("bar").alias("own"), F.lag("bar").over(w).alias("bar"), F.lag("close").over(w).alias("close"))
    t = v.trades(spark, sf_dir).select("seq", "day", F.floor(F.col("us") / 3_600_000_000).alias("own"))
    return t.join(b, ["day", "own"]).select("seq", "bar", "close")


@query(f"""WITH {v.TICKS} SELECT p.seq, c.seq AS near_seq FROM ticks p JOIN ticks c ON p.user = c.user AND p.key = 'purchase' AND c.key = 'click' AND abs(c.us - p.us) <= 86400000000
 QUALIFY row_number() OVER (PARTITION BY p.seq ORDER BY abs(c.us - p.us), c.us, CASE WHEN c.us <= p.us THEN -c.seq ELSE c.seq END) = 1""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click nearest to each purchase of a user within a day: two as-of joins, the earlier click on a tie."""
    t = v.ticks(spark, sf_dir).select("user", "us", "seq", "key")
    clicks = t.filter("key = 'click'").select("user", "us", "seq", F.col("us").alias("at"), F.col("seq").alias("id"))
    p = asof(asof(t.filter("key = 'purchase'"), clicks, ["user"], ["at", "id"], "b"), clicks, ["user"], ["at", "id"], "f", forward=True)
    back, forth = F.col("us") - F.col("b.at"), F.col("f.at") - F.col("us")
    earlier = back.isNotNull() & (forth.isNull() | (back <= forth))
    return p.filter(F.least(back, forth) <= 86_400_000_000).select("seq", F.when(earlier, F.col("b.id")).otherwise(F.col("f.id")).alias("near_seq"))


_EXITS = BANDED + """, path AS (SELECT e.band, e.side, e.us, e.seq, t.us AS tus, t.seq AS at_seq, CASE WHEN e.side = 'upper' THEN e.price - t.price ELSE t.price - e.price END AS gain
 FROM entries e JOIN trades t ON e.day = t.day AND t.us BETWEEN e.us AND e.us + 3600000000),
 hits AS (SELECT band, side, us, seq, min({'a': tus, 's': at_seq}) FILTER (gain >= 10) AS won, min({'a': tus, 's': at_seq}) FILTER (gain <= -15) AS lost, max({'a': tus, 's': at_seq, 'g': gain}) AS final FROM path GROUP BY ALL),
 done AS (SELECT CAST(band AS INTEGER) AS band, side, us, seq, CASE WHEN won IS NOT NULL AND (lost IS NULL OR won < lost) THEN 'target' WHEN lost IS NOT NULL THEN 'stop' ELSE 'time' END AS reason, won, lost, final FROM hits),
 trades_done AS (SELECT band, side, us, seq, reason, CASE reason WHEN 'target' THEN won.a WHEN 'stop' THEN lost.a ELSE final.a END AS exit_us, CASE reason WHEN 'target' THEN 10.0::DOUBLE WHEN 'stop' THEN -15.0::DOUBLE ELSE final.g END AS pnl FROM done)"""


def _exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are shuffled once to a bucket of time, where their first hits are searched for; no entry is paired with its path."""
    e = entries(spark, sf_dir).select("band", "side", "us", "seq", "day", "price", F.when(F.col("side") == "upper", -1).otherwise(1).alias("d"))
    target, stop = 10, 15
    f = follow(e, v.trades(spark, sf_dir), 3600, {"won": (1, ">=", target), "lost": (1, "<=", -stop)}, {"final": 3600})
    return ended(f, ["band", "side", "us", "seq"], F.col("d") * (F.col("final.px") - F.col("price")), target, stop)


@query(f"WITH {_EXITS} SELECT band, side, seq, reason, exit_us, round(pnl, 4) AS pnl FROM trades_done")
def exit_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fading each band entry with a target of 10, a stop of 15 and an hour's time limit."""
    return _exits(spark, sf_dir).select("band", "side", "seq", "reason", "exit_us", F.round("pnl", 4).alias("pnl"))


@query(f"""WITH RECURSIVE {_EXITS}, x AS MATERIALIZED (SELECT band, side, us, seq, exit_us FROM trades_done), kept(band, side, us, seq, exit_us) AS (
 SELECT * FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY band, side ORDER BY us, seq) = 1)
 UNION ALL SELECT n.* FROM kept, LATERAL (SELECT * FROM x WHERE x.band = kept.band AND x.side = kept.side AND x.us > kept.exit_us ORDER BY x.us, x.seq LIMIT 1) n) SELECT * FROM kept""")
def trade_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockout(_exits(spark, sf_dir), ["band", "side"])


_BW = "PARTITION BY day ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW"


@query(f"""WITH {v.BOOK} SELECT seq, count(*) FILTER (side = 0 AND action = 0) OVER w AS bid_adds, count(*) FILTER (side = 1 AND action = 0) OVER w AS ask_adds, count(*) FILTER (side = 0 AND action = 2) OVER w AS bid_removes,
 count(*) FILTER (side = 1 AND action = 2) OVER w AS ask_removes FROM book WINDOW w AS ({_BW})""")
def action_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and removals of each side over the last hour."""
    kinds = {f"{name}_{what}": (side, action) for side, name in ((0, "bid"), (1, "ask")) for action, what in ((0, "adds"), (2, "removes"))}
    rows = haloed(v.book_updates(spark, sf_dir).select("day", "us", "seq", "side", "action"), "us", 3_600_000_000)
    rows = rows.withColumns({n: trailing_sum(((F.col("side") == s) & (F.col("action") == a)).cast("long"), ["day"], 3600) for n, (s, a) in kinds.items()})
    return own(rows).select("seq", *kinds)


@query(f"""WITH {v.TICKS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user ORDER BY us, seq) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM ticks), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user ORDER BY us, seq) AS island FROM g)
 SELECT seq, us - min(us) OVER (PARTITION BY user, island) AS age_us FROM i""")
def order_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since a key was first seen without a gap of more than a day: the last start at or before each row."""
    w = Window.partitionBy("user").orderBy("us", "seq")
    gap = F.col("us") - F.lag("us").over(w)
    start = F.when(gap.isNull() | (gap > 86_400_000_000), F.col("us"))
    return v.ticks(spark, sf_dir).withColumn("start", start).select("seq", (F.col("us") - F.last("start", ignorenulls=True).over(w)).alias("age_us"))


@query(f"""WITH {v.LEDGER}, r AS (SELECT *, row_number() OVER (ORDER BY day, trade_id) - 1 AS i, count(*) OVER () AS n FROM ledger), b AS (SELECT *, CAST(i >= round_even(n / 4.0, 0) AS INTEGER) + CAST(i >= round_even(2 * n / 4.0, 0) AS INTEGER) + CAST(i >= round_even(3 * n / 4.0, 0) AS INTEGER) AS fold,
 CASE WHEN i * 10 < n * 6 THEN 'train' WHEN i * 10 < n * 8 THEN 'validate' ELSE 'test' END AS part FROM r) SELECT fold, part, count(*) AS n, min(day) AS first_day, max(day) AS last_day, CAST(sum(pnl) AS BIGINT) AS pnl FROM b GROUP BY ALL""")
def rounded_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four folds with bounds rounded half to even, and a 60/20/20 split, in the order of day and trade."""
    p = positions(v.ledger(spark, sf_dir), "day", ["trade_id"])
    fold = sum(((F.col("i") >= F.bround(F.col("n") * k / 4)).cast("int") for k in (1, 2, 3)), F.lit(0))
    part = F.when(F.col("i") * 10 < F.col("n") * 6, "train").when(F.col("i") * 10 < F.col("n") * 8, "validate").otherwise("test")
    return p.groupBy(fold.alias("fold"), part.alias("part")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("pnl").alias("pnl"))


@query(f"""WITH {v.LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY pnl DESC, trade_id) AS top, row_number() OVER (PARTITION BY gate ORDER BY pnl, trade_id) AS bottom FROM ledger)
 SELECT gate, round(sum(pnl) FILTER (top <= 10) / sum(pnl) FILTER (pnl > 0), 6) AS top_share, round(sum(pnl) FILTER (bottom <= 10) / sum(pnl) FILTER (pnl < 0), 6) AS bottom_share FROM r GROUP BY gate""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten best trades in all profit and of the ten worst in all loss; only those ten leave each task."""
    ledger, pnl = v.ledger(spark, sf_dir), F.col("pnl")
    ends = [ledger.withColumn("k", F.row_number().over(Window.partitionBy("gate").orderBy(o, "trade_id"))).filter("k <= 10").groupBy("gate").agg(F.sum("pnl").alias(n)) for o, n in ((F.desc("pnl"), "top"), (F.asc("pnl"), "bottom"))]
    sums = ledger.groupBy("gate").agg(F.sum(F.when(pnl > 0, pnl)).alias("won"), F.sum(F.when(pnl < 0, pnl)).alias("lost"))
    return sums.join(ends[0], "gate").join(ends[1], "gate").select("gate", F.round(F.col("top") / F.col("won"), 6).alias("top_share"), F.round(F.col("bottom") / F.col("lost"), 6).alias("bottom_share"))


@query("""
WITH x AS (
  SELECT CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem
), r AS (
  SELECT *, d / 10.0::DOUBLE AS p, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS k FROM x
)
SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc,
  round(sum((d - 10 * y) * (d - 10 * y))::DOUBLE / (100 * count(*)), 9) AS brier,
  round(-avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 0.999), 0.001)) ELSE ln(1 - greatest(least(p, 0.999), 0.001)) END), 6) AS logloss
FROM r""")
def auc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve, Brier score and log loss of a score, from counts by distinct score; squares add up as integers."""
    cents = F.round(F.col("l_discount") * 100).cast("long").alias("d")
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(cents, (F.col("l_returnflag") == "R").cast("long").alias("y"))
    c = x.groupBy("d").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    c = cumulative(c, [], "d", ["neg"])
    below = F.col("upto_neg") - F.col("neg")
    q = F.greatest(F.least(F.col("d") / 10, F.lit(0.999)), F.lit(0.001))
    s = c.withColumns({
        "area": F.col("pos") * (below + F.col("neg") / 2),
        "square": F.col("pos") * (F.col("d") - 10) * (F.col("d") - 10) + F.col("neg") * F.col("d") * F.col("d"),
        "log": -F.col("pos") * F.ln(q) - F.col("neg") * F.ln(1 - q),
    })
    n = F.sum("pos") + F.sum("neg")
    auc = F.sum("area") / (F.sum("pos") * F.sum("neg"))
    return s.agg(F.round(auc, 6).alias("auc"), F.round(F.sum("square") / (100 * n), 9).alias("brier"), F.round(F.sum("log") / n, 6).alias("logloss"))


def _draw_sql(*parts: str) -> str:
    x = "12345"
    for part in parts:
        x = f"((({x}) + {part})::BIGINT * 1103515245 + 12345) % 2147483648"
        x = f"xor(({x}), ({x}) // 65536) % 2147483648"
    return x


@query(f"""WITH {v.LEDGER}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS i, sum(pnl) AS pnl FROM ledger GROUP BY day), s AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n, row_number() OVER (PARTITION BY seed ORDER BY {_draw_sql('seed', 'i')}, i) AS place FROM d, range(1, 21) t(seed))
 SELECT CAST(seed AS INTEGER) AS seed, count(*) FILTER (place * 4 > n * 3) AS test_days, CAST(sum(pnl) FILTER (place * 4 <= n * 3) AS BIGINT) AS train_pnl, CAST(sum(pnl) FILTER (place * 4 > n * 3) AS BIGINT) AS test_pnl FROM s GROUP BY seed""")
def day_shuffle_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty shuffles of the days, by a draw and not by an engine's hash; the last quarter is the test. Works on a row a day."""
    d = v.ledger(spark, sf_dir).groupBy("day").agg(F.sum("pnl").alias("pnl"))
    d = d.withColumns({"i": F.row_number().over(Window.orderBy("day")), "n": F.count("*").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    s = d.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(20))))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(draw(F.col("seed"), F.col("i")), "i")))
    test = F.col("place") * 4 > F.col("n") * 3
    return s.groupBy("seed").agg(F.count_if(test).alias("test_days"), F.sum(F.when(~test, F.col("pnl"))).alias("train_pnl"), F.sum(F.when(test, F.col("pnl"))).alias("test_pnl"))


@query(f"""WITH {v.LEDGER}, d AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, sum(pnl) AS pnl FROM ledger GROUP BY day), n AS (SELECT count(*) AS n FROM d), k AS (SELECT path, step, {_draw_sql('path', 'step')} % n AS i FROM n, range(1, {PATHS + 1}) p(path), LATERAL (SELECT unnest(range(0, n)) AS step)),
 e AS (SELECT path, step, sum(pnl) OVER (PARTITION BY path ORDER BY step) AS equity FROM k JOIN d USING (i)), m AS (SELECT *, max(equity) OVER (PARTITION BY path ORDER BY step) - equity AS down FROM e)
 SELECT CAST(path AS INTEGER) AS path, CAST(arg_max(equity, step) AS BIGINT) AS final, CAST(max(down) AS BIGINT) AS max_drawdown FROM m GROUP BY path""")
def bootstrap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand equity paths of days drawn with replacement, their ends and drawdowns, in parts of 200 steps."""
    d = v.ledger(spark, sf_dir).groupBy("day").agg(F.sum("pnl").alias("pnl"))
    whole = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"i": (F.row_number().over(Window.orderBy("day")) - 1).cast("long"), "n": F.count("*").over(whole)})
    k = d.select(F.col("i").alias("step"), "n", F.explode(F.sequence(F.lit(1), F.lit(PATHS))).alias("path")).select("path", "step", (draw(F.col("path"), F.col("step")) % F.col("n")).alias("i"))
    paths = drawdowns(k.join(d.select("i", "pnl"), "i"), ["path"], ["step"], "pnl", 200)
    return paths.select("path", F.col("total").alias("final"), "max_drawdown")


@query(f"""WITH {v.TRADES}, f AS (SELECT user, day, min({{'us': us, 'seq': seq, 'price': price}}) AS hit FROM trades WHERE price >= 20 GROUP BY user, day),
 w AS (SELECT f.user, f.day, f.hit.seq AS first_seq, f.hit.price AS first_price, min({{'us': t.us, 'seq': t.seq, 'price': t.price}}) AS late FROM f LEFT JOIN trades t ON f.user = t.user AND f.day = t.day AND t.us >= f.hit.us AND ((t.us <= f.hit.us + 7200000000 AND t.price >= 60) OR (t.us >= f.hit.us + 7200000000 AND t.price >= 30)) GROUP BY ALL)
 SELECT user, day, first_seq, first_price, CASE WHEN first_price >= 80 THEN first_price ELSE late.price END AS waited_price FROM w""")
def option_wait_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hit of 20 per user and day, and what waiting takes: 60 within two hours, else the next 30; 80 at once."""
    t = v.trades(spark, sf_dir)
    at = F.struct("us", "seq", "price")
    w = Window.partitionBy("user", "day")
    hit = t.withColumn("hit", F.min(F.when(F.col("price") >= 20, at)).over(w)).filter("hit IS NOT NULL")
    limit = F.col("hit.us") + 7_200_000_000
    ok = (F.col("us") >= F.col("hit.us")) & (((F.col("us") <= limit) & (F.col("price") >= 60)) | ((F.col("us") >= limit) & (F.col("price") >= 30)))
    g = hit.groupBy("user", "day").agg(F.first("hit").alias("hit"), F.min(F.when(ok, at)).alias("late"))
    return g.select("user", "day", F.col("hit.seq").alias("first_seq"), F.col("hit.price").alias("first_price"), F.when(F.col("hit.price") >= 80, F.col("hit.price")).otherwise(F.col("late.price")).alias("waited_price"))


@query("""WITH g AS (SELECT CAST(a AS DOUBLE) / 100 AS edge, CAST(b AS DOUBLE) / 100 AS tail FROM range(0, 10, 2) x(a), range(0, 8, 2) y(b))
 SELECT edge, tail, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem, g WHERE CAST(l_discount AS DOUBLE) >= edge AND CAST(l_tax AS DOUBLE) >= tail GROUP BY ALL""")
def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair of thresholds selects, from counts by distinct pair of values, not from all rows."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = x.groupBy(F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t")).agg(F.count("*").alias("m"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    grid = F.array(*(F.struct(F.lit(a / 100).alias("edge"), F.lit(b / 100).alias("tail")) for a in range(0, 10, 2) for b in range(0, 8, 2)))
    picked = c.withColumn("g", F.explode(grid)).filter("d >= g.edge AND t >= g.tail")
    return picked.groupBy("g.edge", "g.tail").agg(F.sum("m").alias("n"), F.sum("q").alias("quantity"))


@query(f"WITH {v.FEAT}, b AS (SELECT CASE WHEN f1 < 0.03 THEN 'low' WHEN f1 < 0.07 THEN 'mid' ELSE 'high' END AS x, f2, target FROM feat) SELECT x, round(avg(target) FILTER (f2 < 0.03), 2) AS low, round(avg(target) FILTER (f2 >= 0.03 AND f2 < 0.06), 2) AS mid, round(avg(target) FILTER (f2 >= 0.06), 2) AS high FROM b GROUP BY x")
def bins_2d_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.feat(spark, sf_dir).select(edge_bucket(F.col("f1"), [0, 0.03, 0.07], ["low", "mid", "high"]).alias("x"), edge_bucket(F.col("f2"), [0, 0.03, 0.06], ["low", "mid", "high"]).alias("y"), "target")
    return b.groupBy("x").pivot("y", ["low", "mid", "high"]).agg(F.round(F.avg("target"), 2))


@query(f"""WITH {v.TRADES}, d AS (SELECT day, round(stddev_samp(price), 6) AS sigma FROM trades GROUP BY day) SELECT day, CAST(least(9, floor((dense_rank() OVER (ORDER BY sigma) - 1) * 10.0 / count(*) OVER ())) AS INTEGER) AS decile FROM d""")
def vol_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rank of each day's deviation over the number of days; works on a row a day."""
    d, w = v.trades(spark, sf_dir).groupBy("day").agg(F.round(F.stddev_samp("price"), 6).alias("sigma")), Window.orderBy("sigma")
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.select("day", F.least(F.lit(9), F.floor((F.dense_rank().over(w) - 1) * 10.0 / n)).cast("int").alias("decile"))


@query(f"""WITH {v.LEDGER}, c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM ledger), (SELECT max(day) FROM ledger), INTERVAL 1 DAY)) AS DATE) AS day), d AS (SELECT day, count(*) AS m FROM ledger WHERE pnl > 0 GROUP BY day)
 SELECT day, coalesce(m, 0) AS n FROM c LEFT JOIN d USING (day)""")
def trade_frequency_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winning trades on every calendar day between the first and the last trade, 0 where there were none."""
    ledger = v.ledger(spark, sf_dir)
    days = ledger.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(ledger.filter("pnl > 0").groupBy("day").agg(F.count("*").alias("m")), "day", "left").select("day", F.coalesce("m", F.lit(0)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"""WITH {v.FEAT}, x AS (SELECT id, CASE WHEN f1 BETWEEN 0.03 AND 0.06 THEN 1 ELSE 0 END AS a, CASE WHEN f3 BETWEEN 10 AND 30 THEN 1 ELSE 0 END AS b, target FROM feat) SELECT 'f1' AS rule, count(*) AS n, round(avg(target), 2) AS mean FROM x WHERE a = 1 UNION ALL SELECT 'f3', count(*), round(avg(target), 2) FROM x WHERE b = 1""")
def rule_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule that an event passes, then outcomes by rule: one scan for all rules."""
    hit = F.array_compact(F.array(F.when(F.col("f1").between(0.03, 0.06), F.lit("f1")), F.when(F.col("f3").between(10, 30), F.lit("f3"))))
    return v.feat(spark, sf_dir).select(F.explode(hit).alias("rule"), "target").groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("target"), 2).alias("mean"))


@query(f"""WITH {v.FEAT}, x AS (SELECT CAST(f1 BETWEEN 0.03 AND 0.06 AS INTEGER) AS a, CAST(f3 BETWEEN 10 AND 30 AS INTEGER) AS b FROM feat), s AS (SELECT sum(a * b)::DOUBLE AS n11, sum(a * (1 - b))::DOUBLE AS n10, sum((1 - a) * b)::DOUBLE AS n01, sum((1 - a) * (1 - b))::DOUBLE AS n00 FROM x)
 SELECT round((n11 * n00 - n10 * n01) / sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 6) AS phi FROM s""")
def phi_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("f1").between(0.03, 0.06), F.col("f3").between(10, 30)
    s = v.feat(spark, sf_dir).agg(*(F.count_if(x).cast("double").alias(n) for x, n in ((a & b, "n11"), (a & ~b, "n10"), (~a & b, "n01"), (~a & ~b, "n00"))))
    return s.select(F.round(safe_div(F.expr("n11 * n00 - n10 * n01"), F.sqrt(F.expr("(n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)"))), 6).alias("phi"))


@query("""WITH x AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS d, CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem),
c AS (SELECT d, sum(y) AS pos, count(*) AS m FROM x GROUP BY d), u AS (SELECT *, sum(pos) OVER w AS tp, sum(m) OVER w AS taken FROM c WINDOW w AS (ORDER BY d DESC))
SELECT round(sum(pos * (tp / taken)) / sum(pos), 6) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives FROM u""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of a score with about as many values as rows: what each score adds to recall times precision there."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("d")
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(cents, (F.col("l_returnflag") == "R").cast("long").alias("y"))
    u = cumulative(x.groupBy("d").agg(F.sum("y").alias("pos"), F.count("*").alias("m")), [], "d", ["pos", "m"], descending=True)
    gained = F.sum(F.col("pos") * (F.col("upto_pos") / F.col("upto_m"))) / F.sum("pos")
    return u.agg(F.round(gained, 6).alias("average_precision"), F.sum("pos").alias("positives"))


@query(f"""WITH {v.FEAT}, r AS (SELECT target, dense_rank() OVER (ORDER BY target) AS k FROM feat), n AS (SELECT max(k) AS n FROM r)
SELECT CAST(floor((k - 1) * 100.0 / n) AS INTEGER) AS percentile, count(*) AS rows, count(DISTINCT target) AS distinct_values, min(target) AS low, max(target) AS high FROM r, n GROUP BY ALL""")
def dense_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, values and range of each percentile of the dense rank of all values."""
    distinct = v.feat(spark, sf_dir).groupBy("target").agg(F.count("*").alias("m"))
    r = ranked(distinct, [], "target", [])
    percentile = F.floor((F.col("rank") - 1) * 100.0 / F.col("n")).cast("int").alias("percentile")
    return r.groupBy(percentile).agg(F.sum("m").alias("rows"), F.count("*").alias("distinct_values"), F.min("target").alias("low"), F.max("target").alias("high"))


#: Mechanisms of an entry by line item: their name, and which rows they take.
MECHANISMS = {"all": "true", "cheap": "f1 <= 0.04", "dear": "f1 >= 0.06"}
INDEX_BINS, LEAST_ROWS = 4, 5
_EDGES = """
edges AS (SELECT mechanism, list(f ORDER BY k) AS e FROM (SELECT mechanism, k, max(CASE WHEN i = CAST(floor(k * m / {bins}.0) AS BIGINT) THEN f END) AS f FROM
  (SELECT mechanism, {f} AS f, row_number() OVER (PARTITION BY mechanism ORDER BY {f}) - 1 AS i, count(*) OVER (PARTITION BY mechanism) AS m FROM taken) r, range(1, {bins}) x(k) GROUP BY mechanism, k) GROUP BY mechanism)"""


def _edges_sql(name: str, feature: str) -> str:
    return _EDGES.format(f=feature, bins=INDEX_BINS).replace("edges AS", f"{name} AS", 1).strip()


@query(f"""WITH {v.FEAT}, taken AS (SELECT m.mechanism, f2, f3, target FROM feat JOIN (VALUES {", ".join(f"('{n}')" for n in MECHANISMS)}) m(mechanism)
  ON CASE m.mechanism {" ".join(f"WHEN '{n}' THEN {c}" for n, c in MECHANISMS.items())} END),
{_edges_sql("ex", "f3")}, {_edges_sql("ey", "f2")},
cells AS (SELECT t.mechanism, len(list_filter(ex.e, lambda c: t.f3 >= c)) AS x, len(list_filter(ey.e, lambda c: t.f2 >= c)) AS y, count(*) AS n, round(avg(CAST(target >= 30000 AS DOUBLE)), 9) AS hit
  FROM taken t JOIN ex USING (mechanism) JOIN ey USING (mechanism) GROUP BY ALL)
SELECT mechanism, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, n, hit, row_number() OVER (PARTITION BY mechanism, n >= {LEAST_ROWS} ORDER BY hit DESC, n DESC, x, y) = 1 AND n >= {LEAST_ROWS} AS best FROM cells""")
def index_edge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features cut at the values that stand at equal shares of each mechanism's sorted rows, hits by cell, and the best cell.

    A value on an edge goes to the higher bin; equal edges leave a bin empty. Edges are a row for each mechanism and
    broadcast, so that no task gets all rows of one. Windows at the end run over cells only.
    """
    named = F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in MECHANISMS.items()))
    taken = v.feat(spark, sf_dir).select("f1", "f2", "f3", "target", F.explode(F.array_compact(named)).alias("mechanism"))
    cells = taken
    for name, feature in (("x", "f3"), ("y", "f2")):
        places = {f"{name}{k}": F.floor(F.lit(k) * F.col("n") / float(INDEX_BINS)) for k in range(1, INDEX_BINS)}
        edges = picked(taken, ["mechanism"], feature, places).select("mechanism", F.array(*places).alias("e"))
        cells = cells.join(F.broadcast(edges), "mechanism").withColumn(name, F.size(F.filter("e", lambda c: F.col(feature) >= c))).drop("e")  # noqa: B023
    cells = cells.groupBy("mechanism", "x", "y").agg(F.count("*").alias("n"), F.round(F.avg((F.col("target") >= 30000).cast("double")), 9).alias("hit"))
    enough = F.col("n") >= LEAST_ROWS
    order = Window.partitionBy("mechanism", enough).orderBy(F.desc("hit"), F.desc("n"), "x", "y")
    return cells.withColumn("best", (F.row_number().over(order) == 1) & enough)
