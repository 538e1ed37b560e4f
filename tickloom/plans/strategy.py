"""Registered queries on labelled outcomes, refined entries, gate grids over anchored folds, and rule candidates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import at_least, safe_div
from tickloom.operators.follow import LATER, follow
from tickloom.operators.paths import nearest_quantile, outlook, positions
from tickloom.operators.segments import scan
from tickloom.operators.temporal import greedy_spacing
from tickloom.plans import views as v
from tickloom.plans.market import BANDED, BARS, OUTCOME, bars, entries, outcomes, query, with_vwap

HORIZONS = (300, 600, 900, 1200, 1800, 2700, 3600, 5400, 7200, 10800, 14400, 21600)
PRINTS = (2, 5, 10, 20, 50, 100, 200, 500)
_DIRECTION = "CASE side WHEN 'upper' THEN -1 ELSE 1 END"


def direction() -> Column:
    """Touches are faded: a touch of the upper band sells."""
    return F.when(F.col("side") == "upper", -1).otherwise(1)


def _outcome_sql(kind: str, sizes: tuple[int, ...], frame: str) -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT seq, {n} AS horizon, count(*) OVER h AS n, max(price) OVER h AS high, min(price) OVER h AS low, last_value(price) OVER h AS at_end FROM trades WINDOW h AS ({frame.format(n=n, last=n * 1000000 - 1, rows=n - 1)})"
        for n in sizes
    )
    return f"""WITH {BANDED}, a AS ({parts}), o AS (SELECT e.seq, CAST(band AS INTEGER) AS band, horizon, {_DIRECTION} AS d, price, n, high, low, at_end FROM entries e JOIN a USING (seq) WHERE n > 1)
SELECT seq, band, CAST(horizon AS INTEGER) AS horizon, '{kind}' AS kind, round(CASE d WHEN 1 THEN high - price ELSE price - low END, 4) AS mfe, round(CASE d WHEN 1 THEN price - low ELSE high - price END, 4) AS mae,
  round(d * (at_end - price), 4) AS end_ret, round(greatest(0, CASE d WHEN 1 THEN high - price ELSE price - low END), 4) AS mr FROM o"""


def _outcomes(spark: SparkSession, sf_dir: str, kind: str, reaches: tuple[int, ...], unit: int, along: str) -> DataFrame:
    """Long outcomes of every touch."""
    p = F.col("price")
    prints = with_vwap(spark, sf_dir).select("day", "us", "seq", "price", "i") if along == "i" else v.trades(spark, sf_dir)
    e = entries(spark, sf_dir)
    e = e.join(prints.select("day", "seq", "i"), ["day", "seq"]) if along == "i" else e
    seen = outlook(e, prints, ["band", "side", "price"], [r * unit for r in reaches], along).filter("n > 1")
    o = seen.withColumns({"d": direction(), "horizon": (F.col("reach") / unit).cast("int")})
    up, down = F.col("high") - p, p - F.col("low")
    mfe = F.when(F.col("d") == 1, up).otherwise(down)
    return o.select(
        "seq", "band", "horizon", F.lit(kind).alias("kind"), F.round(mfe, 4).alias("mfe"), F.round(F.when(F.col("d") == 1, down).otherwise(up), 4).alias("mae"),
        F.round(F.col("d") * (F.col("at_end") - p), 4).alias("end_ret"), F.round(F.greatest(F.lit(0.0), mfe), 4).alias("mr"),
    )


@query(_outcome_sql("time", HORIZONS, "PARTITION BY day ORDER BY us RANGE BETWEEN CURRENT ROW AND {last} FOLLOWING"))
def outcome_horizons_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourable and adverse excursion, end return and reversion of every touch within twelve times."""
    return _outcomes(spark, sf_dir, "time", HORIZONS, 1_000_000, "us")


@query(_outcome_sql("prints", PRINTS, "PARTITION BY day ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND {rows} FOLLOWING"))
def outcome_horizons_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within eight numbers of prints, the touch itself included."""
    return _outcomes(spark, sf_dir, "prints", PRINTS, 1, "i")


ADVERSE, SEARCH = 1, 3600
REFINED = BANDED + f""", r AS (SELECT e.seq, e.band, e.side, e.day, e.k AS ek, e.user AS euser, e.us AS touched, {_DIRECTION} AS d, t.us, t.seq AS entry_seq, t.price AS entry,
    row_number() OVER (PARTITION BY e.seq, e.band ORDER BY t.us, t.seq) AS r
  FROM entries e JOIN trades t ON t.day = e.day AND t.us > e.us AND t.us <= e.us + {SEARCH}000000 AND {_DIRECTION} * (e.price - t.price) >= {ADVERSE}),
 refined AS (SELECT * FROM r WHERE r = 1)"""


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches with the first print within the hour that is a point worse, where they enter; others don't."""
    t = v.trades(spark, sf_dir)
    e = entries(spark, sf_dir, "k", "user").select("seq", "band", "side", "day", F.col("k").alias("ek"), F.col("user").alias("euser"), "us", "price", direction().alias("d"))
    found = follow(e, t, SEARCH, {"f": (-1, ">=", ADVERSE)}, {}, LATER).filter("f IS NOT NULL")
    return found.select("seq", "band", "side", "day", "ek", "euser", "d", F.col("us").alias("touched"), F.col("f.at").alias("us"), F.col("f.at_seq").alias("entry_seq"), F.col("f.px").alias("entry"))


@query(f"WITH {REFINED} SELECT seq, CAST(band AS INTEGER) AS band, entry_seq, us AS entry_us, entry, us - touched AS waited_us FROM refined")
def refined_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).select("seq", "band", "entry_seq", F.col("us").alias("entry_us"), "entry", (F.col("us") - F.col("touched")).alias("waited_us"))


# Fixed values of the grid, in points; seconds and the search for an entry fit the density of the tables.
TARGETS, STOPS, TIMES, FOLDS = tuple(range(2, 11)), tuple(range(4, 9)), (900, 1800, 3600, 7200), 4
_EVENTS = ", ".join(f"({x})" for x in TARGETS), ", ".join(f"({x})" for x in STOPS), ", ".join(f"({x})" for x in TIMES)
GRID = REFINED + f""", cut AS (SELECT *, row_number() OVER (ORDER BY day, us, entry_seq, seq, band) - 1 AS i, count(*) OVER () AS n FROM refined),
 rows AS MATERIALIZED (SELECT *, least({FOLDS - 1}, i * {FOLDS} // n) AS fold FROM cut),
 path AS MATERIALIZED (SELECT c.seq, c.band, t.us AS tm, t.seq AS at_seq, t.us - c.us AS held, d * (t.price - entry) AS gain
   FROM rows c JOIN trades t ON t.day = c.day AND (t.us > c.us OR t.us = c.us AND t.seq >= c.entry_seq) AND t.us <= c.us + {max(TIMES)}000000),
 won AS (SELECT seq, band, x AS target, min(tm) AS tm, arg_min(gain, (tm, at_seq)) AS gain FROM path, (VALUES {_EVENTS[0]}) v(x) WHERE gain >= x GROUP BY ALL),
 lost AS (SELECT seq, band, x AS stop, min(tm) AS tm, arg_min(gain, (tm, at_seq)) AS gain FROM path, (VALUES {_EVENTS[1]}) v(x) WHERE gain <= -x GROUP BY ALL),
 ends AS (SELECT seq, band, x AS time, max(tm) AS tm, arg_max(gain, (tm, at_seq)) AS gain FROM path, (VALUES {_EVENTS[2]}) v(x) WHERE held <= CAST(x AS BIGINT) * 1000000 GROUP BY ALL),
 sims AS MATERIALIZED (SELECT c.*, v.x AS target, s.x AS stop, z.time,
   CASE WHEN w.tm <= z.tm AND (l.tm IS NULL OR w.tm < l.tm) THEN 'target' WHEN l.tm <= z.tm THEN 'stop' ELSE 'time' END AS reason,
   CASE WHEN w.tm <= z.tm AND (l.tm IS NULL OR w.tm < l.tm) THEN w.tm WHEN l.tm <= z.tm THEN l.tm ELSE z.tm END AS exit_us,
   CAST(round(10000 * CASE WHEN w.tm <= z.tm AND (l.tm IS NULL OR w.tm < l.tm) THEN w.gain WHEN l.tm <= z.tm THEN l.gain ELSE z.gain END) AS BIGINT) AS pnl
   FROM rows c CROSS JOIN (VALUES {_EVENTS[0]}) v(x) CROSS JOIN (VALUES {_EVENTS[1]}) s(x) JOIN ends z USING (seq, band)
   LEFT JOIN won w ON w.seq = c.seq AND w.band = c.band AND w.target = v.x LEFT JOIN lost l ON l.seq = c.seq AND l.band = c.band AND l.stop = s.x),
 gated AS (SELECT *, 'single' AS gate FROM sims WHERE ek >= 30 UNION ALL SELECT *, 'all' FROM sims WHERE ek >= 30 AND euser % 2 = 0
   UNION ALL SELECT *, 'two_of_three' FROM sims WHERE CAST(ek >= 30 AS INT) + CAST(euser % 2 = 0 AS INT) + CAST(band = 1 AS INT) >= 2),
 parts AS (SELECT *, fold AS f, 'test' AS part FROM gated WHERE fold > 0 UNION ALL SELECT g.*, x.f, 'train' FROM gated g JOIN range(1, {FOLDS}) x(f) ON g.fold < x.f),
 days AS (SELECT gate, target, stop, time, f, part, day, list({{'us': us, 'out': exit_us, 'pnl': pnl, 'n': CAST(1 AS BIGINT), 'won': CAST(pnl > 0 AS BIGINT), 'hit': CAST(reason = 'target' AS BIGINT), 'lost': CAST(reason = 'stop' AS BIGINT)}}
   ORDER BY us, entry_seq, seq, band) AS x FROM parts GROUP BY ALL),
 kept AS (SELECT *, list_reduce(x, lambda a, b: CASE WHEN b.us <= a.out THEN a ELSE {{'us': b.us, 'out': b.out, 'pnl': a.pnl + b.pnl, 'n': a.n + 1, 'won': a.won + b.won, 'hit': a.hit + b.hit, 'lost': a.lost + b.lost}} END) AS s FROM days),
 sums AS (SELECT gate, target, stop, time, f, part, sum(s.n) AS n, sum(s.pnl) AS pnl, sum(s.won) AS won, sum(s.hit) AS hit, sum(s.lost) AS lost FROM kept GROUP BY ALL),
 folds AS (SELECT b.gate, CAST(b.target AS INTEGER) AS target, CAST(b.stop AS INTEGER) AS stop, CAST(b.time AS INTEGER) AS time, CAST(b.f AS INTEGER) AS fold,
   CAST(a.n AS BIGINT) AS train_n, CAST(b.n AS BIGINT) AS test_n, a.pnl / a.n / 10000 AS train_pnl, b.pnl / b.n / 10000 AS test_pnl, a.won / a.n AS train_win, b.won / b.n AS test_win, b.hit / b.n AS test_hit, b.lost / b.n AS test_stop
   FROM sums b JOIN sums a ON a.gate = b.gate AND a.target = b.target AND a.stop = b.stop AND a.time = b.time AND a.f = b.f AND a.part = 'train' WHERE b.part = 'test')"""
_RATES = ("train_pnl", "test_pnl", "train_win", "test_win", "test_hit", "test_stop")


def grid_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate and every target, stop and time on train and test rows of anchored folds, one trade at a time.

    The path after an entry is searched for the first print of each target and stop and the last one of each time. Entries are shuffled once, with these, to their day and fold; gates and settings are tried there. Paths
    end with the day, so lockouts are folded by day, and the fold keeps sums, no list. A lockout looks back only, so what
    a day adds to training is known fold by fold: the sums of a fold's rows, or for the few days that a fold's bound
    cuts, the sums up to each fold less those up to the one before. Training sums are running sums over folds.
    """
    r = positions(refined(spark, sf_dir), "day", ["us", "entry_seq", "seq", "band"]).withColumn("fold", F.least(F.lit(FOLDS - 1), F.floor(F.col("i") * FOLDS / F.col("n"))).cast("int"))
    whole_day = Window.partitionBy("day")
    r = r.withColumns({"first": F.min("fold").over(whole_day), "last": F.max("fold").over(whole_day)})
    rows = r.select("seq", "band", "ek", "euser", "day", "fold", "first", "last", "d", "us", "entry_seq", "entry")
    hits = {f"won{x}": (1, ">=", x) for x in TARGETS} | {f"lost{x}": (1, "<=", -x) for x in STOPS}
    found = follow(rows.withColumn("price", F.col("entry")), v.trades(spark, sf_dir), max(TIMES), hits, {f"end{x}": x for x in TIMES}, F.col("entry_seq"))

    def points(name: str, values: tuple[int, ...]) -> Column:
        point = lambda n: F.when(F.col(n).isNotNull(), F.struct(f"{n}.at", f"{n}.at_seq", (F.col("d") * (F.col(f"{n}.px") - F.col("entry"))).alias("gain")))
        return F.array(*(point(f"{name}{x}") for x in values)).alias(name)

    found = found.select("seq", "band", "ek", "euser", "day", "fold", "first", "last", "us", "entry_seq", points("won", TARGETS), points("lost", STOPS), points("end", TIMES))
    conditions = [F.col("ek") >= 30, F.col("euser") % 2 == 0, F.col("band") == 1]
    gates = {"single": conditions[0], "all": at_least(conditions[:2], 2), "two_of_three": at_least(conditions, 2)}
    names = ("n", "pnl", "won", "hit", "lost")
    settings = ["target", "stop", "time"]
    own, upto = F.struct(F.lit(True).alias("own"), F.col("fold").alias("f")), F.transform(F.sequence("fold", "last"), lambda f: F.struct(F.lit(False).alias("own"), f.alias("f")))
    cut = F.col("first") < F.col("last")
    x = found.withColumn("g", F.explode(F.when(cut, F.concat(F.array(own), upto)).otherwise(F.array(own))))
    entry = F.struct("us", "entry_seq", "seq", "band", "won", "lost", "end", *(c.alias(f"in_{name}") for name, c in gates.items()))
    days = x.groupBy("day", "g.own", "g.f", "first", "last").agg(F.sort_array(F.collect_list(entry)).alias("x"))

    def through(gate: str) -> Column:
        return F.struct(F.lit(gate).alias("gate"), F.filter("x", lambda b: b[f"in_{gate}"]).alias("e"))

    days = days.select("*", F.inline(F.array(*map(through, gates)))).filter("size(e) > 0")

    def outcome(b: Column, target: Column, stop: Column, time: Column) -> Column:
        """Where a trade ends: the first of target and stop, if in time."""
        won, lost, end = b.won[target], b.lost[stop], b.end[time]
        in_time = lambda c: F.coalesce(c["at"] <= end["at"], F.lit(False))
        by_target = in_time(won) & F.coalesce(won["at"] < lost["at"], F.lit(True))
        ended = lambda p, by: F.struct(p.alias("p"), F.lit(by).alias("by"))
        return F.struct(b.us.alias("us"), F.when(by_target, ended(won, "hit")).when(in_time(lost), ended(lost, "lost")).otherwise(ended(end, "end")).alias("o"))

    def take(acc: Column, b: Column) -> Column:
        pnl = F.round(10000 * b.o.p["gain"]).cast("long")
        adds = {"n": F.lit(1), "pnl": pnl, "won": (pnl > 0).cast("long"), "hit": (b.o.by == "hit").cast("long"), "lost": (b.o.by == "lost").cast("long")}
        more = F.struct(b.o.p["at"].alias("out"), *((acc[n] + adds[n]).cast("long").alias(n) for n in names))
        return F.when((acc.n > 0) & (b.us <= acc.out), acc).otherwise(more)

    def tried(k: Column) -> Column:
        target, stop, time = (k / (len(STOPS) * len(TIMES))).cast("int"), (k / len(TIMES)).cast("int") % len(STOPS), k % len(TIMES)
        trades = F.transform("e", lambda b: outcome(b, target, stop, time))
        start = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("out", *names)))
        at = lambda values, i: F.array(*map(F.lit, values))[i]
        return F.struct(at(TARGETS, target).alias("target"), at(STOPS, stop).alias("stop"), at(TIMES, time).alias("time"), F.aggregate(trades, start, take).alias("s"))

    grid = F.sequence(F.lit(0), F.lit(len(TARGETS) * len(STOPS) * len(TIMES) - 1))
    kept = days.select("gate", "own", "f", "first", "last", F.inline(F.transform(grid, tried))).select("gate", *settings, "own", "f", "first", "last", "s.*")
    # a fold's rows are its test, and its part of training unless their day is cut; sums up to a fold give way to the next ones
    line = lambda f, test, train: F.struct(f.alias("fold"), F.lit(test).alias("test"), F.lit(train).alias("train"))
    by_fold = F.when(F.col("own"), F.array(F.when(cut, line(F.col("f"), 1, 0)).otherwise(line(F.col("f"), 1, 1))))
    by_fold = by_fold.when(F.col("f") < F.col("last"), F.array(line(F.col("f"), 0, 1), line(F.col("f") + 1, 0, -1))).otherwise(F.array(line(F.col("f"), 0, 1)))
    keys = ["gate", *settings]
    sums = kept.select(*keys, *names, F.inline(by_fold)).groupBy(*keys, "fold").agg(*(F.sum(F.col(n) * F.col(part)).alias(f"{part}_{n}") for n in names for part in ("train", "test")))
    earlier = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    wide = sums.withColumns({f"train_{n}": F.sum(f"train_{n}").over(earlier) for n in names}).filter("train_n > 0 AND test_n > 0")
    share = lambda part, n: F.col(f"{part}_{n}") / F.col(f"{part}_n")
    return wide.select(
        *keys, "fold", "train_n", "test_n", (share("train", "pnl") / 10000).alias("train_pnl"), (share("test", "pnl") / 10000).alias("test_pnl"),
        share("train", "won").alias("train_win"), share("test", "won").alias("test_win"), share("test", "hit").alias("test_hit"), share("test", "lost").alias("test_stop"),
    )


@query(f"WITH {GRID} SELECT gate, target, stop, time, fold, train_n, test_n, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM folds")
def gate_grid_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_folds(spark, sf_dir).select("gate", "target", "stop", "time", "fold", "train_n", "test_n", *(F.round(c, 6).alias(c) for c in _RATES))


# Trades that a fold's test needs to count, and the weights of the two scores.
MIN_TEST_TRADES = 15
PNL, WIN, STOPPED, WORSE_PNL, WORSE_WIN, FOLD = 0.95, 0.55, 0.35, 0.25, 0.2, 0.03
STEADY_WIN, UNEVEN_WIN, UNEVEN_PNL = 0.4, 0.45, 0.08


def scored(folds: DataFrame, counted: str) -> DataFrame:
    """Settings with means over their folds and two scores; each fold of ``counted`` (folds or valid) adds to the first."""
    g = folds.groupBy("gate", "target", "stop", "time").agg(
        F.count("*").alias("folds"), F.count_if(F.col("test_n") >= MIN_TEST_TRADES).cast("int").alias("valid"), F.sum("test_n").alias("trades"),
        F.avg(1 - F.col("test_hit") - F.col("test_stop")).alias("timed"), F.avg("test_pnl").alias("pnl"), F.avg("test_win").alias("win"), F.avg("test_stop").alias("stopped"),
        F.avg(F.col("test_pnl") - F.col("train_pnl")).alias("dp"), F.avg(F.col("test_win") - F.col("train_win")).alias("dw"),
        F.coalesce(F.stddev_samp("test_win"), F.lit(0.0)).alias("sw"), F.coalesce(F.stddev_samp("test_pnl"), F.lit(0.0)).alias("sp"),
    )
    worse = lambda c: F.greatest(F.lit(0.0), -F.col(c))
    robust = PNL * F.col("pnl") + WIN * F.col("win") - STOPPED * F.col("stopped") - WORSE_PNL * worse("dp") - WORSE_WIN * worse("dw") + FOLD * F.col(counted)
    stability = F.col("pnl") + STEADY_WIN * F.col("win") - UNEVEN_WIN * F.col("sw") - UNEVEN_PNL * F.col("sp")
    return g.withColumns({"robust": F.round(robust, 4), "stability": F.round(stability, 4)})


@query(f"""WITH {GRID}, g AS (SELECT gate, target, stop, time, count(*) AS folds, CAST(sum(test_n) AS BIGINT) AS trades, avg(test_pnl) AS pnl, avg(test_win) AS win, avg(test_stop) AS stopped,
  avg(test_pnl - train_pnl) AS dp, avg(test_win - train_win) AS dw, coalesce(stddev_samp(test_win), 0) AS sw, coalesce(stddev_samp(test_pnl), 0) AS sp FROM folds GROUP BY ALL),
s AS (SELECT gate, target, stop, time, folds, trades, round(0.95 * pnl + 0.55 * win - 0.35 * stopped - 0.25 * greatest(0, -dp) - 0.2 * greatest(0, -dw) + 0.03 * folds, 4) AS robust, round(pnl + 0.4 * win - 0.45 * sw - 0.08 * sp, 4) AS stability FROM g)
SELECT *, rank() OVER (PARTITION BY gate ORDER BY trades DESC) AS coverage_rank FROM s QUALIFY row_number() OVER (PARTITION BY gate ORDER BY robust DESC, stability DESC, target, stop, time) <= 10""")
def gate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best settings of each gate by a score that takes off what gets worse from train to test, with their rank by trades."""
    s = scored(grid_folds(spark, sf_dir), "folds").select("gate", "target", "stop", "time", "folds", "trades", "robust", "stability")
    best = Window.partitionBy("gate").orderBy(F.desc("robust"), F.desc("stability"), "target", "stop", "time")
    s = s.withColumns({"coverage_rank": F.rank().over(Window.partitionBy("gate").orderBy(F.desc("trades"))), "_r": F.row_number().over(best)})
    return s.filter("_r <= 10").drop("_r")


@query(f"""WITH {GRID}, g AS (SELECT gate, target, stop, time, count(*) AS folds, CAST(sum(CAST(test_n >= {MIN_TEST_TRADES} AS INTEGER)) AS INTEGER) AS valid,
  avg(test_pnl) AS pnl, avg(test_win) AS win, avg(test_hit) AS hit, avg(test_stop) AS stopped, avg(1 - test_hit - test_stop) AS timed, avg(test_n) AS trades,
  avg(test_pnl - train_pnl) AS dp, avg(test_win - train_win) AS dw, coalesce(stddev_samp(test_win), 0) AS sw, coalesce(stddev_samp(test_pnl), 0) AS sp FROM folds GROUP BY ALL)
SELECT gate, target, stop, time, folds, valid, round(trades, 6) AS trades, round(timed, 6) AS timed, CAST(least(3, {FOLDS} - 1 - valid) AS INTEGER) AS coverage_rank,
  CASE WHEN valid >= {max(2, FOLDS - 1)} THEN 'ok' WHEN valid >= 1 THEN 'thin' ELSE 'too_sparse' END AS coverage,
  round(0.95 * pnl + 0.55 * win - 0.35 * stopped - 0.25 * greatest(0, -dp) - 0.2 * greatest(0, -dw) + 0.03 * valid, 4) AS robust, round(pnl + 0.4 * win - 0.45 * sw - 0.08 * sp, 4) AS stability FROM g""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting with the folds whose test has trades enough, its rank and status by them, exits by time, and scores.

    Missing folds count down the rank from 0 (every fold but the first is tested) to 3; a setting is ok if all of them
    count. The score adds something for folds that count, not for all.
    """
    g = scored(grid_folds(spark, sf_dir), "valid")
    status = F.when(F.col("valid") >= max(2, FOLDS - 1), "ok").when(F.col("valid") >= 1, "thin").otherwise("too_sparse")
    return g.select(
        "gate", "target", "stop", "time", "folds", "valid", F.round(F.col("trades") / F.col("folds"), 6).alias("trades"), F.round("timed", 6).alias("timed"),
        F.least(F.lit(3), FOLDS - 1 - F.col("valid")).cast("int").alias("coverage_rank"), status.alias("coverage"), "robust", "stability",
    )


@query(f"""WITH RECURSIVE {OUTCOME}, o AS MATERIALIZED (SELECT seq, us, day, side, band, CASE WHEN n > 1 THEN CASE WHEN side = 'upper' THEN price - low ELSE high - price END END AS mfe,
  CASE WHEN n > 1 THEN CASE WHEN side = 'upper' THEN high - price ELSE price - low END END AS mae FROM entries JOIN ahead USING (seq)),
kept(day, band, side, us, seq) AS (SELECT * FROM (SELECT day, band, side, us, seq FROM o QUALIFY row_number() OVER (PARTITION BY day, band, side ORDER BY us, seq) = 1)
  UNION ALL SELECT n.day, n.band, n.side, n.us, n.seq FROM kept, LATERAL (SELECT * FROM o WHERE o.day = kept.day AND o.band = kept.band AND o.side = kept.side AND o.us - kept.us >= 3600000000 ORDER BY o.us, o.seq LIMIT 1) n)
SELECT seq, CAST(o.band AS INTEGER) AS band, CAST(x.t AS INTEGER) AS target, CASE WHEN mfe IS NOT NULL THEN round(CASE WHEN mfe >= x.t THEN x.t ELSE -least(mae, 12.0) END, 4) END AS pnl
FROM o JOIN kept USING (day, band, side, us, seq) CROSS JOIN (VALUES (4), (8), (16)) x(t)""")
def proxy_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades valued from stored excursions: the target if it was reached, else the loss up to the stop; one an hour a day, band and side."""
    o = outcomes(spark, sf_dir)
    kept = greedy_spacing(o.select("day", "band", "side", "us", "seq"), ["day", "band", "side"], 3_600_000_000)
    t = o.join(kept.select("band", "seq"), ["band", "seq"], "left_semi").withColumn("target", F.explode(F.array(*map(F.lit, (4, 8, 16)))))
    pnl = F.when(F.col("mfe") >= F.col("target"), F.col("target").cast("double")).otherwise(-F.least(F.col("mae"), F.lit(12.0)))
    return t.select("seq", "band", "target", F.when(F.col("mfe").isNotNull(), F.round(pnl, 4)).alias("pnl"))


@query(f"""WITH {OUTCOME}, o AS (SELECT band, side, CASE WHEN side = 'upper' THEN price - low ELSE high - price END AS mfe, CASE WHEN side = 'upper' THEN high - price ELSE price - low END AS mae FROM entries JOIN ahead USING (seq) WHERE n > 1)
SELECT CAST(band AS INTEGER) AS band, side, CAST(l AS INTEGER) AS level, count(*) AS n, round(avg(CAST(mfe >= l AS DOUBLE)), 6) AS reached, round(avg(CAST(mae >= l AS DOUBLE)), 6) AS against,
  round(avg(CAST(mfe >= l AS DOUBLE)) - avg(CAST(mae >= l AS DOUBLE)), 6) AS dominance FROM o, (VALUES (2), (4), (8), (16), (32)) x(l) GROUP BY ALL""")
def structural_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each level is reached in favour of and against a touch."""
    o = outcomes(spark, sf_dir).filter("n > 1").withColumn("level", F.explode(F.array(*map(F.lit, (2, 4, 8, 16, 32)))))
    share = lambda c: F.avg((F.col(c) >= F.col("level")).cast("double"))
    return o.groupBy("band", "side", "level").agg(F.count("*").alias("n"), F.round(share("mfe"), 6).alias("reached"), F.round(share("mae"), 6).alias("against"), F.round(share("mfe") - share("mae"), 6).alias("dominance"))


@query(f"""WITH {v.FEAT}, long AS (SELECT 'f1' AS feature, CAST(round(f1 * 100) AS BIGINT) AS bin, target FROM feat UNION ALL SELECT 'f2', CAST(round(f2 * 100) AS BIGINT), target FROM feat UNION ALL SELECT 'f3', CAST(f3 AS BIGINT) // 5, target FROM feat),
b AS (SELECT feature, bin, count(*) AS n, round(avg(CAST(target >= 30000 AS DOUBLE)), 9) AS hit FROM long GROUP BY ALL)
SELECT feature, count(*) AS bins, CAST(sum(n) AS BIGINT) AS events, min(hit) AS least, max(hit) AS most, round(max(hit) - min(hit), 9) AS spread, arg_max(bin, (hit, -bin)) AS best_bin, arg_max(n, (hit, -bin)) AS best_events FROM b GROUP BY feature""")
def bin_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of hit rates over the bins of each feature, and the first bin with the best."""
    f = v.feat(spark, sf_dir).select(F.round(F.col("f1") * 100).cast("long").alias("f1"), F.round(F.col("f2") * 100).cast("long").alias("f2"), F.floor(F.col("f3").cast("long") / 5).alias("f3"), "target")
    long = f.unpivot(["target"], ["f1", "f2", "f3"], "feature", "bin")
    b = long.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.round(F.avg((F.col("target") >= 30000).cast("double")), 9).alias("hit"))
    best = F.struct("hit", -F.col("bin"))
    return b.groupBy("feature").agg(
        F.count("*").alias("bins"), F.sum("n").alias("events"), F.min("hit").alias("least"), F.max("hit").alias("most"), F.round(F.max("hit") - F.min("hit"), 9).alias("spread"),
        F.max_by("bin", best).alias("best_bin"), F.max_by("n", best).alias("best_events"),
    )


@query(f"""WITH {BARS}, x AS (SELECT day, bar, CASE WHEN high > low THEN high - low END AS width, volume FROM bars),
q AS (SELECT (SELECT list(width ORDER BY width) FROM x WHERE width IS NOT NULL) AS l, (SELECT list(volume ORDER BY volume) FROM x) AS m),
e AS (SELECT x.*, l[(33 * (len(l) - 1) + 50) // 100 + 1] AS lo, l[(66 * (len(l) - 1) + 50) // 100 + 1] AS hi, m[(33 * (len(m) - 1) + 50) // 100 + 1] AS vlo, m[(66 * (len(m) - 1) + 50) // 100 + 1] AS vhi FROM x, q),
r AS (SELECT bar, CASE WHEN width < lo THEN 'low' WHEN width < hi THEN 'mid' WHEN width IS NOT NULL THEN 'high' END AS vol, CASE WHEN volume < vlo THEN 'low' WHEN volume < vhi THEN 'mid' ELSE 'high' END AS speed FROM e)
SELECT bar, vol, speed, 'vol=' || coalesce(vol, 'null') || ' | speed=' || speed AS bucket FROM r""")
def vol_tercile_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terciles of each bar's range and volume, and the two together; unknown stays null but in the joint label."""
    x = bars(spark, sf_dir).select("bar", F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).alias("width"), "volume", F.lit(1).alias("one"))
    w = nearest_quantile(x, ["one"], "width", [33, 66]).withColumnsRenamed({"q33": "lo", "q66": "hi"})
    s = nearest_quantile(x, ["one"], "volume", [33, 66]).withColumnsRenamed({"q33": "vlo", "q66": "vhi"})
    r = x.join(F.broadcast(w), "one", "left").join(F.broadcast(s), "one")  # a row each
    regime = lambda c, lo, hi: F.when(F.col(c) < F.col(lo), "low").when(F.col(c) < F.col(hi), "mid").when(F.col(c).isNotNull(), "high")
    r = r.select("bar", regime("width", "lo", "hi").alias("vol"), regime("volume", "vlo", "vhi").alias("speed"))
    return r.withColumn("bucket", F.concat(F.lit("vol="), F.coalesce("vol", F.lit("null")), F.lit(" | speed="), F.coalesce("speed", F.lit("null"))))


#: Rules by name: column, operator and bounds.
RULES = {"cheap": ("f1", "<=", 0.03), "taxed": ("f2", ">=", 0.05), "large": ("f3", "between", (30, 50)), "dear": ("target", ">", 40000), "small": ("f3", "<", 10)}


def condition(column: str, operator: str, bound) -> Column:
    """A rule as a Column; null inputs don't pass."""
    c = F.col(column)
    if operator == "between":
        return F.coalesce(c.between(*bound), F.lit(False))
    made = {"<=": c <= bound, ">=": c >= bound, "<": c < bound, ">": c > bound, "==": c == bound}
    return F.coalesce(made[operator], F.lit(False))


def _condition_sql(column: str, operator: str, bound) -> str:
    return f"coalesce({column} BETWEEN {bound[0]} AND {bound[1]}, false)" if operator == "between" else f"coalesce({column} {operator} {bound}, false)"


SUBSETS = [c for size in (2, 3) for c in combinations(sorted(RULES), size)]


@query(f"""WITH {v.FEAT}, m AS (SELECT {", ".join(f"CAST({_condition_sql(*r)} AS INT) AS {n}" for n, r in RULES.items())} FROM feat),
c AS ({" UNION ALL ".join(f"SELECT '{'__'.join(s)}' AS rules, CAST(sum(CAST({' + '.join(s)} = {len(s)} AS INT)) AS BIGINT) AS every, CAST(sum(CAST({' + '.join(s)} > 0 AS INT)) AS BIGINT) AS any_of, least({', '.join(f'sum({n})' for n in s)}) AS fewest FROM m" for s in SUBSETS)})
SELECT rules, every, any_of, round(CASE WHEN any_of > 0 THEN every / any_of END, 6) AS jaccard, CASE WHEN every >= 0.8 * any_of OR every >= 0.9 * fewest THEN 'very_high_overlap' WHEN every >= 0.6 * any_of OR every >= 0.75 * fewest THEN 'high_overlap'
  WHEN every >= 0.35 * any_of OR every >= 0.5 * fewest THEN 'moderate_overlap' ELSE 'low_overlap' END AS redundancy FROM c""")
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs and triples of rules with their joint counts and how redundant they are, from one pass."""
    m = v.feat(spark, sf_dir).select(*(condition(*r).cast("int").alias(n) for n, r in RULES.items()))
    counts = [F.sum(n).alias(n) for n in RULES]
    for s in SUBSETS:
        n = sum((F.col(c) for c in s[1:]), F.col(s[0]))
        counts.append(F.struct(F.lit("__".join(s)).alias("rules"), F.sum((n == len(s)).cast("int")).alias("every"), F.sum((n > 0).cast("int")).alias("any_of"), F.least(*(F.sum(c) for c in s)).alias("fewest")).alias("__".join(s)))
    c = m.agg(*counts).select(F.explode(F.array(*("__".join(s) for s in SUBSETS))).alias("c")).select("c.*")
    over = lambda a, b: (F.col("every") >= a * F.col("any_of")) | (F.col("every") >= b * F.col("fewest"))
    flag = F.when(over(0.8, 0.9), "very_high_overlap").when(over(0.6, 0.75), "high_overlap").when(over(0.35, 0.5), "moderate_overlap").otherwise("low_overlap")
    return c.select("rules", "every", "any_of", F.round(safe_div(F.col("every"), F.col("any_of")), 6).alias("jaccard"), flag.alias("redundancy"))


#: Horizon, what is a hit within it, and whether it holds a later print, in SQL.
_HITS = {f"hit_t{n}": (f"hit.us < us + {n}000000", f"n.us < us + {n}000000") for n in HORIZONS}
_HITS |= {f"hit_n{n}": (f"hit.i - i < {n}", "n.us IS NOT NULL") for n in PRINTS}


@query(f"""
WITH {BANDED}, v AS MATERIALIZED (SELECT day, us, seq, price, vwap, row_number() OVER (PARTITION BY day ORDER BY us, seq) AS i FROM banded),
h AS (SELECT day, us, seq, i,
  last_value(CASE WHEN price <= vwap THEN struct_pack(us := us, i := i) END IGNORE NULLS) OVER w AS below,
  last_value(CASE WHEN price >= vwap THEN struct_pack(us := us, i := i) END IGNORE NULLS) OVER w AS above,
  lag(struct_pack(us := us)) OVER w AS n FROM v WINDOW w AS (PARTITION BY day ORDER BY us DESC, seq DESC)),
e AS (SELECT x.seq, x.band, h.us, h.i, h.n, CASE x.side WHEN 'upper' THEN h.below ELSE h.above END AS hit FROM entries x JOIN h USING (day, seq))
SELECT seq, CAST(band AS INTEGER) AS band, hit.us - us AS hit_us, hit.i - i AS hit_prints,
  {", ".join(f"CASE WHEN {seen} THEN coalesce({inside}, false) END AS {name}" for name, (inside, seen) in _HITS.items())} FROM e""")
def vwap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each touch's price first comes back to the session's VWAP, without a limit in the day, and within which horizons.

    The next print at or across the moving VWAP is carried backwards over the day, once for each side, so that no touch
    is joined with its path. A horizon that holds no later print is null.
    """
    at = F.struct("us", "i")
    rows = with_vwap(spark, sf_dir).select("day", "us", "seq", "i", "price", "vwap").withColumns({"back": -F.col("us"), "back_seq": -F.col("seq")})
    crossings = {"below": ("last", F.when(F.col("price") <= F.col("vwap"), at)), "above": ("last", F.when(F.col("price") >= F.col("vwap"), at)), "next": ("previous", F.col("us"))}
    h = scan(rows, ["day"], ["back", "back_seq"], crossings).select("day", "seq", "i", "below", "above", "next")
    e = entries(spark, sf_dir).select("day", "us", "seq", "band", "side").join(h, ["day", "seq"])
    e = e.withColumn("hit", F.when(F.col("side") == "upper", F.col("below")).otherwise(F.col("above")))
    within = {f"hit_t{n}": F.when(F.col("next") < F.col("us") + n * 1_000_000, F.coalesce(F.col("hit.us") < F.col("us") + n * 1_000_000, F.lit(False))) for n in HORIZONS}
    within |= {f"hit_n{n}": F.when(F.col("next").isNotNull(), F.coalesce(F.col("hit.i") - F.col("i") < n, F.lit(False))) for n in PRINTS}
    return e.select("seq", "band", (F.col("hit.us") - F.col("us")).alias("hit_us"), (F.col("hit.i") - F.col("i")).alias("hit_prints"), *(c.alias(n) for n, c in within.items()))
