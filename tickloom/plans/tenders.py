"""Registered queries on tenders: routes through ladders, economics, policies, scoring, monitors and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import safe_div
from tickloom.operators.book import look_up
from tickloom.operators.temporal import asof
from tickloom.plans import views as v
from tickloom.plans.market import query

# Fixed values of the tender policy, in dollars: fees and reserve a share, edges, least profit, imbalance.
FEES, RESERVE, CORE_EDGE, MARGINAL_EDGE, LEAST_PROFIT, FAVOURABLE = 0.02, 0.03, 0.05, 0.04, 750, 0.05

LEVELS = """levels AS (
  SELECT *, CAST(sum(qty) OVER w - qty AS BIGINT) AS before, CAST(sum(qty * cents) OVER w - qty * cents AS BIGINT) AS amount, row_number() OVER w AS rank
  FROM (SELECT p_partkey AS level_id, p_brand AS venue, CASE WHEN p_partkey % 2 = 0 THEN 'ask' ELSE 'bid' END AS side,
      CASE WHEN p_partkey % 2 = 0 THEN c ELSE 200000 - c END AS cents, CAST(p_size AS BIGINT) AS qty
    FROM (SELECT *, CAST(round(CAST(p_retailprice AS DOUBLE) * 100) AS BIGINT) AS c FROM part))
  WINDOW w AS (PARTITION BY venue, side ORDER BY CASE side WHEN 'ask' THEN cents ELSE -cents END, level_id))"""
TENDERS = LEVELS + """, tenders AS (
  SELECT c_custkey AS tender_id, CASE WHEN c_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN c_custkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
    'Brand#' || (1 + c_custkey % 25) AS venue, 20 + c_custkey * 37 % 200 AS quantity, 90000 + c_custkey * 7919 % 20000 AS cents FROM customer)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as book levels of their brand: even keys offer, odd ones bid; whole cents."""
    c = F.round(F.col("p_retailprice").cast("double") * 100).cast("long")
    ask = F.col("p_partkey") % 2 == 0
    return v._read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("level_id"), F.col("p_brand").alias("venue"), F.when(ask, "ask").otherwise("bid").alias("side"), F.when(ask, c).otherwise(200000 - c).alias("cents"), F.col("p_size").cast("long").alias("qty")
    )


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenders: who buys a block unwinds it at the bids of its venue, who sells one at the offers."""
    key = F.col("c_custkey")
    buys = key % 2 == 0
    return v._read(spark, sf_dir, "customer").select(
        key.alias("tender_id"), F.when(buys, "BUY").otherwise("SELL").alias("action"), F.when(buys, "bid").otherwise("ask").alias("side"),
        F.concat(F.lit("Brand#"), (1 + key % 25).cast("string")).alias("venue"), (20 + key * 37 % 200).alias("quantity"), (90000 + key * 7919 % 20000).alias("cents"),
    )


def gain(price: Column) -> Column:
    """What a share earns at an average price in cents, in dollars."""
    return F.when(F.col("action") == "BUY", price - F.col("cents")).otherwise(F.col("cents") - price) / 100


ROUTED = TENDERS + """, routed AS (
  SELECT t.tender_id, t.action, t.cents, t.quantity, sum(greatest(0, least(l.qty, t.quantity - l.before)) * l.cents) AS paid, sum(l.qty) >= t.quantity AS covered
  FROM tenders t JOIN levels l ON l.venue = t.venue AND l.side = t.side GROUP BY t.tender_id, t.action, t.cents, t.quantity),
edges AS (SELECT *, CASE WHEN covered THEN paid / quantity END AS vwap FROM routed),
economics AS (SELECT *, CASE action WHEN 'BUY' THEN vwap - cents ELSE cents - vwap END / 100 AS edge FROM edges)"""


@query(f"WITH {ROUTED} SELECT tender_id, covered, round(vwap / 100, 6) AS vwap, round(edge, 6) AS edge, round(edge * quantity, 4) AS profit FROM economics")
def tender_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average unwind price, edge a share and profit of every tender whose venue has levels; null unless fully covered."""
    r = look_up(levels(spark, sf_dir), tenders(spark, sf_dir), ["venue", "side"], {"all": F.col("quantity")})
    r = r.withColumn("covered", F.col("all.covered")).withColumn("vwap", F.when(F.col("covered"), F.col("all.paid") / F.col("quantity"))).withColumn("edge", gain(F.col("vwap")))
    return r.select("tender_id", "covered", F.round(F.col("vwap") / 100, 6).alias("vwap"), F.round("edge", 6).alias("edge"), F.round(F.col("edge") * F.col("quantity"), 4).alias("profit"))


SHARES = (25, 50, 75, 100)
_PART = ", ".join(f"round(CASE WHEN depth >= q{p} THEN sum(greatest(0, least(l.qty, q{p} - l.before)) * l.cents) / q{p} / 100 END, 6) AS vwap_{p}" for p in SHARES)
_Q = ", ".join(f"CAST(ceil(quantity * {p} / 100.0) AS BIGINT) AS q{p}" for p in SHARES)
_NEED = {"breakeven": 2, "buffered": 5, "threshold": 7}
FEATURES = TENDERS + f""", depths AS (SELECT venue, {", ".join(f"CAST(sum(CASE WHEN side = '{s}' AND rank <= {n} THEN qty ELSE 0 END) AS BIGINT) AS {s}{n}" for s in ("bid", "ask") for n in (5, 10, 1000000000))},
  max(CASE WHEN side = 'bid' THEN cents END) AS top_bid, min(CASE WHEN side = 'ask' THEN cents END) AS top_ask FROM levels GROUP BY venue),
asked AS (SELECT *, {_Q} FROM tenders JOIN depths USING (venue)),
seen AS (SELECT *, CASE side WHEN 'bid' THEN bid1000000000 ELSE ask1000000000 END AS depth FROM asked),
f AS (SELECT s.tender_id, s.action, s.quantity, s.cents, s.depth, {", ".join(f"round(CASE WHEN bid{n} + ask{n} <> 0 THEN CASE action WHEN 'BUY' THEN 1 ELSE -1 END * (bid{n} - ask{n}) / (bid{n} + ask{n}) END, 6) AS favourable{i}" for i, n in enumerate((5, 10, 1000000000)))},
  top_bid / 100.0 AS top_bid, top_ask / 100.0 AS top_ask, round((top_bid + top_ask) / 200.0, 4) AS mid, round((top_ask - top_bid) / 100.0, 4) AS spread,
  {_PART}, {", ".join(f"CAST(sum(CASE WHEN CASE action WHEN 'BUY' THEN l.cents - s.cents ELSE s.cents - l.cents END >= {c} THEN l.qty ELSE 0 END) AS BIGINT) AS {n}_qty" for n, c in _NEED.items())},
  CASE WHEN depth >= q100 THEN CASE action WHEN 'BUY' THEN 1 ELSE -1 END * (sum(greatest(0, least(l.qty, q100 - l.before)) * l.cents) / q100 - s.cents) / 100 - {FEES} END AS fee_edge
  FROM seen s JOIN levels l ON l.venue = s.venue AND l.side = s.side
  GROUP BY s.tender_id, s.action, s.quantity, s.cents, s.depth, q25, q50, q75, q100, bid5, ask5, bid10, ask10, bid1000000000, ask1000000000, top_bid, top_ask)"""
_FAVOUR = ("favourable_5", "favourable_10", "favourable_full")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tender with its venue's book seen from the side on which it unwinds.

    Levels are summed up a venue once; prices of parts of the block and sizes up to a price are looked up by size and price.
    """
    book = levels(spark, sf_dir)
    order = Window.partitionBy("venue", "side").orderBy(F.when(F.col("side") == "ask", F.col("cents")).otherwise(-F.col("cents")), "level_id")
    ranked = book.withColumn("rank", F.row_number().over(order))
    part = lambda s, n: F.sum(F.when((F.col("side") == s) & (F.col("rank") <= n), F.col("qty")).otherwise(0))
    sums = [part(s, n).alias(f"{s}{i}") for s in ("bid", "ask") for i, n in enumerate((5, 10, 1_000_000_000))]
    tops = [F.max(F.when(F.col("side") == "bid", F.col("cents"))).alias("top_bid"), F.min(F.when(F.col("side") == "ask", F.col("cents"))).alias("top_ask")]
    t = tenders(spark, sf_dir).join(ranked.groupBy("venue").agg(*sums, *tops), "venue")
    sign = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    for i, name in enumerate(_FAVOUR):
        b, a = F.col(f"bid{i}"), F.col(f"ask{i}")
        t = t.withColumn(name, F.round(safe_div(sign * (b - a), b + a), 6))
    t = t.withColumn("depth", F.when(F.col("side") == "bid", F.col("bid2")).otherwise(F.col("ask2")))
    for p in SHARES:
        t = t.withColumn(f"q{p}", F.ceil(F.col("quantity") * p / 100.0).cast("long"))
    limits = {f"{name}_qty": F.col("cents") + sign * c for name, c in _NEED.items()}
    t = look_up(book, t, ["venue", "side"], {f"part_{p}": F.col(f"q{p}") for p in SHARES}, limits)
    t = t.withColumns({f"paid_{p}": F.when(F.col(f"part_{p}.covered"), F.col(f"part_{p}.paid")) for p in SHARES})
    return t.withColumn("fee_edge", gain(F.col("paid_100") / F.col("q100")) - FEES)


@query(f"""WITH {FEATURES} SELECT tender_id, top_bid, top_ask, mid, spread, {", ".join(f"vwap_{p}" for p in SHARES)}, {", ".join(f"favourable{i} AS {n}" for i, n in enumerate(_FAVOUR))},
  round(depth / quantity, 6) AS depth_ratio, {", ".join(f"{n}_qty" for n in _NEED)}, round(fee_edge, 6) AS fee_edge, round(fee_edge - {RESERVE}, 6) AS decision_edge FROM f""")
def tender_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of book, prices for parts of the block, imbalance in its favour, depth, profitable size and edges."""
    f = features(spark, sf_dir)
    return f.select(
        "tender_id", (F.col("top_bid") / 100.0).alias("top_bid"), (F.col("top_ask") / 100.0).alias("top_ask"),
        F.round((F.col("top_bid") + F.col("top_ask")) / 200.0, 4).alias("mid"), F.round((F.col("top_ask") - F.col("top_bid")) / 100.0, 4).alias("spread"),
        *(F.round(F.col(f"paid_{p}") / F.col(f"q{p}") / 100, 6).alias(f"vwap_{p}") for p in SHARES), *_FAVOUR,
        F.round(F.col("depth") / F.col("quantity"), 6).alias("depth_ratio"), *(f"{n}_qty" for n in _NEED),
        F.round("fee_edge", 6).alias("fee_edge"), F.round(F.col("fee_edge") - RESERVE, 6).alias("decision_edge"),
    )


@query(f"""WITH {FEATURES}, p AS (SELECT *, round((fee_edge - {RESERVE}) * quantity, 6) >= {LEAST_PROFIT} AS base FROM f)
SELECT tender_id, CASE WHEN base AND round(fee_edge, 6) >= {CORE_EDGE} THEN 'CORE' WHEN base AND round(fee_edge, 6) >= {MARGINAL_EDGE} AND favourable2 >= {FAVOURABLE} THEN 'MARGINAL' ELSE 'DECLINE' END AS regime FROM p""")
def tender_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether to take a tender: by its edge alone, by a smaller edge with a favourable book, or not; needs the least profit."""
    f, edge = features(spark, sf_dir), F.round("fee_edge", 6)
    base = F.round((F.col("fee_edge") - RESERVE) * F.col("quantity"), 6) >= LEAST_PROFIT
    marginal = base & (edge >= MARGINAL_EDGE) & (F.col("favourable_full") >= FAVOURABLE)
    return f.select("tender_id", F.when(base & (edge >= CORE_EDGE), "CORE").when(marginal, "MARGINAL").otherwise("DECLINE").alias("regime"))


@query(f"""WITH {TENDERS}, q AS (SELECT t.*, f.percent, greatest(1, CAST(round_even(quantity * f.percent / 100.0, 0) AS BIGINT)) AS tail FROM tenders t, (VALUES (10), (25), (40)) f(percent)),
c AS (SELECT tender_id, percent, action, q.cents, tail, sum(greatest(0, least(qty, quantity - before)) * l.cents) AS whole, sum(greatest(0, least(qty, quantity - tail - before)) * l.cents) AS core
  FROM q JOIN levels l ON l.venue = q.venue AND l.side = q.side
  GROUP BY tender_id, percent, action, q.cents, tail, quantity HAVING sum(qty) >= quantity)
SELECT tender_id, CAST(percent AS INTEGER) AS percent, tail, round((whole - core) / tail / 100, 6) AS price,
  round(CASE action WHEN 'BUY' THEN (whole - core) / tail - cents ELSE cents - (whole - core) / tail END / 100, 6) AS edge FROM c""")
def tail_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and edge of the last 10, 25 and 40% of every covered block."""
    t = tenders(spark, sf_dir).withColumn("percent", F.explode(F.array(*map(F.lit, (10, 25, 40)))))
    t = t.withColumn("tail", F.greatest(F.lit(1).cast("long"), F.rint(F.col("quantity") * F.col("percent") / 100.0).cast("long"))).withColumn("core", F.col("quantity") - F.col("tail"))
    both = look_up(levels(spark, sf_dir), t, ["venue", "side"], {"whole": F.col("quantity"), "first": F.col("core")}).filter("whole.covered")
    price = (F.col("whole.paid") - F.col("first.paid")) / F.col("tail")
    return both.select("tender_id", "percent", "tail", F.round(price / 100, 6).alias("price"), F.round(gain(price), 6).alias("edge"))


@query(f"""WITH {TENDERS}, s AS (SELECT t.*, CAST(i AS INTEGER) AS slice, 50 * i AS lo, least(quantity, 50 * (i + 1)) AS hi FROM tenders t, range(0, 5) r(i) WHERE 50 * i < quantity),
x AS (SELECT tender_id, slice, hi - lo AS asked, greatest(0, least(hi, before + qty) - greatest(lo, before)) AS take, l.cents, rank FROM s JOIN levels l ON l.venue = s.venue AND l.side = s.side)
SELECT tender_id, slice, CAST(sum(take) AS BIGINT) AS filled, round(sum(take * cents) / sum(take) / 100, 6) AS vwap, arg_max(cents, rank) / 100.0 AS worst, sum(take) = any_value(asked) AS covered
FROM x WHERE take > 0 GROUP BY tender_id, slice""")
def sliced_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut into slices of at most 50, which consume one snapshot one after the other."""
    t = tenders(spark, sf_dir).withColumn("slice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("quantity") / 50).cast("int") - 1)))
    sizes = {"lo": F.col("slice") * 50, "hi": F.least(F.col("quantity"), (F.col("slice") + 1) * 50)}
    x = look_up(levels(spark, sf_dir), t, ["venue", "side"], sizes)
    filled = F.col("hi.filled") - F.col("lo.filled")
    vwap = F.round((F.col("hi.paid") - F.col("lo.paid")) / filled / 100, 6)
    return x.filter(filled > 0).select("tender_id", "slice", filled.alias("filled"), vwap.alias("vwap"), (F.col("hi.worst") / 100.0).alias("worst"), F.col("hi.covered").alias("covered"))


_ROUTE = v.LADDER + """, plan AS (SELECT *, row_number() OVER o AS i FROM (
    SELECT *, greatest(0, least(qty, 800 - coalesce(sum(qty) OVER (ORDER BY price, venue, level_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
    FROM ladder WHERE venue IN ('Brand#11', 'Brand#12')) WHERE take > 0 WINDOW o AS (ORDER BY price, venue, level_id)),
 islands AS (SELECT *, i - row_number() OVER (PARTITION BY venue ORDER BY i) AS island FROM plan),
 spans AS (SELECT *, sum(take) OVER w - take AS a, sum(take) OVER w AS b FROM islands WINDOW w AS (PARTITION BY venue, island ORDER BY i))"""


@query(f"""WITH {_ROUTE} SELECT venue, first, CAST(c AS BIGINT) AS child, CAST(sum(least(b, 60 * (c + 1)) - greatest(a, 60 * c)) AS BIGINT) AS quantity, arg_min(price, i) AS best, arg_max(price, i) AS worst
FROM (SELECT *, min(i) OVER (PARTITION BY venue, island) AS first FROM spans), LATERAL (SELECT unnest(range(CAST(a // 60 AS BIGINT), CAST((b - 1) // 60 + 1 AS BIGINT))) AS c) GROUP BY venue, island, first, c""")
def route_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route over two venues as child orders of at most 60, merging only neighbouring steps of one venue.

    The two ladders are one book of bounded depth, ordered in one task.
    """
    two = v.ladder(spark, sf_dir).filter(F.col("venue").isin("Brand#11", "Brand#12")).withColumn("book", F.lit(1))
    order = Window.partitionBy("book").orderBy("price", "venue", "level_id")
    before = F.coalesce(F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = two.withColumn("take", F.greatest(F.lit(0), F.least(F.col("qty"), F.lit(800) - before))).filter("take > 0").withColumn("i", F.row_number().over(order).cast("long"))
    plan = plan.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("book", "venue").orderBy("i")))
    w = Window.partitionBy("venue", "island")
    upto = F.sum("take").over(w.orderBy("i"))
    spans = plan.withColumns({"b": upto, "a": upto - F.col("take"), "first": F.min("i").over(w)})
    c = spans.withColumn("child", F.explode(F.sequence(F.floor(F.col("a") / 60), F.floor((F.col("b") - 1) / 60))))
    size = F.least(F.col("b"), 60 * (F.col("child") + 1)) - F.greatest(F.col("a"), 60 * F.col("child"))
    return c.groupBy("venue", "first", "child").agg(F.sum(size).alias("quantity"), F.min_by("price", "i").alias("best"), F.max_by("price", "i").alias("worst"))


@query(f"""WITH {TENDERS}, x AS (SELECT tender_id, level_id, qty, greatest(0, least(qty, quantity - before)) AS take FROM tenders t JOIN levels l ON l.venue = t.venue AND l.side = t.side)
SELECT tender_id, round(sum(take * (qty * (level_id % 4) // 4) / qty) / sum(take), 6) AS share FROM x WHERE take > 0 GROUP BY tender_id""")
def participant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of what a block consumes that belongs to named participants: level by level in proportion."""
    named = F.floor(F.col("qty") * (F.col("level_id") % 4) / 4)
    x = look_up(levels(spark, sf_dir), tenders(spark, sf_dir), ["venue", "side"], {"all": F.col("quantity")}, parts={"named": named})
    return x.select("tender_id", F.round(F.col("all.named") / F.col("all.filled"), 6).alias("share"))


RAW = """raw AS (SELECT o_orderdate, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(l_extendedprice AS DOUBLE) AS amount, CAST(l_quantity AS BIGINT) AS qty, 5 * l_linenumber AS filled,
  CASE WHEN upper(trim(l_returnflag)) = 'N' THEN 'ANON' ELSE upper(trim(l_returnflag)) END AS trader FROM (SELECT *, NULL AS o_orderdate FROM lineitem))"""


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as resting orders: day, amount, size, what is filled, and who placed them."""
    name = F.upper(F.trim("l_returnflag"))
    return v._read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_extendedprice").cast("double").alias("amount"), F.col("l_quantity").cast("long").alias("qty"),
        (5 * F.col("l_linenumber")).cast("long").alias("filled"), F.when(name == "N", "ANON").otherwise(name).alias("trader"),
    )


@query(f"""WITH {RAW}, a AS (SELECT day, CAST(floor(amount / 1000) AS BIGINT) AS level, trader, greatest(qty - filled, 0) AS available FROM raw)
SELECT day, level, CAST(sum(available) AS BIGINT) AS available, count(*) AS orders, CAST(sum(CASE WHEN trader = 'ANON' THEN available ELSE 0 END) AS BIGINT) AS anonymous,
  CAST(sum(CASE WHEN trader <> 'ANON' THEN available ELSE 0 END) AS BIGINT) AS named, count(DISTINCT CASE WHEN trader <> 'ANON' THEN trader END) AS traders FROM a GROUP BY ALL HAVING sum(available) > 0""")
def aggregated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of resting orders a level, from anonymous and from named traders."""
    a = raw_orders(spark, sf_dir).select("day", F.floor(F.col("amount") / 1000).alias("level"), "trader", F.greatest(F.col("qty") - F.col("filled"), F.lit(0)).alias("available"))
    named = F.col("trader") != "ANON"
    return a.groupBy("day", "level").agg(
        F.sum("available").alias("available"), F.count("*").alias("orders"), F.sum(F.when(named, 0).otherwise(F.col("available"))).alias("anonymous"),
        F.sum(F.when(named, F.col("available")).otherwise(0)).alias("named"), F.count_distinct(F.when(named, F.col("trader"))).alias("traders"),
    ).filter("available > 0")


@query("""
WITH f AS (SELECT l_returnflag AS grp, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS sign, CAST(l_quantity AS BIGINT) AS qty, CAST(round(CAST(l_tax AS DOUBLE) * 100) - round(CAST(l_discount AS DOUBLE) * 100) AS BIGINT) AS moved FROM lineitem)
SELECT grp, count(*) AS fills, CAST(sum(sign * moved * qty) AS BIGINT) AS improvement, round(CAST(sum(sign * moved * qty) AS DOUBLE) / sum(qty), 6) AS per_share, CAST(sum(CASE WHEN sign * moved < 0 THEN -sign * moved * qty ELSE 0 END) AS BIGINT) AS slippage FROM f GROUP BY grp""")
def execution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed improvement of fills against their predicted price, in cents, a share, and what slipped."""
    cents = lambda c: F.round(F.col(c).cast("double") * 100)
    moved = (cents("l_tax") - cents("l_discount")).cast("long") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    f = v._read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), moved.alias("moved"), F.col("l_quantity").cast("long").alias("qty"))
    value = F.col("moved") * F.col("qty")
    return f.groupBy("grp").agg(F.count("*").alias("fills"), F.sum(value).alias("improvement"), F.round(F.sum(value) / F.sum("qty"), 6).alias("per_share"), F.sum(F.when(value < 0, -value).otherwise(0)).alias("slippage"))


@query(f"""WITH {v.LEDGER}, r AS (SELECT day, gate, CASE WHEN pnl % 97 <> 0 THEN pnl END AS pnl FROM ledger)
SELECT day, CASE WHEN count(*) = count(pnl) THEN CAST(sum(pnl) AS BIGINT) END AS verified, CAST(sum(pnl) AS BIGINT) AS known, count(*) - count(pnl) AS missing, round(avg(pnl), 4) AS mean FROM r GROUP BY day""")
def round_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each day: null where any part is unknown, over the known parts, and their mean."""
    r = v.ledger(spark, sf_dir).withColumn("pnl", F.when(F.col("pnl") % 97 != 0, F.col("pnl")))
    missing = F.count("*") - F.count("pnl")
    return r.groupBy("day").agg(F.when(missing == 0, F.sum("pnl")).alias("verified"), F.sum("pnl").alias("known"), missing.alias("missing"), F.round(F.avg("pnl"), 4).alias("mean"))


MEANS, SCALES, WEIGHTS, START = (0.05, 0.04, 25.0), (0.03, 0.0, 14.0), (0.8, 1.1, -0.6), -0.2
_Z = " + ".join(f"{w} * {'0' if s == 0 else f'(f{i} - {m}) / {s}'}" for i, (m, s, w) in enumerate(zip(MEANS, SCALES, WEIGHTS, strict=True), 1))


@query(f"""WITH {v.FEAT}, s AS (SELECT id, grp, {START} + {_Z} AS z, CASE WHEN f1 > 0.09 OR f3 > 49 THEN true ELSE false END AS outside FROM feat), p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM s)
SELECT id, round(p, 6) AS p, outside, CASE WHEN outside THEN 'REVIEW' WHEN round(p, 6) >= 0.6 THEN 'BOOK' WHEN round(p, 6) >= 0.4 THEN 'BAND' ELSE 'SKIP' END AS decision, round(power(p - CASE WHEN grp = 'R' THEN 1 ELSE 0 END, 2), 6) AS brier FROM p""")
def booking_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen standardised linear score through a sigmoid, a gate on its inputs, a decision and the squared error.

    A feature whose scale is 0 adds nothing.
    """
    parts = [F.lit(0.0) if s == 0 else w * (F.col(f"f{i}") - m) / s for i, (m, s, w) in enumerate(zip(MEANS, SCALES, WEIGHTS, strict=True), 1)]
    f = v.feat(spark, sf_dir).withColumn("z", sum(parts, F.lit(START))).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    p, outside = F.round("p", 6), F.coalesce((F.col("f1") > 0.09) | (F.col("f3") > 49), F.lit(False))
    decision = F.when(outside, "REVIEW").when(p >= 0.6, "BOOK").when(p >= 0.4, "BAND").otherwise("SKIP")
    return f.select("id", p.alias("p"), outside.alias("outside"), decision.alias("decision"), F.round(F.pow(F.col("p") - (F.col("grp") == "R").cast("int"), 2), 6).alias("brier"))


@query(f"""WITH {v.TICKS}, s AS (SELECT *, k % 3 AS state, lag(k % 3) OVER (PARTITION BY day, key ORDER BY us, seq) AS was FROM ticks)
SELECT day, key, arg_min(seq, (us, seq)) AS seq, CAST(arg_min(state, (us, seq)) AS BIGINT) AS state FROM s WHERE state = was GROUP BY day, key""")
def stability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tick of each day and key whose state is that of the one before."""
    at = F.struct("us", "seq")
    s = v.ticks(spark, sf_dir).withColumn("state", F.col("k") % 3).withColumn("was", F.lag("state").over(Window.partitionBy("day", "key").orderBy("us", "seq")))
    return s.filter(F.col("state") == F.col("was")).groupBy("day", "key").agg(F.min_by("seq", at).alias("seq"), F.min_by("state", at).alias("state"))


@query(f"""WITH {v.TICKS}, b AS (SELECT *, first_value(price) OVER w AS px, first_value(us) OVER w AS began FROM ticks WINDOW w AS (PARTITION BY day, key ORDER BY us, seq)),
m AS (SELECT *, CASE WHEN k >= 98 THEN 'risk' WHEN price - px <= -15 THEN 'stop' WHEN price - px >= 25 THEN 'target' WHEN us - began >= 21600000000 THEN 'time' END AS reason FROM b)
SELECT day, key, arg_min(reason, (us, seq)) AS reason, min(us) AS exit_us, round(arg_min(price - px, (us, seq)), 6) AS pnl FROM m WHERE reason IS NOT NULL GROUP BY day, key""")
def hold_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each day and key, held from the first price until risk, stop, target or time ends them, in that order."""
    w, at = Window.partitionBy("day", "key").orderBy("us", "seq"), F.struct("us", "seq")
    m = v.ticks(spark, sf_dir).withColumns({"gain": F.col("price") - F.first("price").over(w), "held": F.col("us") - F.first("us").over(w)})
    reason = F.when(F.col("k") >= 98, "risk").when(F.col("gain") <= -15, "stop").when(F.col("gain") >= 25, "target").when(F.col("held") >= 21_600_000_000, "time")
    m = m.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return m.groupBy("day", "key").agg(F.min_by("reason", at).alias("reason"), F.min("us").alias("exit_us"), F.round(F.min_by("gain", at), 6).alias("pnl"))


@query(f"""WITH {v.TICKS} SELECT day, key, arg_min(price, (us, seq)) AS arrival, max(price) AS most, min(price) AS least, arg_max(seq, (price, -us, -seq)) AS most_seq,
  min(CASE WHEN price >= 30 AND k % 2 = 0 THEN us END) AS hit_us, arg_min(price, (us, seq)) FILTER (price >= 30 AND k % 2 = 0) AS hit FROM ticks GROUP BY day, key""")
def tender_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival, highest and lowest value of each day and key, where the highest was first, and the first that is high enough and covered."""
    at, ok = F.struct("us", "seq"), (F.col("price") >= 30) & (F.col("k") % 2 == 0)
    return v.ticks(spark, sf_dir).groupBy("day", "key").agg(
        F.min_by("price", at).alias("arrival"), F.max("price").alias("most"), F.min("price").alias("least"), F.max_by("seq", F.struct("price", -F.col("us"), -F.col("seq"))).alias("most_seq"),
        F.min(F.when(ok, F.col("us"))).alias("hit_us"), F.min_by("price", F.when(ok, at)).alias("hit"),
    )


HORIZONS = (600, 3600, 14400)


@query(f"""WITH {v.QUOTES}, h AS (SELECT t.seq, CAST(s AS INTEGER) AS horizon, t.day, t.price, t.volume, t.us + CAST(s AS BIGINT) * 1000000 AS due FROM trades t, (VALUES {", ".join(f"({s})" for s in HORIZONS)}) x(s)),
r AS (SELECT h.seq, horizon, q.seq AS quote_seq, q.price - h.price AS delta, h.volume, row_number() OVER (PARTITION BY h.seq, horizon ORDER BY q.us, q.seq) AS r FROM h LEFT JOIN quotes q ON q.day = h.day AND q.us >= due)
SELECT seq, horizon, quote_seq, round(delta, 6) AS delta, round(delta * volume, 6) AS value FROM r WHERE r = 1""")
def followup_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote at or after each due time of every trade, what it differs by, and that times the volume."""
    t = v.trades(spark, sf_dir).withColumnRenamed("us", "since").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    t = t.withColumn("us", F.col("since") + F.col("horizon") * F.lit(1_000_000).cast("long"))
    q = v.quotes(spark, sf_dir).select("day", "us", "seq", F.col("seq").alias("quote_seq"), F.col("price").alias("px"))
    f = asof(t, q, ["day"], ["quote_seq", "px"], "q", forward=True).withColumn("delta", F.col("q.px") - F.col("price"))
    return f.select("seq", "horizon", "q.quote_seq", F.round("delta", 6).alias("delta"), F.round(F.col("delta") * F.col("volume"), 6).alias("value"))


@query(f"""WITH {v.TICKS}, p AS (SELECT a.seq, a.price, b.seq AS other, b.price AS px, a.us - b.us AS gap, row_number() OVER (PARTITION BY a.seq ORDER BY b.us DESC, b.seq DESC) AS r
  FROM ticks a JOIN ticks b ON a.day = b.day AND b.key = 'error' AND b.us <= a.us WHERE a.key = 'signup')
SELECT seq, other, gap, price > px AS crossed FROM p WHERE r = 1 AND gap <= 1800000000""")
def venue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of one venue with the last of the other at most half an hour before, and whether the two are crossed."""
    t = v.ticks(spark, sf_dir)
    other = t.filter("key = 'error'").select("day", "us", "seq", F.col("seq").alias("other"), F.col("price").alias("px"), F.col("us").alias("at"))
    p = asof(t.filter("key = 'signup'"), other, ["day"], ["other", "px", "at"], "b").withColumn("gap", F.col("us") - F.col("b.at"))
    return p.filter("gap <= 1800000000").select("seq", "b.other", "gap", (F.col("price") > F.col("b.px")).alias("crossed"))


@query("""
WITH s AS (SELECT s_nationkey AS account, s_suppkey AS id, CAST(round(CAST(s_acctbal AS DOUBLE) * 100) AS BIGINT) AS position FROM supplier),
p AS (SELECT account, count(*) AS held, CAST(sum(position) AS BIGINT) AS net, CAST(sum(abs(position)) AS BIGINT) AS gross, CASE WHEN count(CASE WHEN position > 0 THEN 1 END) > 0 THEN CAST(sum(CASE WHEN position > 0 THEN position END) AS BIGINT) END AS long_only FROM s GROUP BY account)
SELECT *, coalesce(long_only, net) AS best_known, abs(net + 500000) <= 3000000 AND gross + 500000 <= 9000000 AS admissible FROM p""")
def portfolio_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net and gross position of every account, the best known value, and whether another block stays within both limits."""
    pos = F.col("position")
    s = v._read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("account"), F.round(F.col("s_acctbal").cast("double") * 100).cast("long").alias("position"))
    p = s.groupBy("account").agg(F.count("*").alias("held"), F.sum(pos).alias("net"), F.sum(F.abs(pos)).alias("gross"), F.sum(F.when(pos > 0, pos)).alias("long_only"))
    ok = (F.abs(F.col("net") + 500000) <= 3_000_000) & (F.col("gross") + 500000 <= 9_000_000)
    return p.select("*", F.coalesce("long_only", "net").alias("best_known"), ok.alias("admissible"))
