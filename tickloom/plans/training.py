"""Registered queries that train on touches of the bands: guards of a sweep, predictions, importances, leaderboard."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import training
from tickloom.operators.paths import outlook
from tickloom.plans import views as v
from tickloom.plans.market import BANDED, entries, query
from tickloom.session import shared_folder

HORIZONS, MILESTONES = (1800, 3600, 7200), (4, 8, 16)
FEATURES = ["band", "distance", "sigma", "volume", "sin_time", "cos_time", "since_last"]
#: Cells that the leaderboard trains, out of those that pass the guards, and the one that predictions are shown for.
SWEPT, SHOWN = 4, ("upper", 3600, 8)
CELL = ["side", "horizon", "milestone"]


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def labelled(spark: SparkSession, sf_dir: str, cell: tuple | None = None) -> DataFrame:
    """A row for each touch, horizon and milestone whose horizon holds another print: features, and whether price came back that far.

    With ``cell`` only its rows are made; no cell depends on another one. Trades are written once without what no step
    reads, since the steps read them often.
    """
    prints = _written(spark, v.trades(spark, sf_dir).select("day", "us", "seq", "price", "volume"))
    horizons, milestones = (HORIZONS, MILESTONES) if cell is None else ((cell[1],), (cell[2],))
    same = Window.partitionBy("day", "band", "side").orderBy("us", "seq")
    e = entries(spark, sf_dir, prints=prints).withColumn("since_last", (F.col("us") - F.lag("us").over(same)) / 1e6)
    e = e if cell is None else e.filter(F.col("side") == cell[0])
    seen = outlook(e, prints, ["band", "side", "price", "us", "vwap", "sigma", "volume", "since_last"], [h * 1_000_000 for h in horizons]).filter("n > 1")
    back = F.when(F.col("side") == "upper", F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price"))
    angle = F.pmod(F.col("us"), F.lit(86_400_000_000)) / 86_400_000_000 * 2 * math.pi
    rows = seen.select(
        "side", (F.col("reach") / 1_000_000).cast("int").alias("horizon"), F.explode(F.array(*map(F.lit, milestones))).alias("milestone"), "us", "seq", F.col("band").cast("int").alias("band"),
        ((F.col("price") - F.col("vwap")) / F.col("sigma")).alias("distance"), "sigma", "volume", F.sin(angle).alias("sin_time"), F.cos(angle).alias("cos_time"),
        "since_last", F.round(back, 4).alias("back"),
    )
    rows = rows.withColumn("y", (F.col("back") >= F.col("milestone")).cast("int")).withColumn("id", F.col("seq") * 4 + F.col("band"))
    return training.split(rows, CELL, "us", ["seq", "band"])


_LEAST = " OR ".join(f"n_pos_{s} < {n}" for s, n in training.LEAST_POSITIVES.items())


@query(f"""
WITH {BANDED}, a AS ({" UNION ALL ".join(f'''SELECT seq, {h} AS horizon, count(*) OVER w AS n, max(price) OVER w AS high, min(price) OVER w AS low FROM trades
  WINDOW w AS (PARTITION BY day ORDER BY us RANGE BETWEEN CURRENT ROW AND {h * 1000000 - 1} FOLLOWING)''' for h in HORIZONS)}),
r AS (SELECT side, horizon, CAST(m AS INTEGER) AS milestone, round(CASE side WHEN 'upper' THEN price - low ELSE high - price END, 4) >= m AS y,
  row_number() OVER (PARTITION BY side, horizon, m ORDER BY us, seq, band) - 1 AS i, count(*) OVER (PARTITION BY side, horizon, m) AS n
  FROM entries JOIN a USING (seq), (VALUES {", ".join(f"({m})" for m in MILESTONES)}) x(m) WHERE a.n > 1),
s AS (SELECT *, CASE WHEN i < floor(n * {training.TRAIN_SHARE}) THEN 'train' WHEN i < floor(n * {training.TEST_FROM}) THEN 'val' ELSE 'test' END AS split FROM r),
g AS (SELECT side, CAST(horizon AS INTEGER) AS horizon, milestone, count(*) AS n_total, {", ".join(f"count(*) FILTER (split = '{s}') AS n_{s}, count(*) FILTER (split = '{s}' AND y) AS n_pos_{s}" for s in training.LEAST_POSITIVES)} FROM s GROUP BY ALL)
SELECT *, CASE WHEN n_total < {training.LEAST_ROWS} THEN 'skipped_too_few_rows' WHEN {_LEAST} THEN 'skipped_too_few_positives' ELSE 'ok' END AS status FROM g""")
def ml_sweep_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of side, horizon and milestone have enough rows and positives in every split, from one aggregate."""
    return training.guards(labelled(spark, sf_dir), CELL, "y")


def feature_table(spark: SparkSession, sf_dir: str, cell: tuple | None = None) -> DataFrame:
    """The labelled touches, written once and read by every model of a sweep."""
    return _written(spark, labelled(spark, sf_dir, cell))


def _trained(table: DataFrame, cell: tuple) -> tuple:
    rows, inputs = training.with_flags(table.filter((F.col("side") == cell[0]) & (F.col("horizon") == cell[1]) & (F.col("milestone") == cell[2])), FEATURES)
    return training.fit(rows, inputs, "y"), rows, inputs


@query()
def ml_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the test split of one cell."""
    model, rows, inputs = _trained(feature_table(spark, sf_dir, SHOWN), SHOWN)
    return training.predict(model, rows.filter("split = 'test'"), inputs).select("seq", "band", "us", "y", "p")


@query()
def ml_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each input gains the trees of one cell, and what the test's area under the curve loses without its order."""
    model, rows, inputs = _trained(feature_table(spark, sf_dir, SHOWN), SHOWN)
    gains = spark.createDataFrame([*zip(inputs, map(float, model.featureImportances.toArray()), strict=True)], "feature string, gain double")
    return training.permutation_importance(model, rows.filter("split = 'test'"), inputs, "y", "id").join(F.broadcast(gains), "feature")


@query()
def ml_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the cells that pass the guards, the first SWEPT of them by rows: one small model each."""
    table = feature_table(spark, sf_dir)
    facts = training.guards(table, CELL, "y").filter("status = 'ok'")
    chosen = facts.orderBy(F.desc("n_total"), *CELL).limit(SWEPT).collect()
    scored = None
    for r in chosen:
        model, rows, inputs = _trained(table, tuple(r[c] for c in CELL))
        p = training.predict(model, rows.filter("split <> 'train'"), inputs).select(*CELL, "split", "y", "p")
        scored = p if scored is None else scored.union(p)
    if scored is None:
        scored = table.limit(0).select(*CELL, "split", "y", F.lit(0.0).alias("p"))
    m = training.metrics(scored, [*CELL, "split"], "y").groupBy(*CELL)
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    m = m.agg(*(of(s, c) for s in ("val", "test") for c in ("auc", "pr", "logloss", "rate")))
    return training.leaderboard(facts.join(m, CELL), CELL)
