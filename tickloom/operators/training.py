"""One training job with parameters: chronological splits, guards, boosted trees with early stop, importances, leaderboard."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.paths import draw
from tickloom.operators.ranks import cumulative, ranked

# Least rows of a cell, least positives of its splits, and shares of rows in training and before the test.
LEAST_ROWS, LEAST_POSITIVES = 400, {"train": 40, "val": 20, "test": 20}
TRAIN_SHARE, TEST_FROM = 0.6, 0.8
# Weights of the leaderboard's scores.
SCORES = {
    "score_balanced": {"test_auc": 0.40, "test_pr": 0.40, "stability": 0.10, "size": 0.10},
    "score_conservative": {"test_auc": 0.35, "test_pr": 0.30, "stability": 0.20, "support": 0.15},
    "score_trade_focus": {"test_auc": 0.30, "test_pr": 0.35, "test_rate": 0.15, "stability": 0.10, "size": 0.10},
}


def split(rows: DataFrame, cell: list[str], order: str, ties: list[str]) -> DataFrame:
    """rows with their split of each cell by time: the first 60% train, the next 20% val, the rest test."""
    placed = ranked(rows, cell, order, ties).withColumn("_i", F.col("rank") - 1)
    of = F.when(F.col("_i") < F.floor(F.col("n") * TRAIN_SHARE), "train").when(F.col("_i") < F.floor(F.col("n") * TEST_FROM), "val").otherwise("test")
    return placed.withColumn("split", of).drop("_i", "rank", "n")


def guards(rows: DataFrame, cell: list[str], label: str) -> DataFrame:
    """One row for each cell with its rows, rows and positives of each split, and whether it can be trained on."""
    of = lambda name: F.col("split") == name
    sums = [F.count("*").alias("n_total")]
    sums += [F.count_if(of(s)).alias(f"n_{s}") for s in LEAST_POSITIVES] + [F.count_if(of(s) & (F.col(label) == 1)).alias(f"n_pos_{s}") for s in LEAST_POSITIVES]
    g = rows.groupBy(*cell).agg(*sums)
    few = F.lit(False)
    for s, least in LEAST_POSITIVES.items():
        few = few | (F.col(f"n_pos_{s}") < least)
    return g.withColumn("status", F.when(F.col("n_total") < LEAST_ROWS, "skipped_too_few_rows").when(few, "skipped_too_few_positives").otherwise("ok"))


def with_flags(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with nulls as 0 and a flag for each feature that says so, and the names of both."""
    flags = {f"{f}_missing": F.col(f).isNull().cast("double") for f in features}
    filled = rows.withColumns(flags).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return filled, [*features, *flags]


def fit(rows: DataFrame, inputs: list[str], label: str, trees: int = 30, depth: int = 4, step: float = 0.1, seed: int = 7) -> GBTClassificationModel:
    """Boosted trees on the rows of split train; trees that don't better split val are not kept."""
    used = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.filter("split <> 'test'"))
    used = used.select("features", F.col(label).cast("double").alias("label"), (F.col("split") == "val").alias("held"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="held", validationTol=0.0).fit(used)


def predict(model: GBTClassificationModel, rows: DataFrame, inputs: list[str]) -> DataFrame:
    """rows with p, the probability of label 1."""
    scored = model.transform(VectorAssembler(inputCols=inputs, outputCol="features").transform(rows))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def metrics(scored: DataFrame, cell: list[str], label: str) -> DataFrame:
    """auc, pr (average precision), logloss, brier and rate of each cell, from counts of distinct scores."""
    y = F.col(label).cast("long")
    c = scored.groupBy(*cell, "p").agg(F.sum(y).alias("pos"), (F.count("*") - F.sum(y)).alias("neg"))
    up = cumulative(c, cell, "p", ["pos", "neg"], descending=True)
    positives, negatives = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("upto_pos") - F.col("pos") / 2))
    gained = F.sum(F.col("pos") * F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg")))
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    n = positives + negatives
    some = (positives > 0) & (negatives > 0)
    return up.groupBy(*cell).agg(
        F.when(some, area / (positives * negatives)).alias("auc"), F.when(positives > 0, gained / positives).alias("pr"),
        (-F.sum(F.col("pos") * F.ln(q) + F.col("neg") * F.ln(1 - q)) / n).alias("logloss"),
        (F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")) / n).alias("brier"), (positives / n).alias("rate"),
    )


def permutation_importance(model: GBTClassificationModel, rows: DataFrame, inputs: list[str], label: str, key: str, seed: int = 1) -> DataFrame:
    """feature, auc without its order, and importance: how much less that is than the model's own auc.

    Each feature gets a copy of the rows in which its values are dealt anew in the order of draws from ``key``, a whole
    number that no two rows share; the copies are scored together.
    """
    names = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(n).alias("feature")) for i, n in enumerate(["", *inputs])))
    number = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    copies = rows.select(key, label, *inputs, F.explode(names).alias("_f")).select("*", "_f.*").drop("_f")
    copies = copies.withColumn("_draw", draw(F.lit(seed), F.col("k"), number))
    to, own = ranked(copies, ["k"], "_draw", [key]), ranked(copies, ["k"], key, [])
    value = F.coalesce(*(F.when(F.col("feature") == n, F.col(n)) for n in inputs), F.lit(0.0))
    given = own.select("k", "rank", value.alias("_value"))
    dealt = to.join(given, ["k", "rank"]).withColumns({n: F.when(F.col("feature") == n, F.col("_value")).otherwise(F.col(n)) for n in inputs})
    found = metrics(predict(model, dealt.select("feature", label, *inputs), inputs), ["feature"], label)
    few = Window.partitionBy(F.lit(0))  # a row for each feature
    found = found.withColumn("base", F.max(F.when(F.col("feature") == "", F.col("auc"))).over(few))
    return found.filter("feature <> ''").select("feature", "auc", (F.col("base") - F.col("auc")).alias("importance"))


def leaderboard(results: DataFrame, cell: list[str]) -> DataFrame:
    """Cells by score_balanced, with the other scores: results(cell, n_total, n_pos_*, val_auc, val_pr, test_auc, test_pr, test_rate)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    few = Window.partitionBy(F.lit(0))  # a row for each cell
    support = F.log1p(F.least(*(f"n_pos_{s}" for s in LEAST_POSITIVES)))
    r = results.withColumns({"_size": F.max(F.log1p("n_total")).over(few), "_support": F.max(support).over(few)})
    gap = lambda m: F.coalesce(F.abs(F.col(f"val_{m}") - F.col(f"test_{m}")), F.lit(1.0))
    parts: dict[str, Column] = {
        "test_auc": zero(F.col("test_auc")), "test_pr": zero(F.col("test_pr")), "test_rate": zero(F.col("test_rate")), "stability": 1 - 0.5 * gap("auc") - 0.5 * gap("pr"),
        "size": zero(F.log1p("n_total") / F.nullif(F.col("_size"), F.lit(0.0))),
        "support": zero(support / F.nullif(F.col("_support"), F.lit(0.0))),
    }
    scores = {name: sum((w * parts[p] for p, w in weights.items()), F.lit(0.0)) for name, weights in SCORES.items()}
    return r.withColumns(scores).drop("_size", "_support").orderBy(F.desc("score_balanced"), *cell)
