"""Splits, guards, metrics, permutation importance and leaderboard against plain loops and a planted feature."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import training
from tickloom.plans import training as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = []
    for i in range(900):
        good, noise = rng.random(), rng.random()
        y = int(good + 0.15 * rng.gauss(0, 1) > 0.6)
        made.append(("a" if i % 3 else "b", i, None if i % 11 == 0 else good, noise, y))
    return made, spark.createDataFrame(made, "cell string, t long, good double, noise double, y int")


def test_splits_and_guards(rows):
    made, df = rows
    s = training.split(df, ["cell"], "t", [])
    got = {r.t: r.split for r in s.collect()}
    for cell in "ab":
        mine = sorted(r[1] for r in made if r[0] == cell)
        n = len(mine)
        assert [got[t] for t in mine] == ["train"] * int(n * 0.6) + ["val"] * (int(n * 0.8) - int(n * 0.6)) + ["test"] * (n - int(n * 0.8))
    g = {r.cell: r for r in training.guards(s, ["cell"], "y").collect()}
    assert (g["a"].status, g["a"].n_total, g["b"].status) == ("ok", 600, "skipped_too_few_rows")
    assert g["a"].n_pos_test == sum(r[4] for r in made if r[0] == "a" and got[r[1]] == "test")
    none = training.guards(s.withColumn("y", F.lit(0)), ["cell"], "y").filter("cell = 'a'").first()
    assert none.status == "skipped_too_few_positives"


def test_metrics_equal_loops(spark):
    rng = random.Random(8)
    scored = [(c, round(rng.random(), 1), rng.randrange(2)) for c in "xy" for _ in range(60)] + [("z", 0.5, 0)]
    got = {r.cell: r for r in training.metrics(spark.createDataFrame(scored, "cell string, p double, y int"), ["cell"], "y").collect()}
    for cell in "xy":
        mine = [(p, y) for c, p, y in scored if c == cell]
        pos, neg = [p for p, y in mine if y], [p for p, y in mine if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        pr = sum(sum(y for q, y in mine if q >= p) / sum(q >= p for q, _ in mine) for p in pos) / len(pos)
        brier = sum((y - p) ** 2 for p, y in mine) / len(mine)
        clip = lambda p: min(max(p, 1e-15), 1 - 1e-15)
        loss = -sum(math.log(clip(p) if y else 1 - clip(p)) for p, y in mine) / len(mine)
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in ((got[cell].auc, auc), (got[cell].pr, pr), (got[cell].brier, brier), (got[cell].logloss, loss)))
    assert got["z"].auc is None and got["z"].pr is None


def test_planted_feature_is_first_and_reruns_agree(rows):
    _, df = rows
    s, inputs = training.with_flags(training.split(df, [], "t", []), ["good", "noise"])
    assert inputs == ["good", "noise", "good_missing", "noise_missing"] and s.filter("good IS NULL").count() == 0
    runs = []
    for _ in range(2):
        model = training.fit(s, inputs, "y", trees=8, depth=3)
        found = training.permutation_importance(model, s.filter("split = 'test'"), inputs, "y", "t").collect()
        runs.append(sorted(map(tuple, found)))
        best = max(found, key=lambda r: r.importance)
        assert best.feature == "good" and best.importance > 0.2
        assert training.metrics(training.predict(model, s.filter("split = 'test'"), inputs), [], "y").first().auc > 0.85
    assert runs[0] == runs[1]


def test_leaderboard_scores(spark):
    made = [("a", 800, 100, 50, 40, 0.7, 0.4, 0.65, 0.35, 0.2), ("b", 500, 60, 30, 25, 0.6, 0.5, 0.75, None, 0.1)]
    df = spark.createDataFrame(made, "cell string, n_total long, n_pos_train long, n_pos_val long, n_pos_test long, val_auc double, val_pr double, test_auc double, test_pr double, test_rate double")
    got = {r.cell: r for r in training.leaderboard(df, ["cell"]).collect()}
    stable = {"a": 1 - 0.5 * 0.05 - 0.5 * 0.05, "b": 1 - 0.5 * 0.15 - 0.5}
    for cell, n, *pos, _, _, auc, pr, rate in made:
        size, support = math.log1p(n) / math.log1p(800), math.log1p(min(pos)) / math.log1p(40)
        pr = pr or 0.0
        assert math.isclose(got[cell].score_balanced, 0.4 * auc + 0.4 * pr + 0.1 * stable[cell] + 0.1 * size)
        assert math.isclose(got[cell].score_conservative, 0.35 * auc + 0.3 * pr + 0.2 * stable[cell] + 0.15 * support)
        assert math.isclose(got[cell].score_trade_focus, 0.3 * auc + 0.35 * pr + 0.15 * rate + 0.1 * stable[cell] + 0.1 * size)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rows_of_one_cell_equal_those_of_all(spark):
    """The shown cell's rows are made alone, from trades that are written once, and are the same as among all cells."""
    one = plans.labelled(spark, SF, plans.SHOWN)
    assert not [f for f in one.inputFiles() if "events" in f]
    mine = [F.col(c) == x for c, x in zip(plans.CELL, plans.SHOWN, strict=True)]
    every = plans.labelled(spark, SF).filter(mine[0] & mine[1] & mine[2])
    found = sorted(map(str, one.select(*every.columns).collect()))
    assert found and found == sorted(map(str, every.collect()))
