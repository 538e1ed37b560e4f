"""Levels are copied no more often than their blocks ask for."""

from pyspark.sql import functions as F

from tickloom.operators.book import look_up


def test_levels_are_laid_by_price_only_for_limits(spark):
    levels = spark.createDataFrame([(i, "v", "ask", 100 + i, 3) for i in range(20)], "level_id long, venue string, side string, cents long, qty long")
    blocks = spark.createDataFrame([(1, "v", "ask", 7), (2, "v", "ask", 70)], "id long, venue string, side string, q long")
    plain = look_up(levels, blocks, ["venue", "side"], {"x": F.col("q")})
    assert "_by_price, true" not in plain._jdf.queryExecution().analyzed().toString()
    assert sorted((r["id"], r["x"]["filled"], r["x"]["paid"]) for r in plain.collect()) == [(1, 7, 3 * 100 + 3 * 101 + 102), (2, 60, 3 * sum(range(100, 120)))]
    limited = look_up(levels, blocks, ["venue", "side"], {"x": F.col("q")}, {"y": F.lit(104)})
    assert "_by_price, true" in limited._jdf.queryExecution().analyzed().toString()
    assert sorted((r["id"], r["y"]) for r in limited.collect()) == [(1, 15), (2, 15)]
