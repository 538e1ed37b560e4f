"""Rows of a mechanism are not gathered by it."""

from tickloom.plans.research import index_edge_bins


def test_rows_are_not_shuffled_by_mechanism_to_meet_its_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes are not known in advance on large tables
    try:
        plan = index_edge_bins(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line and "e#" not in line.split("Join")[0]]
    assert sum("BroadcastHashJoin [mechanism" in line for line in joins) >= 2
