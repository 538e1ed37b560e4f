"""Raw files, day partitions, upserts and streams on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.sources import ticks as source
from tickloom.streaming import ticks as streams

RAW = "20240102093000000001;1;2;10.5;3\n20240102093000000002;2;0;10.25;4;1;0;extra\n\nbad;1;2;3;4\n1;2\n20240103093000000003;1;2;x;5\n20249999093000000003;1;2;1;5\n"


def test_raw_lines_are_read_or_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RAW)
    (tmp_path / "b.txt").write_text(RAW)
    good, bad = source.read_raw(spark, str(tmp_path))
    rows = sorted(good.collect(), key=lambda r: (r.ts is not None, r.ts))
    assert [(r.type, r.price, r.volume, r.depth, r.action) for r in rows] == [(2, 1.0, 5, None, None), (2, 10.5, 3, None, None), (0, 10.25, 4, 1, 0), (2, None, 5, None, None)]
    assert rows[1].ts == dt.datetime(2024, 1, 2, 9, 30, 0, 1) and rows[0].ts is None
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("1;2", "too few fields"), ("bad;1;2;3;4", "bad time")]


def test_days_are_replaced_and_pruned(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RAW)
    good = source.read_raw(spark, str(tmp_path))[0].filter("ts IS NOT NULL")
    out = f"{tmp_path}/days"
    for part in (good, good.filter("day = 2")):
        source.write_days(part, out)
    assert source.read_days(spark, out, "2024-01-01", "2024-01-31").count() == 3
    assert source.read_days(spark, out, "2024-01-03", "2024-01-03").count() == 1


def test_upsert_back_fill_and_fields(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, n int, x string"), spark.createDataFrame([(1, 1, 2.0), (2, 4, 3.0), (3, None, 4.0)], "k int, n int, y double")
    assert sorted(map(tuple, source.upsert(old, new, ["k"], "n").select("k", "n", "x", "y").collect())) == [(1, 1, None, 2.0), (2, 5, "b", None), (3, None, None, 4.0)]
    filled = source.back_fill(old, spark.createDataFrame([(1, "z", 7)], "k int, x string, w int"), ["k"])
    assert sorted(map(tuple, filled.select("k", "n", "x", "w").collect())) == [(1, 1, "z", 7), (2, 5, "b", None)]
    fields = spark.createDataFrame([('{"a": "x", "b": 2}',), ("no",), (None,)], "j string").select(source.first_numeric(F.col("j"), ["a", "b"]).alias("v"))
    assert [r.v for r in fields.collect()] == [2.0, None, None]


def _replay(spark, tmp_path):
    start = dt.datetime(2024, 1, 2)
    rows = [(start + dt.timedelta(seconds=37 * (i // 2)), i // 2, "ab"[i // 2 % 2], float(i // 2 % 7), i // 2) for i in range(200)]
    spark.createDataFrame(rows, "ts timestamp, seq int, key string, price double, volume int").repartition(4).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    return batch, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")


def test_streams_equal_batch(spark, tmp_path):
    batch, stream = _replay(spark, tmp_path)
    streams.journal(streams.first_of_key(stream, ["seq", "key"], "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.distinct().collect()))

    bars = streams.stream_bars(stream, "10 minutes", "1 hour").writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    bars.awaitTermination()
    want = streams.stream_bars(batch, "10 minutes", "1 hour")
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, want.collect()))
