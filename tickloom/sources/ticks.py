"""Delimited tick files in, day-partitioned Parquet out, and keyed table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The fields of a raw line; level-1 files have the first five only.
FIELDS = {"ts_raw": "string", "level": "tinyint", "type": "tinyint", "price": "double", "volume": "bigint", "depth": "tinyint", "action": "tinyint"}
SHORT = 5


def read_raw(spark: SparkSession, path: str, separator: str = ";", glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Ticks and rejected lines of headerless files with 5 or 7 fields.

    Level-1 lines get null depth and action; fields beyond the seventh are dropped; values that don't parse are null.
    Lines with fewer than five fields, or without a time of 20 digits, are rejected with their file and a reason.
    Empty lines are neither.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter(F.trim("line") != "")
    parts = F.split("line", f"\\Q{separator}\\E")
    known = lines.withColumn("parts", parts).withColumn(
        "reason", F.when(F.size("parts") < SHORT, "too few fields").when(~F.col("parts")[0].rlike("^[0-9]{20}$"), "bad time")
    )
    columns = [F.get("parts", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(FIELDS.items())]
    good = known.filter("reason IS NULL").select(*columns).withColumn("ts", parse_time(F.col("ts_raw")))
    good = good.withColumns({"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts")}).drop("ts_raw")
    return good, known.filter("reason IS NOT NULL").select("file", "line", "reason")


def parse_time(raw: Column) -> Column:
    """yyyyMMddHHmmss and six digits of microseconds; null where that is no time."""
    iso = F.regexp_replace(raw, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{6})$", "$1-$2-$3 $4:$5:$6.$7")
    return iso.try_cast("timestamp_ntz")


def write_days(ticks: DataFrame, path: str) -> None:
    """Parquet by year, month and day; days that ticks holds are replaced, others stay, so that reruns do no harm.

    Rows are dealt by day and a hash of the time, so that one busy day is written by several tasks.
    """
    dealt = ticks.repartition("year", "month", "day", F.pmod(F.xxhash64("ts"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Ticks of the days from first to last (yyyy-mm-dd, both included); other partitions are not listed as input."""
    day = F.make_date("year", "month", "day")
    return spark.read.parquet(path).filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key of both; rows of new win ties. Missing columns become null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new")


def back_fill(table: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """table with the columns of outcomes (one row per key) where these are not null."""
    columns = [c for c in outcomes.columns if c not in key]
    joined = table.join(outcomes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns)), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in table.columns else F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def first_numeric(json: Column, names: list[str]) -> Column:
    """The first of the named top-level fields that holds a number."""
    return F.coalesce(*(F.get_json_object(json, f"$.{n}").try_cast("double") for n in names))
