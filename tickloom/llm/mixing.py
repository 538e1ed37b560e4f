"""Mixing sources to target weights with DataFrame operations only.

Documents get hash-random keys. The keys' leading digits cut each source into 65,536 ranges; prefix sums of sizes run
across ranges on one row per range, and by key within the one range that a source's budget cuts. What a document gives
then follows from its source's budget and its own key: all copies below the cut, some words at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes, and the most of a source that its target may be.
TOTAL, EPOCHS = 1.5, 2
#: Sources up to this number are broadcast, a row of a few numbers each; beyond it documents are joined by a shuffle.
SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """Hexadecimal digits that depend on doc_id alone and that DuckDB computes alike."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from one row per source; the windows run over the sources, not the documents.

    A target is the least of EPOCHS times the source and its weight's share of a common level; the level is such that
    all targets add up to the total. It is what resharing the excess by weight until none is above comes to.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double"))
    capped = weighed.withColumn("cap", EPOCHS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    left = TOTAL * F.sum("source_size").over(everything) - before("cap")
    levels = capped.withColumn("level", left / (F.sum("weight").over(everything) - before("weight")))
    # Levels rise while sources are full and fall from the first that isn't: the largest is the common one.
    common = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least("cap", common * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key and range of every document; texts are read once and go no further."""
    key = random_key(F.col("doc_id"))
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), key.alias("key"))
    return slim.withColumn("range", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))


def budgets(slim: DataFrame) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, rest, cut_key and before.

    A source gives ``epochs`` whole copies of its documents, one more of those whose key is below cut_key, and of those
    with cut_key, before which there are ``before`` words, what is left of the ``rest`` words. Only the range that
    holds the cut is sorted by document. cut_key is null where the source has no words.
    """
    ranges = slim.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).alias("r")
    starts = starts.join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).filter("start <= rest AND rest < start + range_size")
    starts = starts.select("r.source", "range", "start", "rest").alias("s")
    inside = slim.alias("d").join(starts, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    of_key = inside.groupBy("d.source", "start", "rest", "key").agg(F.sum("size").alias("key_size"))
    lower = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    of_key = of_key.withColumn("before", F.col("start") + F.coalesce(F.sum("key_size").over(lower), F.lit(0)))
    cuts = of_key.filter("before <= rest AND rest < before + key_size").select("source", F.col("key").alias("cut_key"), "before").alias("c")
    joined = targets.alias("t").join(cuts, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return cut(joined.select("t.*", "cut_key", "before"))


def _with_budget(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's budget; rows move only if there are more than SOURCES sources."""
    sources = sources.withColumnRenamed("source", "_source")
    joined = F.broadcast(sources) if sources.count() <= SOURCES else sources
    return rows.join(joined, F.col("source").cast("string").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs(doc_id, source, text).

    Of a source's words its target, rounded down, is taken: as many whole epochs as fit, then its documents in the
    order of their keys, the last one in part. Null and empty texts have size 0 and nothing is taken from them. A null
    source is a source of its own, the last one. Rows with one doc_id share a key; equal ones are told apart by size
    only, which changes no result. Empty tables give empty results; other columns are not read.
    """
    slim = cut(sized(docs))
    rows = _with_budget(slim, budgets(slim))
    others = rows.filter("NOT key <=> cut_key").withColumn("more", F.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(0))
    tied = Window.partitionBy("source").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(tied) - F.col("size"))
    at_cut = rows.filter("key = cut_key").withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    columns = ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken")]
    return others.select(*columns).union(at_cut.select(*columns))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; a copy in part holds its first words.

    What a row gives follows from its source's budget and its key alone, so texts are not shuffled; only the rows of
    the key at which a source is cut are ordered, equal ones by their text. Rows without words give none; every row
    counts on its own, also where doc_ids repeat. Empty tables give empty results; columns keep their names and order.
    """
    slim = cut(sized(docs))
    sources = budgets(slim)
    kept = [F.col(c) for c in docs.columns]
    worded = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = worded.select(F.struct(*kept).alias("row"), "source", random_key(F.col("doc_id")).alias("key"))
    rows = _with_budget(rows, sources)
    copies = F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)
    whole = rows.filter("NOT key <=> cut_key").select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("whole"))
    at_cut = rows.filter("key = cut_key").withColumn("size", size_of(F.col("row.text")))
    tied = Window.partitionBy("source").orderBy("row.doc_id", "size", F.xxhash64("row.text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(tied) - F.col("size"))
    at_cut = at_cut.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    more = F.when(F.col("more") > 0, F.array("more")).otherwise(F.array().cast("array<bigint>"))
    counts = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), more)
    part = at_cut.select("row", "size", F.explode(counts).alias("words"))
    # Words with the white space before each: no pattern recurses, however long the text is.
    pieces = F.regexp_extract_all(F.rtrim("row.text", F.lit(" \t\n\x0b\x0c\r")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    part = part.withColumn("text", F.when(F.col("words") >= F.col("size"), F.col("row.text")).otherwise(first))
    part = part.select("row.*", F.col("text").alias("_text")).withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select("row.*").union(part.select(*docs.columns))


#: The same in DuckDB. Ties within a source are broken alike; equal rows are interchangeable.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, {EPOCHS}.0::DOUBLE * source_size AS cap,
    ({TOTAL}::DOUBLE * sum(source_size) OVER () - coalesce(sum({EPOCHS}.0::DOUBLE * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY {EPOCHS}.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""
