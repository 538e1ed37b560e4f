"""What several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in all contracts here; bytes.split() uses the same set.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that are worked on at once.
SLICE = 250
#: Bytes of an Arrow batch. With Spark's 10,000 rows a batch of texts has tens of MB, of which the executor's JVM holds a
#: vector and a serialized copy outside its heap for every task, and Python the batch and the one before.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send rows to Python in small Arrow batches; a bound that was set already stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, from spark.checkpoint.dir.

    Where that is unset a local session, as in tests, gets a temporary folder; a cluster gets an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written once as Parquet in the shared folder and read back.

    checkpoint() would compute df twice, once to count and once to write. The files stay, as reliable checkpoints do,
    until discard() or until the shared folder is cleared.
    """
    folder = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    read = df.sparkSession.read.schema(df.schema).parquet(folder)
    read._cut_folder = folder
    return read


def discard(*frames: DataFrame) -> None:
    """Deletes the files behind frames that cut() returned and that nothing reads any more; other frames have none."""
    for df in frames:
        if not hasattr(df, "_cut_folder"):
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that Python holds the texts and results of few rows at once.

    At the end the pool's unused memory goes back: a worker that waits for its next task keeps the rest.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def labelled_sample(labels: DataFrame, usable: Column, bound: int, *more: Column) -> DataFrame:
    """At most ``bound`` distinct labelled documents: those with the least hash of doc_id.

    The sample is the same on every run and its size doesn't grow with the table, so it can be broadcast.
    Where a doc_id has several labels, the least row counts.
    """
    rows = labels.filter(usable & F.col("doc_id").isNotNull()).select("doc_id", *more)
    if more:
        names = [c for c in rows.columns if c != "doc_id"]
        rows = rows.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("_first")).select("doc_id", "_first.*")
    else:
        rows = rows.distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
