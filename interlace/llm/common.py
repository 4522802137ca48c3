"""What the corpus operators share: tables, the shared folder, Arrow batch limits."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; long texts are bounded by the bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows of a batch where few columns are read and more texts at once share more words; its bytes bound it too.
WIDE_ROWS = 6000

#: Name under which a Python worker keeps what later tasks of the same kind can use.
WORKER_STATE = "interlace_worker_state"
#: A key with more rows than this, and than the HOT_SHARE-th part of all rows, is split by split_join().
HOT_ROWS, HOT_SHARE = 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds of its input at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="interlace-"))
    return context.getCheckpointDir()


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does after a collection.

    Without it they stay for up to spark.cleaner.periodicGC.interval, and a job of many steps holds the disk of all of them.
    Only where the session runs in a JVM of its own; a remote (Connect) session is left to the server.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/interlace-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote, by Spark's own file system classes; a remote session keeps them."""
    spark = df.sparkSession
    jvm = getattr(spark, "_jvm", None)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if jvm is not None else ():
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(function, keep: bool = False):
    """The function for mapInArrow, and after a task's last batch the memory that Arrow and the C library hold unused goes back.

    Spark keeps Python workers between tasks and stages, and an idle one would keep the most that it ever held. What an
    encoder keeps in the worker (WORKER_STATE) goes when the worker does other work, unless keep is set.
    """

    def run(batches):
        if not keep:
            sys.modules.pop(WORKER_STATE, None)
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not the GNU C library
            pass

    return run


def split_join(rows: DataFrame, wanted: DataFrame, keys: list[str], total: int, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with wanted on keys, where wanted has each key once and its number of rows in column n (not returned).

    A key of more than a HOT_SHARE-th of the total rows is dealt to pieces by a hash of the columns `by`, and its row of
    wanted is repeated for each piece. There are HOT_SHARE such keys at most, whatever the data, so they may be broadcast.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    pieces = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(wanted.filter(F.col("n") > limit).select(*keys, pieces.alias("__pieces")))
    left = rows.join(hot, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(*by), F.coalesce("__pieces", F.lit(1))).cast("int"))
    right = wanted.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return left.drop("__pieces").join(right, [*keys, "__piece"], how).drop("__piece")


def text_of(name: str = "text") -> F.Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))
