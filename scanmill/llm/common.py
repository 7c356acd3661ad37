"""What the operators of this subpackage share: table access and intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

WORDS = r"[^\x20\x09-\x0D]+"
"""A word of the text operators: a run without space, tab, line feed, vertical tab, form feed or carriage return."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session may go without that setting; it gets a temporary folder. Elsewhere a missing setting is
    an error, as a machine-local folder would lose rows."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(frame: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: work before it is never repeated, and survives
    lost executors. The tables of one application lie in one folder, see `drop_written`."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables that are removed when its block ends: `keep(frame)` writes one and reads it back. Results that outlive the block
    must be written by `written` inside it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/scratch-{uuid.uuid4().hex}"

    def __call__(self, frame: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        _delete(self.spark, self.folder)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of tables that are written: it does so only when the driver has collected the plans that
    made them, which a driver with room to spare puts off for half an hour. For operators of many shuffling steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Removes all tables that `written` made in this application; results that read them must be stored before."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which need not have it installed; once for each application."""
    if spark.conf.get("spark.scanmill.shipped", None) != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/scanmill", "zip", root, "scanmill")
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("spark.scanmill.shipped", spark.sparkContext.applicationId)


BATCH_ROWS = 1000
"""Most rows with whole texts that a Python worker gets at once in the pipeline and in op5."""
READ_ROWS = 512
"""Most rows of whole texts that a Parquet reader holds at once there; its own bound is a number of rows too, however long they are."""


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of a batch that is read and of one that goes to Python: a task's texts then never lie whole in the reader's
    vectors, in Arrow buffers on both sides and in the worker's strings. A smaller bound of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def like(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that others with clashing names never meet an operator's own."""
    return frame.select(*columns)
