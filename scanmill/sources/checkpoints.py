"""Cutting lineage in the folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session in one process, as in tests, may name none and gets a
    scratch folder; anywhere else executors could not see each other's files, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: row order and partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table written once and read back; readers then prune columns and share the work.

    Without a path it goes to the shared folder and stays there; :class:`Scratch` removes what it wrote.
    """
    spark = df.sparkSession
    target = path or f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


class Scratch:
    """Owner of intermediate tables: they are removed when its block ends, so results must be stored inside it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self.folder}/{uuid.uuid4().hex}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
