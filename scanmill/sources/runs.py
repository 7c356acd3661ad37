"""Outputs of several calls under one root: every call adds a run, a record of finished sequences tells which rows count."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanmill.sources.schemas import TRACK_RECORD
from scanmill.sources.writers import LAYOUT

RECORD = "finished"
LISTING = "listing"
"""Optional column that tells listings of one sequence name apart; without it a name is one listing."""
_RECORD_SCHEMA = "split string, sequence string, listing long, output string, run string"


def one_for_all_listings(output: str) -> bool:
    """Rasters are the same for every listing of a name, so they are stored once for each split."""
    return output.startswith("images_")


def new_run() -> str:
    """A name for one call; later calls sort after earlier ones."""
    return f"r{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_run(table: DataFrame, root: str, output: str, run: str) -> str:
    """Adds the call's rows to an output, in folders per split, sensor and run. Nobody reads them before :func:`finish`.

    Track records are JSON, in folders per number of frames first; all else is Parquet. Returns the output's folder."""
    folder = f"{root}/{output}"
    marked = table.withColumn("run", F.lit(run)).write.mode("append")
    if output.startswith("gt_"):
        marked.partitionBy("horizon", *LAYOUT, "run").json(folder)
    else:
        marked.partitionBy(*LAYOUT, "run").parquet(folder)
    return folder


def finish(sequences: DataFrame, root: str, outputs: Iterable[str], run: str) -> None:
    """The commit of a call: from now on its rows are the ones of these ``sequences`` (``split, sequence``, maybe ``listing``) in
    its outputs.

    One small file, written when all outputs are; a call that fails before has changed nothing for readers."""
    names = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.lit(one_for_all_listings(o)).alias("whole")) for o in outputs]))
    listing = (F.col(LISTING) if LISTING in sequences.columns else F.lit(None)).cast("long")
    listed = sequences.select("split", "sequence", listing.alias(LISTING)).distinct().select("*", names.alias("o"))
    kept = F.when(~F.col("o.whole"), F.col(LISTING)).alias(LISTING)
    rows = listed.select("split", "sequence", kept, "o.output").distinct().withColumn("run", F.lit(run))
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{RECORD}")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """``output, sequence, listing, run``: the run that holds each finished listing of each output, the latest of its calls.

    One row per listing, output and call, however many rows those have; the listing is null where calls named none."""
    record = spark.read.schema(_RECORD_SCHEMA).parquet(f"{root.rstrip('/')}/{RECORD}")
    return record.groupBy("output", "sequence", LISTING).agg(F.max("run").alias("run"))


def read_output(spark: SparkSession, root: str, output: str, splits: Iterable[str] | None = None) -> DataFrame:
    """The rows of one output that count: of every finished listing those of its latest call, whatever its split was before, with
    the ``listing`` column if any call gave one.

    ``splits`` are folder names; only their folders are listed and read."""
    root = root.rstrip("/")
    latest = finished(spark, root).filter(F.col("output") == output)
    # Calls with and without listings may lie under one root; then every file's own columns count.
    listed = not latest.filter(F.col(LISTING).isNotNull()).isEmpty()
    if output.startswith("gt_"):
        schema = [*TRACK_RECORD.fields, *([T.StructField(LISTING, T.LongType())] if listed else [])]
        rows, key = spark.read.schema(T.StructType(schema)).json(f"{root}/{output}"), "sequence_name"
    else:
        rows, key = spark.read.option("mergeSchema", listed).parquet(f"{root}/{output}"), "sequence"
    if splits is not None:
        rows = rows.filter(F.col("split").isin(*splits))
    latest = latest.select(F.col("sequence").alias(key), F.col(LISTING).alias("_listing"), F.col("run").alias("_run"))
    same = (rows[key] == latest[key]) & (rows["run"] == latest["_run"])
    if listed:
        same = same & rows[LISTING].eqNullSafe(latest["_listing"])
    return rows.join(latest, same, "left_semi").drop("run")


def drop_superseded(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Deletes the rows of calls of which no sequence counts any more; returns these (output, run). Rows of calls that still
    hold some sequence stay until :func:`compact`. Readers that started before may miss files."""
    root = root.rstrip("/")
    record = spark.read.schema(_RECORD_SCHEMA).parquet(f"{root}/{RECORD}").select("output", "run").distinct()
    # One row per call and output.
    stale = sorted((r.output, r.run) for r in record.join(finished(spark, root), ["output", "run"], "left_anti").collect())
    for output, run in stale:
        _delete(spark, f"{root}/{output}/{'*/' * (3 if output.startswith('gt_') else 2)}run={run}")
    return stale


def compact(spark: SparkSession, root: str, outputs: Iterable[str]) -> str:
    """Writes what counts of each output as one new call and deletes the calls it replaces. Returns the new call's name."""
    root, outputs, run = root.rstrip("/"), list(outputs), new_run()
    for output in outputs:
        write_run(read_output(spark, root, output), root, output, run)
        record = spark.read.schema(_RECORD_SCHEMA).parquet(f"{root}/{RECORD}").filter(F.col("output") == output)
        now = finished(spark, root).withColumnRenamed(LISTING, "_listing")
        same = [record[c] == now[c] for c in ("output", "sequence", "run")]
        counts = record.join(now, [*same, record[LISTING].eqNullSafe(now["_listing"])], "left_semi")
        finish(counts, root, [output], run)
    drop_superseded(spark, root)
    return run


def _delete(spark: SparkSession, glob: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(path) or []:
        system.delete(status.getPath(), True)
