"""Writers: partitioned Parquet, text and JSON. A call replaces the folders it has rows for and leaves all others, so that splits
can be written one after the other; the jobs themselves write through :mod:`scanmill.sources.runs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from scanmill.functions.text import sample_stem

LAYOUT = ("split", "sensor")


def _replacing(df: DataFrame, *partition_by: str) -> DataFrameWriter:
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = LAYOUT) -> None:
    """Parquet in folders per split and sensor."""
    _replacing(df, *partition_by).parquet(path)


def write_label_lines(lines: DataFrame, path: str) -> None:
    """Label lines as Parquet per split and sensor, the stem in a column; ``read_label_lines`` reads them back."""
    write_table(lines.select(*LAYOUT, "stem", "line_no", "line"), path)


def write_label_text(lines: DataFrame, path: str) -> None:
    """Label text, one record per stem, in folders per split and sensor: ``stem``, a tab, and the lines in order.

    A frame without boxes is a stem without lines. The number of folders does not grow with the frames.
    """
    body = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line_no", "line")))), lambda r: r["line"]
    )
    files = lines.groupBy(*LAYOUT, "stem").agg(F.array_join(body, "\t").alias("_body"))
    record = files.select(*LAYOUT, F.concat_ws("\t", "stem", F.nullif("_body", F.lit(""))).alias("value"))
    _replacing(record, *LAYOUT).text(path)


def write_obb_text(samples: DataFrame, path: str) -> None:
    """Oriented-box text, one record per sample in folders per split: its number, a tab, and its lines in order."""
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"])
    files = samples.groupBy("split", "sample_index").agg(F.array_join(gathered, "\t").alias("_body"))
    record = files.select("split", F.concat_ws("\t", sample_stem(F.col("sample_index")), "_body").alias("value"))
    _replacing(record, "split").text(path)


def write_track_json(records: DataFrame, path: str) -> None:
    """Track records as JSON lines, in folders per number of frames asked for."""
    _replacing(records, "horizon", *LAYOUT).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Sorted image paths as text, one folder per split."""
    ordered = manifest.repartitionByRange("split", "path").sortWithinPartitions("split", "path")
    _replacing(ordered.select("split", F.col("path").alias("value")), "split").text(path)
