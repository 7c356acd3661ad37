"""Readers: Parquet tables by fixed schema, split lists, label text, raster listings."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.config import SPLIT_FOLDERS
from scanmill.functions.text import frame_stem
from scanmill.operators.splits import check_split, trimmed
from scanmill.sources.schemas import TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table by its schema; nothing is inferred and missing optional columns read as null."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known tables: {sorted(TABLES)}")
    return spark.read.schema(TABLES[name]).parquet(path)


def read_split_list(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """``split, sequence`` from one text file of names per split; a missing file is an error."""
    paths = [f"{folder.rstrip('/')}/{check_split(s)}.txt" for s in splits]
    names = spark.read.text(paths)
    split = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return names.select(split.alias("split"), trimmed(F.col("value")).alias("sequence"))


def _stem(column: str, extension: str):
    return F.regexp_extract(F.col(column), rf"([^/]+)\.{extension}$", 1)


def _layout(df: DataFrame, path_column: str) -> DataFrame:
    """Split and sensor from ``<split>/<sensor>/<folder>/<file>``."""
    parts = F.split(F.col(path_column), "/")
    return df.select(
        F.element_at(parts, -4).alias("split"), F.element_at(parts, -3).alias("sensor"), *df.columns
    )


def _present(spark: SparkSession, root: str, splits: list[str], rest: str) -> list[str]:
    """Globs of the splits that have such files; the others are named in a warning."""
    found = []
    for split in splits:
        glob = f"{root.rstrip('/')}/{split}/{rest}"
        path = spark._jvm.org.apache.hadoop.fs.Path(glob)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            found.append(glob)
        else:
            warnings.warn(f"split {split!r} has no files {rest}", stacklevel=3)
    return found


def read_label_text(spark: SparkSession, root: str, splits: list[str], folder: str = "labels") -> DataFrame:
    """Label lines ``split, sensor, stem, line_no, line`` of ``<root>/<split>/<sensor>/<folder>/*.txt``.

    Files are read whole, so that lines keep their place in the file. Splits without files are passed over.
    """
    globs = _present(spark, root, splits, f"*/{folder}/*.txt")
    if not globs:
        return spark.createDataFrame([], "split string, sensor string, stem string, line_no int, line string")
    files = spark.read.text(globs, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    placed = _layout(files, "_path")
    lines = F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)).alias("line_no", "line")
    return placed.filter(F.length("value") > 0).select("split", "sensor", _stem("_path", "txt").alias("stem"), lines)


def read_label_lines(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Label lines ``split, sensor, stem, line_no, line`` as ``write_label_lines`` stored them."""
    lines = spark.read.parquet(path).filter(F.col("line").isNotNull())
    if splits is not None:
        lines = lines.filter(F.col("split").isin(*splits))
    return lines.select("split", "sensor", "stem", "line_no", "line")


def raster_stems(pixels: DataFrame) -> DataFrame:
    """``split, sensor, stem`` of the scans that have a pixel."""
    keys = pixels.select("split", "sensor", "sequence", "frame_index").distinct()
    return keys.select("split", "sensor", frame_stem(F.col("sequence"), F.col("sensor"), F.col("frame_index")).alias("stem"))


def read_raster_stems(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """``split, sensor, stem`` of the scans that have a pixel in a raster table in folders per split and sensor."""
    pixels = spark.read.parquet(path)
    return raster_stems(pixels if splits is None else pixels.filter(F.col("split").isin(*splits)))


def list_rasters(spark: SparkSession, root: str, splits: list[str], method: str) -> DataFrame:
    """``split, sensor, stem`` of the images of one raster kind. Only paths are read, never contents; splits without
    images are passed over."""
    globs = _present(spark, root, splits, f"*/images_{method}/*.png")
    if not globs:
        return spark.createDataFrame([], "split string, sensor string, stem string")
    listed = spark.read.format("binaryFile").load(globs).select(F.col("path").alias("_path"))
    return _layout(listed, "_path").select("split", "sensor", _stem("_path", "png").alias("stem"))


def split_folder(split: str) -> str:
    return SPLIT_FOLDERS[check_split(split)]
