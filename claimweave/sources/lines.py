"""Text files with exact physical line numbers, however large a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, out: str = "line_no") -> DataFrame:
    """Adds ``file`` and the 1-based row number within the file, for any file source read in splits.

    Rows of one split are contiguous, so a row's number is its distance from the first row of its split plus the rows of
    earlier splits of the file. Only one small row per split is ordered; no file passes through one task.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
                     F.monotonically_increasing_id().alias("_mid"))
    splits = rows.groupBy("file", "_split").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.join(offsets, ["file", "_split"])
    return numbered.withColumn(out, F.col("_mid") - F.col("_first") + F.col("_offset") + 1).drop("_split", "_mid", "_first", "_offset")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), blank lines included; gzip files are read transparently."""
    return number_rows(spark.read.text(path))


def header_of(lines: DataFrame, is_header: Column) -> DataFrame:
    """(file, header_no, header): the first qualifying line of each file."""
    return lines.filter(is_header).groupBy("file").agg(
        F.min("line_no").alias("header_no"), F.min_by("value", "line_no").alias("header"))


def cell(cells: Column, names: Column, name: str) -> Column:
    """The cell below a named column; null when the row or the header lacks it."""
    return F.get(cells, F.nullif(F.array_position(names, name), F.lit(0)).cast("int") - 1)
