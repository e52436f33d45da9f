"""Sections of texts with half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paragraph_sections(df: DataFrame, id_col: str, text_col: str, prefix: str = "paragraph") -> DataFrame:
    """(id, label, start, stop) of blocks of non-empty lines. The window spans the pieces of one text only."""
    pieces = F.regexp_extract_all(text_col, F.lit("[^\n]+(?:\n[^\n]+)*|\n+"), F.lit(0))
    rows = df.select(id_col, F.posexplode(pieces).alias("pos", "piece")).select(
        id_col, "pos", F.length("piece").alias("len"), (~F.col("piece").startswith("\n")).alias("body"))
    w = Window.partitionBy(id_col).orderBy("pos")
    placed = rows.withColumn("stop", F.sum("len").over(w)).withColumn("n", F.count_if("body").over(w))
    return placed.filter("body").select(
        id_col, F.concat(F.lit(prefix + " "), "n").alias("label"), (F.col("stop") - F.col("len")).alias("start"), "stop")
