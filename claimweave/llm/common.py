"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Spans = list[tuple[int, int, str]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_row(df: DataFrame, text: str, keys: list[str], fn: Callable[[str], tuple], fields: str) -> DataFrame:
    """``keys`` of every row and what ``fn`` finds in its whole text, a null text being empty.

    Rows stay where they are: no shuffle, one Arrow batch of whole texts in memory at a time.
    """
    kept = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            found = [fn(texts[i].as_py() or "") for i in range(batch.num_rows)]
            columns = [batch.column(i) for i in range(len(keys))]
            columns += [pa.array(values) for values in zip(*found, strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *(f.split()[0] for f in fields.split(", "))])

    return kept.mapInArrow(run, schema)


def spans_text(spans: Spans, order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside: whole texts are long, and a task holds several batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, kept)
