"""Streams over append-only logs: latest decision per target and spend per day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A growing folder of Parquet files as a stream; ``name`` selects files.

    ``files_per_batch`` bounds a micro-batch, and with it what a stateful operator sees of one key at a time.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option(
        "maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_changes(reviews: DataFrame) -> DataFrame:
    """Streaming reviews to the targets whose latest review changed with the micro-batch, for update mode.

    State is one row per target. A row remembers the time of the batch that brought it, which a replay repeats, so a
    target that only got older reviews, or the same one again, is not among the changes.
    """
    rest = [c for c in reviews.columns if c not in ("target_type", "target_id")]
    rows = reviews.withColumn("_came", F.unix_millis(F.current_timestamp()))
    newest = F.max_by(F.struct(*rest, "_came"), F.struct("reviewed_at", "id", -F.col("_came")))
    best = rows.groupBy("target_type", "target_id").agg(newest.alias("row"), F.max("_came").alias("_touched"))
    return best.filter("row._came = _touched").select("target_type", "target_id", *[F.col(f"row.{c}").alias(c) for c in rest])


def spend_view(days: DataFrame, cap: float) -> DataFrame:
    """(day, spent, remaining, over_cap) of a ledger's days."""
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "spent",
        F.greatest(F.lit(0.0), F.lit(cap) - F.col("spent")).alias("remaining"), (F.col("spent") > cap).alias("over_cap"))


def run_batches(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Send everything available to ``write`` in micro-batches; offsets and state live at ``checkpoint``, where a later run
    goes on. Returns the finished query with its progress."""
    spark = stream.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return query


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over everything available and return the table it wrote.

    Each micro-batch is added once, told apart by its number. Offsets and state live in the shared folder.
    """
    base = scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    run_batches(stream, "append", write, f"{base}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/table/batch=*")
