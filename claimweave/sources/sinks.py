"""Writing records, stage parts and immutable snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.identity import canonical_json
from claimweave.operators.fingerprints import snapshot_hash, snapshot_id
from claimweave.operators.quality import duplicate_ids, report
from claimweave.sources.records import read_snapshot


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Canonical JSON lines: files follow the key, rows are sorted within each, keys sorted, nulls written."""
    rows = df.select(F.col(key).alias("_key"), canonical_json(**{c: F.col(c) for c in df.columns}).alias("value"))
    rows.repartitionByRange("_key").sortWithinPartitions("_key").select("value").write.mode("overwrite").text(path)


def flatten_rows(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Key columns taken from dotted paths, and the whole row as a JSON payload."""
    return df.select(*[F.col(path).alias(name) for name, path in keys.items()],
                     F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))


def write_part(tables: dict[str, DataFrame], path: str) -> None:
    """Rewrite one stage part, a table per record kind."""
    for kind, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{kind}")


def package(tables: dict[str, DataFrame], leave_out: dict[str, tuple[str, ...]] | None = None) -> tuple[str, DataFrame]:
    """(snapshot id, table hashes). Equal content has equal id, whatever the order and partitioning of rows."""
    hashes = snapshot_hash(tables, leave_out)
    return snapshot_id(hashes), hashes


def write_package(tables: dict[str, DataFrame], base: str, snapshot: str) -> None:
    """Each table's rows below ``snapshot_id=<id>``; other snapshots are untouched."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/snapshot_id={snapshot}")


def load_problems(spark: SparkSession, base: str, snapshot: str, keys: dict[str, str], leave_out: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(owner, problem): a stored snapshot must hash to its own id and have unique ids per table."""
    tables = read_snapshot(spark, base, snapshot, list(keys))
    found, _ = package(tables, leave_out)
    wrong = spark.range(1).filter(F.lit(found != snapshot)).select(
        F.lit("package").alias("owner"), F.lit(f"content hash {found} does not match {snapshot}").alias("problem"))
    return report([wrong] + [duplicate_ids(df, keys[n], n) for n, df in tables.items()])


class Store:
    """Published snapshots: append-only, one commit row per snapshot, written last."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.base}/_commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # a log that is there but cannot be read is no empty log
                raise
            return self.spark.createDataFrame([], "table_name string, row_count bigint, table_sha string, snapshot string")

    def publish(self, tables: dict[str, DataFrame], leave_out: dict[str, tuple[str, ...]] | None = None) -> tuple[str, str]:
        """(snapshot id, outcome): 'published', 'unchanged' when stored content still matches, or 'corrupt'.

        Rows are written first, read back and hashed, and only then committed: a run that dies half-way leaves nothing
        a reader can see, and the next run writes the same partition again.
        """
        snapshot, hashes = package(tables, leave_out)
        names = list(tables)
        known = not self.commits().filter(F.col("snapshot") == snapshot).isEmpty()
        if not known:
            write_package(tables, self.base, snapshot)
        stored, _ = package(read_snapshot(self.spark, self.base, snapshot, names), leave_out)
        if stored != snapshot:
            return snapshot, "corrupt"
        if known:
            return snapshot, "unchanged"
        hashes.withColumn("snapshot", F.lit(snapshot)).coalesce(1).write.mode("append").parquet(f"{self.base}/_commits")
        return snapshot, "published"
