"""Strict record files, verified captures, pinned snapshots and the capture index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.windows import latest_per_key
from claimweave.session import cut_lineage
from claimweave.sources.lines import read_lines

# JSON type names by Spark type, as ``schema_of_variant`` spells them.
JSON_TYPES = {
    "string": r"^STRING$", "bigint": r"^BIGINT$", "int": r"^BIGINT$", "double": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$", "array": r"^ARRAY<", "struct": r"^OBJECT<", "map": r"^OBJECT<",
}


def read_strict(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of JSON lines. Blank lines are skipped; an unknown or absent key and a wrong JSON type are problems.

    Nothing is coerced: types are read from the JSON itself before it is parsed with the schema. Nulls are allowed.
    """
    schema = spark.createDataFrame([], ddl).schema
    lines = read_lines(spark, path).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    keys = F.json_object_keys("value")
    expected = F.array(*[F.lit(f.name) for f in schema.fields])
    checks = [
        F.when(F.col("v").isNull() | keys.isNull(), F.lit("not a JSON object")),
        F.when(F.size(F.array_except(keys, expected)) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(F.array_except(keys, expected)), ", "))),
        F.when(F.size(F.array_except(expected, keys)) > 0, F.concat(F.lit("absent keys: "), F.array_join(F.array_sort(F.array_except(expected, keys)), ", "))),
    ]
    for f in schema.fields:
        kind = f.dataType.simpleString().split("<")[0]
        found = F.schema_of_variant(F.try_variant_get("v", f"$.{f.name}", "variant"))
        ok = found.rlike(JSON_TYPES[kind]) | (found == "VOID")
        checks.append(F.when(found.isNotNull() & ~ok, F.lit(f"wrong type of {f.name}")))
    judged = lines.withColumn("problems", F.array_compact(F.array(*checks)))
    records = judged.filter(F.size("problems") == 0).select(F.from_json("value", schema).alias("r"), "line_no").select("line_no", "r.*")
    return records, judged.filter(F.size("problems") > 0).select("file", "line_no", "value", F.explode("problems").alias("problem"))


CHUNK = 1 << 20  # bytes of a file in memory at a time
TASK_SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")  # stores that tasks can open themselves


def _digests(folder: str):
    """(path, digest, bytes) of the files named in a partition; a file that is not there has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = folder.replace("s3a://", "s3://", 1)
        store, root = (fs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(uri)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                sha, size = hashlib.sha256(), 0
                try:
                    with store.open_input_stream(f"{root.rstrip('/')}/{path}", compression=None) as file:
                        while chunk := file.read(CHUNK):
                            sha.update(chunk)
                            size += len(chunk)
                    out.append((path, sha.hexdigest(), size))
                except FileNotFoundError:
                    out.append((path, None, None))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "digest", "bytes"])

    return run


def file_digests(paths: DataFrame, folder: str) -> DataFrame:
    """(path, digest, bytes) of every distinct ``path`` below ``folder``, SHA-256 read in chunks where the row lies.

    The rows of the manifest plan the work: no folder is listed, and files of any size pass in constant memory. Stores that
    only Spark can open are read by Spark's own file source instead, which lists the folder.
    """
    spark = paths.sparkSession
    scheme = folder.split("://", 1)[0] if "://" in folder else folder.split(":", 1)[0] if folder.startswith("file:") else ""
    if scheme in TASK_SCHEMES:
        return paths.select("path").distinct().mapInArrow(_digests(folder), "path string, digest string, bytes bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def verified_files(spark: SparkSession, folder: str, manifests: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(verified, problems): every usable manifest row must find its file with the recorded SHA-256.

    Manifests: (key, path, sha256, ok); paths are relative to ``folder``. File content never leaves the tasks that read it.
    """
    rows = manifests[0]
    for m in manifests[1:]:
        rows = rows.unionByName(m)
    wanted = rows.filter(F.col("ok") & F.col("path").isNotNull())
    j = cut_lineage(wanted.join(file_digests(wanted, folder), "path", "left"), "verified")  # read once for both results
    problem = F.when(F.col("digest").isNull(), "file is missing").when(F.col("digest") != F.col("sha256"), "SHA-256 differs")
    judged = j.withColumn("problem", problem)
    return judged.filter("problem is null").select("key", "path", "digest", "bytes"), judged.filter("problem is not null").select("key", "path", "problem")


def capture_index(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry per key of an append-only log."""
    return latest_per_key(log, [key], [order])


def read_snapshot(spark: SparkSession, base: str, snapshot: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of one snapshot. The filter on the partition column means other snapshots are not read."""
    return {n: spark.read.parquet(f"{base}/{n}").filter(F.col("snapshot_id") == snapshot).drop("snapshot_id") for n in tables}


def count_problems(tables: dict[str, DataFrame], recorded: DataFrame) -> DataFrame:
    """(table_name, recorded, found) where the row counts differ. ``recorded``: (table_name, row_count)."""
    parts = [df.agg(F.count("*").alias("found")).select(F.lit(n).alias("table_name"), "found") for n, df in tables.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return recorded.join(found, "table_name", "left").filter(~F.col("row_count").eqNullSafe(F.col("found"))).select(
        "table_name", F.col("row_count").alias("recorded"), "found")
