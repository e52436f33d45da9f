"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


OWN_FOLDER = "spark.claimweave.scratch"
_SHIPPED: set[str] = set()


def local_session(cpus: str | int = "*", app: str = "claimweave", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(OWN_FOLDER, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/claimweave/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives the loss of executors, ends the growing plan of an iterative job, and gives the optimizer real
    sizes, so that it broadcasts only what it has measured.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans, broadcasts and shuffles of finished jobs: Spark cleans them up only when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str = "bucketed", placed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key`` and read it back, so that later joins on it need not move it.

    ``placed``: the rows come out of a join or an aggregation on ``key`` and are not dealt again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"claimweave_{path.rsplit('-', 1)[1]}"
    (df if placed else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions find it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))  # Spark serves the driver's file to every executor
