"""Tables that micro-batches write: a keyed table of changes and a ledger of open and closed days.

Every batch writes folders named by its number and reads only what lower numbers have left, so a batch that is run again
after a failure puts the same rows in the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables below ``path``: one short name a batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))


def _number(folder: str) -> int:
    return int(folder.split("=")[1])


class UpsertTable:
    """The newest row of each key, kept as a base and one folder of changed keys per micro-batch.

    Writing costs the changed keys, whatever the size of the table; ``compact`` folds the changes into a new base. The row
    of the highest batch wins, and each row carries that number as ``version``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The changed rows of one micro-batch, one per key."""
        batch.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/changes/{self._name(batch_id)}")

    @staticmethod
    def _name(batch_id: int) -> str:
        return f"batch={batch_id:012d}"

    def current(self) -> DataFrame:
        """One row per key: the newest of the base and the changes that are not yet in it."""
        bases, upto, parts = _folders(self.spark, f"{self.path}/base"), -1, []
        if bases:
            upto = _number(bases[-1])
            parts.append(f"{self.path}/base/{bases[-1]}")
        parts += [f"{self.path}/changes/{n}" for n in _folders(self.spark, f"{self.path}/changes") if _number(n) > upto]
        if not parts:
            raise ValueError(f"nothing was written to {self.path}")
        rows = self.spark.read.option("basePath", self.path).option("recursiveFileLookup", True).parquet(*parts)
        rest = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("version")).alias("row"))
        return newest.select(*self.keys, "row.*")

    def compact(self) -> None:
        """Write a base that holds all finished batches; older folders stay until the table's owner expires them."""
        done = _folders(self.spark, f"{self.path}/changes")
        if done:
            self.current().write.mode("overwrite").parquet(f"{self.path}/base/upto={_number(done[-1]):012d}")


class DayLedger:
    """Sums per UTC day that close when the watermark passes them; rows of closed days go to a side table.

    The watermark is the largest time of earlier batches less ``late``. State is the table of open days that the last
    batch left: as many rows as days lie within ``late`` of the newest one (or were never passed).
    """

    def __init__(self, spark: SparkSession, path: str, late: str) -> None:
        self.spark, self.path, self.late = spark, path, F.expr(f"INTERVAL {late}")

    def _at(self, part: str, batch_id: int) -> str:
        return f"{self.path}/{part}/{UpsertTable._name(batch_id)}"

    def _previous(self, part: str, batch_id: int) -> DataFrame | None:
        older = [n for n in _folders(self.spark, f"{self.path}/{part}") if _number(n) < batch_id]
        return self.spark.read.parquet(f"{self.path}/{part}/{older[-1]}") if older else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Charges (at, amount) of one micro-batch."""
        before = self._previous("mark", batch_id)
        mark = before.first()["mark"] if before is not None else None  # one row
        day = F.date_trunc("day", "at")
        end = F.expr("day + INTERVAL 1 DAY")
        rows = batch.withColumn("day", day)
        too_late = F.lit(False) if mark is None else end <= F.lit(mark) - self.late
        rows.filter(too_late).drop("day").write.mode("overwrite").parquet(self._at("late", batch_id))
        fresh = rows.filter(~too_late).groupBy("day").agg(F.sum("amount").alias("spent"), F.count("*").alias("charges"), F.max("at").alias("newest"))
        open_days = self._previous("open", batch_id)
        if open_days is not None:
            fresh = fresh.unionByName(open_days).groupBy("day").agg(F.sum("spent").alias("spent"), F.sum("charges").alias("charges"), F.max("newest").alias("newest"))
        path = self._at("days", batch_id)
        fresh.write.mode("overwrite").parquet(path)
        days = self.spark.read.parquet(path)
        newest = days.agg(F.max("newest")).first()[0]
        mark = max((v for v in (mark, newest) if v is not None), default=None)
        closes = F.lit(False) if mark is None else end <= F.lit(mark) - self.late
        days.filter(closes).write.mode("overwrite").parquet(self._at("closed", batch_id))
        days.filter(~closes).write.mode("overwrite").parquet(self._at("open", batch_id))
        self.spark.createDataFrame([(mark,)], "mark timestamp").coalesce(1).write.mode("overwrite").parquet(self._at("mark", batch_id))

    def _all(self, part: str) -> DataFrame:
        done = [_number(n) for n in _folders(self.spark, f"{self.path}/mark")]
        return self.spark.read.parquet(*[self._at(part, n) for n in done])

    def closed_days(self) -> DataFrame:
        """(day, spent, charges, newest), each day once."""
        return self._all("closed")

    def open_days(self) -> DataFrame:
        done = _folders(self.spark, f"{self.path}/mark")
        return self.spark.read.parquet(self._at("open", _number(done[-1])))

    def late_rows(self) -> DataFrame:
        return self._all("late")
