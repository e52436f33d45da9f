"""Sort-then-pick operators.

Picking one row per key is an aggregate (``max_by`` / ``min_by``), which combines map-side, so a key holding a third of
all rows never passes through one task. Running totals use blocks: sums per block first, then offsets, then rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def effective_state(targets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Targets (target_type, target_id, current_hash) with the state their latest review gives them.

    No review: pending. A review of other content: pending and stale. Otherwise the decision.
    """
    latest = latest_per_key(reviews, ["target_type", "target_id"], ["reviewed_at", "id"])
    joined = targets.join(latest, ["target_type", "target_id"], "left")
    same = F.col("target_hash").eqNullSafe(F.col("current_hash")) & F.col("current_hash").isNotNull()
    return joined.select(
        "target_type", "target_id", "current_hash",
        F.when(F.col("id").isNotNull() & same, F.col("decision")).otherwise(F.lit("pending")).alias("state"),
        (F.col("id").isNotNull() & ~same).alias("stale"), F.col("id").alias("review_id"),
    )


def top_cards(cards: DataFrame, k: int) -> DataFrame:
    """Per start: ranked cards by score (highest first, then other id), then unranked by other id; the first ``k``."""
    order = Window.partitionBy("a").orderBy(F.col("score").isNull(), F.desc_nulls_last("score"), "b")
    return cards.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def latest_version(df: DataFrame, keys: list[str], version: str, numeric: bool = False) -> DataFrame:
    """The largest version per key as text ('9' beats '10'), or as a number."""
    value = F.col(version).cast("string")
    top = F.max_by(value, F.col(version).cast("bigint")) if numeric else F.max(value)
    return df.groupBy(*keys).agg(top.alias("version"))


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_number, line) with 1-based physical lines."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return lines.select(id_col, (F.col("pos") + 1).alias("line_number"), "line")


def running_total(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = 4096, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Exclusive running sum of ``value`` by the integer ``order``, then ``ties``, within ``keys``.

    No task sorts a whole key: rows are summed within blocks of ``order``, and only block totals are ordered per key.
    """
    data = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / block))
    totals = data.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = data.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = local.join(offsets, [*keys, "_block"])
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).drop("_v", "_block", "_local", "_offset")


def window_names(df: DataFrame, keys: list[str], order: str, base: Column, out: str) -> DataFrame:
    """``base#window<k>`` in order when a key has several rows, else plain ``base``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = running_total(df, keys, order, F.lit(1), "_before").join(counts, keys)
    name = F.concat(base, F.lit("#window"), (F.col("_before") + 1).cast("string"))
    return ranked.withColumn(out, F.when(F.col("_n") > 1, name).otherwise(base)).drop("_n", "_before")


def best_alias(aliases: DataFrame) -> DataFrame:
    """(entity, alias, rank, pos) to the first alias of minimum rank."""
    return first_per_key(aliases, ["entity"], ["rank", "pos"])
