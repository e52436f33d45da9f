"""Ordering, limits, retrieval and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.text import fold, normalize_key, word_tokens
from claimweave.functions.vocab import SEARCH_CONTEXTS, SEARCH_MATCHES
from claimweave.operators.similarity import top_partners
from claimweave.operators.windows import best_alias, latest_per_key


def search(aliases: DataFrame, entities: DataFrame, query: str, limit: int = SEARCH_MATCHES) -> DataFrame:
    """Entities whose alias or id equals, starts with or contains the query: the first ``limit`` by (rank, label, id).

    ``aliases``: (entity, alias, pos); ``entities``: (entity, label). ``ambiguous`` marks aliases with several owners and
    several exact hits; ``total`` is the number of matches before the cut.
    """
    key = F.lit(fold(query))
    own_id = entities.select("entity", F.col("entity").alias("alias"), F.lit((1 << 31) - 1).alias("pos"))
    rows = aliases.select("entity", "alias", "pos").unionByName(own_id).withColumn("key", normalize_key(F.col("alias")))
    rank = F.when(F.col("key") == key, 0).when(F.startswith("key", key), 1).when(F.contains("key", key), 2)
    best = best_alias(rows.withColumn("rank", rank).filter("rank is not null"))
    totals = best.agg(F.count("*").alias("total"), F.count_if(F.col("rank") == 0).alias("exact"))
    totals_row = totals.select(F.struct("total", "exact").alias("t")).scalar()
    top = (
        best.join(entities, "entity").select("entity", "label", "alias", "key", "rank")
        .orderBy("rank", F.lower("label"), "entity").limit(limit)
    )
    hit_keys = top.select("key").distinct()
    owners = (
        aliases.withColumn("key", normalize_key(F.col("alias"))).join(hit_keys, "key", "left_semi")
        .groupBy("key").agg(F.count_distinct("entity").alias("owners"))
    )
    return top.join(owners, "key", "left").withColumn("t", totals_row).select(
        "entity", "label", "rank",
        F.when(F.col("alias") != F.col("label"), F.col("alias")).alias("matched_alias"),
        ((F.coalesce("owners", F.lit(0)) > 1) | ((F.col("rank") == 0) & (F.col("t.exact") > 1))).alias("ambiguous"),
        F.col("t.total").alias("total"), (F.col("t.total") > limit).alias("truncated"))


def search_contexts(matches: DataFrame, contexts: DataFrame, limit: int = SEARCH_CONTEXTS) -> DataFrame:
    """(entity, place, context, contexts, warning): the first ``limit`` contexts of every match by id, with their number.

    ``contexts``: (entity, context). A match without a context has one row without one. ``warning`` says how many contexts
    are shown if not all are. Matches are few, so contexts are cut per match before anything is sorted.
    """
    mine = contexts.select("entity", "context").distinct().join(matches.select("entity"), "entity", "left_semi")
    order = Window.partitionBy("entity").orderBy("context")
    shown = mine.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    totals = mine.groupBy("entity").agg(F.count("*").alias("contexts"))
    rows = matches.select("entity").join(shown, "entity", "left").join(totals, "entity", "left").withColumn("contexts", F.coalesce("contexts", F.lit(0)))
    warning = F.when(F.col("contexts") > limit, F.format_string(f"CONTEXTS_TRUNCATED: showing {limit} of %d", "contexts"))
    return rows.select("entity", "place", "context", "contexts", warning.alias("warning"))


def retrieve(mentions: DataFrame, aliases: DataFrame, limit: int = 5) -> DataFrame:
    """(mention, entity, score, rank): the best entities per mention by token overlap of any alias, then by id.

    ``mentions``: (mention) and ``aliases``: (entity, alias). If both also have ``type``, a mention is answered with
    entities of its type only, and ``type`` is in the result. The search ranks entities, each by its best alias
    (``similarity.top_partners`` with owners), so how many aliases an entity has does not matter. All owners of one alias
    key score alike: the first ``limit`` of them by id are enough to fill any answer.
    """
    typed = "type" in mentions.columns and "type" in aliases.columns
    level = F.col("type") if typed else F.lit("")

    def profile(df: DataFrame, *more: str) -> DataFrame:
        tokens = F.explode(F.array_distinct(word_tokens(F.col("key"))))
        return df.select("entity", "level", *more, tokens.alias("term"), F.lit(1.0).alias("weight"))

    wanted = mentions.select(F.col("mention").alias("entity"), level.alias("level"), normalize_key(F.col("mention")).alias("key")).distinct()
    order = Window.partitionBy("level", "key").orderBy("owner")
    keys = aliases.select(level.alias("level"), normalize_key(F.col("alias")).alias("key"), F.col("entity").alias("owner")).distinct()
    owners = keys.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    named = owners.withColumn("entity", F.concat("owner", F.lit("\u0001"), "key"))
    best = top_partners(profile(wanted), profile(named, "owner"), limit, exclude_self=False)
    return best.select(F.col("a").alias("mention"), *([F.col("level").alias("type")] if typed else []), F.col("b").alias("entity"), "score", "rank")


def capped_lists(rows: DataFrame, key: str, item: str, cap: int) -> DataFrame:
    """(key, items, total, truncated): the first ``cap`` items per key in order. Each task cuts before the shuffle."""
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    order = Window.partitionBy(key).orderBy(item)
    cut = rows.select(key, item).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= cap)
    lists = cut.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most ``cap`` items
    return lists.join(totals, key).withColumn("truncated", F.col("total") > cap)


def total_order(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted rows: files of the result follow the key without one task sorting all."""
    parted = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    return parted.sortWithinPartitions(key)


def merge_parts(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of stage parts where the last part wins per key."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return latest_per_key(reduce(DataFrame.unionByName, tagged), [key], ["part"])


def append_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, parts)


def needed_entities(references: list[DataFrame], entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities any reference names, and references that no entity answers. References: (id)."""
    needed = reduce(DataFrame.unionByName, [r.select("id") for r in references]).filter("id is not null").distinct()
    return entities.join(needed, "id", "left_semi"), needed.join(entities.select("id"), "id", "left_anti")
