"""Read views: one row per record, with facts gathered by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.vocab import LIST_ITEMS, PREDICATE_PHRASES, STATUS_PHRASES
from claimweave.operators.filters import lookup


def record_sentence(subject: Column, predicate: Column, obj: Column, status: Column, scope: Column) -> Column:
    """One record as a sentence with its status and scope."""
    return F.concat(subject, F.lit(" "), lookup(PREDICATE_PHRASES, predicate), F.lit(" "), obj, F.lit(" ("),
                    lookup(STATUS_PHRASES, status), F.lit("; "), scope, F.lit(")"))


def assertion_details(assertions: DataFrame, supports: DataFrame, evidence: DataFrame, sources: DataFrame,
                      conflicts: DataFrame) -> DataFrame:
    """(assertion, supports, opposing, sources, conflicts, first_source): star join, each branch aggregated first.

    ``supports``: (assertion, evidence, stance); ``evidence``: (evidence, source); ``sources``: (source, source_kind);
    ``conflicts``: (assertion, conflict).
    """
    star = supports.join(evidence, "evidence").join(sources, "source")
    per = star.groupBy("assertion").agg(
        F.count("*").alias("supports"), F.count_if(F.col("stance") == "opposes").alias("opposing"),
        F.count_distinct("source").alias("sources"), F.min("source_kind").alias("first_kind"))
    clash = conflicts.groupBy("assertion").agg(F.count("*").alias("conflicts"))
    none = F.lit(0)
    return assertions.join(per, "assertion", "left").join(clash, "assertion", "left").select(
        *assertions.columns, F.coalesce("supports", none).alias("supports"), F.coalesce("opposing", none).alias("opposing"),
        F.coalesce("sources", none).alias("sources"), "first_kind", F.coalesce("conflicts", none).alias("conflicts"))


def assertion_evidence(supports: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(assertion, evidence, stance, source, source_kind): the evidence behind ``assertion_details``, one row each."""
    return supports.join(evidence, "evidence").join(sources, "source").select("assertion", "evidence", "stance", "source", "source_kind")


def asset_statements(owners: DataFrame, scopes: DataFrame, targets: DataFrame) -> DataFrame:
    """(asset, kind, record, other, exact): the owner and scope statements that ``asset_views`` counts."""
    hit = targets.select("target").distinct().withColumn("exact", F.lit(True))
    own = owners.select("asset", F.lit("owner").alias("kind"), "record", F.col("owner").alias("other"), F.lit(False).alias("exact"))
    scope = scopes.join(hit, "target", "left").select("asset", F.lit("scope").alias("kind"), "record", F.col("target").alias("other"), F.coalesce("exact", F.lit(False)).alias("exact"))
    return own.unionByName(scope)


def context_sentences(explanations: DataFrame, definitions: DataFrame) -> DataFrame:
    """(context, record, origin): a reviewed text's sentences, or else the records that stand in for them."""
    written = explanations.select("context", F.col("sentence").alias("record"), F.lit("reviewed").alias("origin"))
    rest = definitions.join(explanations.select("context").distinct(), "context", "left_anti")
    return written.unionByName(rest.select("context", F.col("assertion").alias("record"), F.lit("record").alias("origin")))


def asset_views(assets: DataFrame, owners: DataFrame, scopes: DataFrame, targets: DataFrame) -> DataFrame:
    """(asset, owner, statements, exact, position): last owner record wins, exact-target assets come first.

    ``owners``: (asset, owner, record); ``scopes``: (asset, target, record); ``targets``: (target).
    """
    own = owners.groupBy("asset").agg(F.max_by("owner", "record").alias("owner"), F.count("*").alias("own"))
    hit = targets.select("target").distinct().withColumn("_hit", F.lit(True))
    scope = scopes.join(hit, "target", "left").groupBy("asset").agg(
        F.count("*").alias("scoped"), F.bool_or(F.coalesce("_hit", F.lit(False))).alias("exact"))
    return assets.join(own, "asset", "left").join(scope, "asset", "left").select(
        "asset", "owner", (F.coalesce("own", F.lit(0)) + F.coalesce("scoped", F.lit(0))).alias("statements"),
        F.coalesce("exact", F.lit(False)).alias("exact"))


def context_views(contexts: DataFrame, explanations: DataFrame, definitions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(context, sentences, reviewed, limitations): a reviewed text wins over record sentences; gaps are spelled out.

    ``contexts``: (context, mechanism); ``explanations``: (context, sentence); ``definitions``: (context, assertion);
    ``profiles``: (context, direct_terms, unassessed).
    """
    written = explanations.groupBy("context").agg(F.count("*").alias("written"))
    templates = definitions.groupBy("context").agg(F.count("*").alias("templates"))
    j = contexts.join(written, "context", "left").join(templates, "context", "left").join(profiles, "context", "left")
    limits = F.array_compact(F.array(
        F.lit("grouping, not a diagnosis"), F.when(F.col("mechanism").isNull(), "mechanism unknown"),
        F.when(F.coalesce("direct_terms", F.lit(0)) == 0, "no baseline"),
        F.when(F.coalesce("unassessed", F.lit(0)) > 0, "scores withheld")))
    return j.select("context", F.coalesce("written", "templates", F.lit(0)).alias("sentences"),
                    F.col("written").isNotNull().alias("reviewed"), F.array_join(limits, "; ").alias("limitations"))


def context_profiles(contexts: DataFrame, claims: DataFrame, shown: int = LIST_ITEMS) -> DataFrame:
    """(context, profile_level, mechanism, disease_profile, subgroup_profile, limitations): both profiles of every context.

    ``contexts``: (context, profile_level, mechanism); ``claims``: (context, level, term, negated, assessed) with level
    disease_baseline or subgroup. A profile is a struct of its number of direct terms, of those without reference support
    and of those that are also denied, and the first ``shown`` terms. Only contexts of the level subgroup have a subgroup
    profile; one without terms is missing, not empty. What follows from the gaps is spelled out in ``limitations``.
    """
    terms = claims.groupBy("context", "level", "term").agg(F.bool_or(~F.col("negated")).alias("stated"), F.bool_or("negated").alias("denied"), F.bool_or("assessed").alias("assessed"))
    direct = terms.filter("stated")
    totals = direct.groupBy("context", "level").agg(
        F.count("*").alias("direct_terms"), F.count_if(~F.col("assessed")).alias("unassessed_terms"), F.count_if("denied").alias("open_disagreements"))
    order = Window.partitionBy("context", "level").orderBy("term")
    first = direct.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= shown).groupBy("context", "level").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    profile = totals.join(first, ["context", "level"])
    fields = ["direct_terms", "unassessed_terms", "open_disagreements", "terms"]
    j = contexts
    for level, name in (("disease_baseline", "disease_profile"), ("subgroup", "subgroup_profile")):
        j = j.join(profile.filter(F.col("level") == level).select("context", F.struct(*fields).alias(name)), "context", "left")
    has_subgroup = F.col("profile_level") == "subgroup"
    limits = F.array_compact(F.array(
        F.lit("grouping, not a diagnosis"), F.when(F.col("mechanism").isNull(), "mechanism unknown"), F.when(F.col("disease_profile").isNull(), "no baseline"),
        F.when(F.col("disease_profile.unassessed_terms") > 0, "scores withheld: terms without reference support"),
        F.when(F.col("disease_profile.open_disagreements") > 0, "scores withheld: open disagreements"),
        F.when(has_subgroup & F.col("subgroup_profile").isNull(), "subgroup profile is missing, not empty")))
    return j.select("context", "profile_level", "mechanism", "disease_profile", F.when(has_subgroup, F.col("subgroup_profile")).alias("subgroup_profile"), limits.alias("limitations"))


def snapshot_summary(snapshot: str, counts: dict[str, DataFrame], versions: DataFrame) -> DataFrame:
    """(name, value) rows: the snapshot, one count per table and each distinct source version."""
    spark = versions.sparkSession
    out = spark.createDataFrame([("snapshot", snapshot)], "name string, value string")
    for name, df in counts.items():
        out = out.unionByName(df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"rows:{name}").alias("name"), "value"))
    return out.unionByName(versions.select(F.concat(F.lit("version:"), "name").alias("name"), "value").distinct())


def readable_properties(lists: Column) -> Column:
    """List-valued properties as text; empty and null ones are left out."""
    kept = F.map_filter(lists, lambda _, v: v.isNotNull() & (F.size(v) > 0))
    return F.transform_values(kept, lambda _, v: F.array_join(v, ", "))
