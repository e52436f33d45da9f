"""Row filters, projections and rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.vocab import (
    ID_LENGTH,
    ANNOTATION_NAMESPACES, EFFECT_TERMS, NON_POSITIVE_VALIDITY, PROTOCOL_STATUSES, PUBLIC_METADATA, REVIEW_DIMENSIONS,
)


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict[str, str], key: Column) -> Column:
    """A short fixed table as an expression; null for unknown keys."""
    return F.try_element_at(literal_map(table), key)


def positive_annotations(rows: DataFrame, prefix: str) -> DataFrame:
    """Aspect P, not negated, from the reference namespace. The conjunction reaches the scan."""
    return rows.filter((F.col("aspect") == "P") & ~F.col("negated") & F.col("database_id").startswith(prefix))


def selected_by(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on), on, "left_semi")


def negation_status(qualifier: Column) -> Column:
    negated = F.array_contains(F.split(qualifier, r"\|"), "NOT")
    return F.when(negated, "negated").otherwise("listed_record")


def non_positive(validity: Column) -> Column:
    return F.coalesce(validity.isin(*NON_POSITIVE_VALIDITY), F.lit(False))


def groups_with_non_positive(rows: DataFrame, key: str, validity: str) -> DataFrame:
    """(key, excluded): a group is excluded when any of its rows has a non-positive classification."""
    return rows.groupBy(key).agg(F.bool_or(non_positive(F.col(validity))).alias("excluded"))


def contract_problems(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, problem) for edges that break the predicate contract.

    ``edges``: (id, subject, predicate, object, effect_direction, outcome_text); ``nodes``: (id, type, kind);
    ``rules``: (predicate, subject_types, object_types, asset_kind, direction_required).
    """
    s = nodes.select(F.col("id").alias("subject"), F.col("type").alias("s_type"))
    o = nodes.select(F.col("id").alias("object"), F.col("type").alias("o_type"), F.col("kind").alias("o_kind"))
    j = edges.join(rules, "predicate", "left").join(s, "subject", "left").join(o, "object", "left")
    known = F.col("subject_types").isNotNull()
    wrong_kind = (
        F.array_contains("object_types", F.col("o_type")) & F.col("asset_kind").isNotNull()
        & (F.col("o_type") == "asset") & ~F.col("o_kind").eqNullSafe(F.col("asset_kind"))
    )
    undirected = F.col("effect_direction").isin("unknown", "not_applicable") | (
        F.coalesce("outcome_text", F.lit("")) == ""
    )
    problems = F.when(~known, F.array(F.lit("unknown predicate"))).otherwise(F.array_compact(F.array(
        F.when(F.col("s_type").isNull(), "subject does not resolve"),
        F.when(~F.array_contains("subject_types", F.col("s_type")), "wrong subject type"),
        F.when(F.col("o_type").isNull(), "object does not resolve"),
        F.when(~F.array_contains("object_types", F.col("o_type")), "wrong object type"),
        F.when(wrong_kind, "wrong asset kind"),
        F.when(F.col("direction_required") & undirected, "direction and outcome required"),
    )))
    return j.select("id", F.explode(problems).alias("problem"))


def rules_frame(like: DataFrame, rules: dict) -> DataFrame:
    """Rules as literal rows, whose size is known: edges are not dealt by their few predicates to meet them."""
    def texts(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    rows = [F.struct(F.lit(p).alias("predicate"), texts(s).alias("subject_types"), texts(o).alias("object_types"), F.lit(kind).cast("string").alias("asset_kind"),
                     F.lit(need).alias("direction_required")) for p, (s, o, kind, need) in rules.items()]
    return like.sparkSession.range(1).select(F.inline(F.array(*rows)))


UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, problem) for every rule whose condition does not hold; null counts as broken."""
    found = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]))
    return df.select(id_col, F.explode(found).alias("problem"))


def exact_equivalents(mappings: DataFrame) -> DataFrame:
    """Exact mappings into an annotation namespace."""
    wanted = F.lit(False)
    for prefix in ANNOTATION_NAMESPACES:
        wanted = wanted | F.col("object_id").startswith(prefix)
    return mappings.filter((F.col("relation") == "exact") & wanted)


def unique_names(names: DataFrame) -> DataFrame:
    """(name, id): the id when exactly one has the name, else null."""
    return names.groupBy("name").agg(
        F.when(F.min("id") == F.max("id"), F.min("id")).alias("id"), F.count_distinct("id").alias("holders")
    )


def batch_targets(
    assertions: DataFrame, states: DataFrame, supports: DataFrame | None = None, *, predicate: str | None = None,
    origin: str | None = None, context_id=None, source_contains: str | None = None, ids: DataFrame | None = None,
    include_decided: bool = False,
) -> DataFrame:
    """Assertions a reviewer wants to decide together, with their current hash.

    ``states``: (id, state, current_hash); ``supports``: (id, source_ref).
    """
    chosen = assertions
    if predicate is not None:
        chosen = chosen.filter(F.col("predicate") == predicate)
    if origin is not None:
        chosen = chosen.filter(F.col("origin") == origin)
    if context_id is not None:
        chosen = chosen.filter(F.col("context_id") == context_id)
    if ids is not None:
        chosen = chosen.join(ids.select("id"), "id", "left_semi")
    if source_contains is not None:
        chosen = chosen.join(supports.filter(F.col("source_ref").contains(source_contains)), "id", "left_semi")
    wanted = states.filter(F.col("current_hash").isNotNull())
    if not include_decided:
        wanted = wanted.filter("state = 'pending'")
    return chosen.join(wanted, "id").select("id", "current_hash")


def decision_rows(
    targets: DataFrame, target_type: str, reviewer: str, reviewed_at: str, decision: str, reason: str
) -> DataFrame:
    """One decision per selected target; dimensions pass only for an acceptance."""
    verdict = "pass" if decision == "accepted" else "not_assessed"
    return targets.select(
        F.lit(target_type).alias("target_type"), F.col("id").alias("target_id"),
        F.col("current_hash").alias("target_hash"), F.lit(reviewer).alias("reviewer"),
        F.lit(reviewed_at).alias("reviewed_at"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason"),
        literal_map({d: verdict for d in REVIEW_DIMENSIONS}).alias("dimensions"),
    )


def public_metadata(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, v: k.isin(*PUBLIC_METADATA))


def spans_for_policy(policy: Column, spans: Column) -> Column:
    """Link-only sources expose no text."""
    return F.when(policy != "link_only", spans).otherwise(F.slice(spans, 1, 0))


def selection(curated: DataFrame, mapped: DataFrame) -> DataFrame:
    """(target, reasons): union of two reason streams; a reason is one short text per source row.

    Reasons stay rows; the summary holds their number and the first one.
    """
    return selection_reasons(curated, mapped).groupBy("target").agg(F.count("*").alias("reasons"), F.min("reason").alias("first_reason"))


def selection_reasons(curated: DataFrame, mapped: DataFrame) -> DataFrame:
    """(target, reason): why each target is selected, one row per reason."""
    return curated.select("target", "reason").unionByName(mapped.select("target", "reason"))


def stated_effect(term: Column) -> Column:
    return lookup(EFFECT_TERMS, term)


def protocol_conflicts(rows: DataFrame) -> DataFrame:
    """Supporting rows from a protocol that carry a status a protocol cannot support."""
    return rows.filter(
        (F.col("document_role") == "protocol") & (F.col("stance") == "supports")
        & ~F.col("statement_status").isin(*PROTOCOL_STATUSES)
    )


def approved(pages: DataFrame, exact: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages split into (accepted with the rule that let them in, rejected).

    ``exact``: (url). ``prefixes``: (prefix): a prefix is matched by equality after cutting the URL to each length that
    occurs among the prefixes, so this is a join on text and not a comparison of every page with every prefix.
    """
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths")).scalar()  # distinct lengths only
    by_prefix = (
        pages.select("url").distinct().withColumn("lengths", lengths)
        .select("url", F.explode(F.filter("lengths", lambda n: n <= F.length("url"))).alias("len"))
        .withColumn("prefix", F.expr("substring(url, 1, len)")).join(prefixes, "prefix", "left_semi")
        .select("url").distinct().withColumn("by_prefix", F.lit(True))
    )
    by_url = exact.select("url").distinct().withColumn("by_url", F.lit(True))
    marked = pages.join(by_url, "url", "left").join(by_prefix, "url", "left")
    rule = F.when(F.col("by_url"), "page").when(F.col("by_prefix"), "prefix")
    marked = marked.withColumn("rule", rule).drop("by_url", "by_prefix")
    return marked.filter("rule is not null"), marked.filter("rule is null").drop("rule")


def with_marker(captures: DataFrame, marker: Column) -> DataFrame:
    """Successful, non-empty captures that show the expected text (any text when no marker is given)."""
    return captures.filter(
        (F.col("status") == 200) & (F.length("body") > 0) & F.coalesce(F.contains("body", marker), F.lit(True))
    )


def entity_rules(prefixes: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """What every entity (id, type, label) must fulfil: a known type, an id with a prefix of it and of bounded length, a label."""
    fits = F.lit(False)
    for kind, starts in prefixes.items():
        for start in starts:
            fits = fits | ((F.col("type") == kind) & F.startswith("id", F.lit(start)))
    return {
        "type is known": F.col("type").isin(*prefixes), "id has a prefix of its type": fits | ~F.col("type").isin(*prefixes),
        "id is not too long": F.length("id") <= ID_LENGTH, "label is not empty": F.length(F.trim(F.coalesce("label", F.lit("")))) > 0,
    }


def span_rules() -> dict[str, Column]:
    """What every quoted span (start, stop, quote, size) of a text of ``size`` characters must fulfil."""
    return {
        "span is not empty": (F.col("start") >= 0) & (F.col("start") < F.col("stop")), "span lies inside the text": F.col("stop") <= F.col("size"),
        "quote is as long as the span": F.length("quote") == F.col("stop") - F.col("start"),
    }


def sentence_rules() -> dict[str, Column]:
    """What every sentence (text, assertion_ids, calculation_ids, opportunity_ids) must fulfil."""
    named = reduce(lambda x, y: x + y, [F.coalesce(F.size(c), F.lit(0)) for c in ("assertion_ids", "calculation_ids", "opportunity_ids")])
    return {"sentence names a record": named > 0, "sentence has a text": F.length(F.trim("text")) > 0}
