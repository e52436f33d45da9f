"""Data-quality checks. Every check returns problem rows, so nothing is fixed silently and reports can be unioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.text import line_at, whole_number_in
from claimweave.operators.text_joins import spans_hold


def dangling(rows: DataFrame, owner: str, ref: str, targets: DataFrame, target: str, what: str) -> DataFrame:
    """(owner, problem) for references (a column or an array column) without a target row; nulls refer to nothing."""
    is_array = dict(rows.dtypes)[ref].startswith("array")
    refs = rows.select(F.col(owner).cast("string").alias("owner"),
                       (F.explode(ref) if is_array else F.col(ref)).alias("ref")).filter("ref is not null")
    lost = refs.join(targets.select(F.col(target).alias("ref")), "ref", "left_anti")
    return lost.select("owner", F.concat(F.lit(f"dangling {what} "), F.col("ref").cast("string")).alias("problem"))


def duplicate_ids(rows: DataFrame, key: str, table: str) -> DataFrame:
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return twice.select(F.lit(table).alias("owner"), F.concat(F.lit("duplicate id "), F.col(key).cast("string")).alias("problem"))


def unsupported(assertions: DataFrame, key: str, supports: DataFrame) -> DataFrame:
    """Assertions without a supporting row. ``supports``: (key, stance)."""
    ok = supports.filter("stance = 'supports'").select(key)
    return assertions.join(ok, key, "left_anti").select(
        F.col(key).cast("string").alias("owner"), F.lit("no accepted supporting evidence").alias("problem"))


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rule_report(parts: dict[str, DataFrame]) -> DataFrame:
    """(rule, id, problem): reports (id, problem) of several rules as one, ids as text."""
    return report([df.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"), "problem") for rule, df in parts.items()])


def problem_lists(problems: DataFrame, key: str) -> DataFrame:
    """(key, problems, text): distinct problem kinds per key. Kinds come from a fixed set, so the lists are short."""
    return problems.select(key, "problem").distinct().groupBy(key).agg(
        F.count("*").alias("problems"), F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("text"))


def span_problems(spans: DataFrame) -> DataFrame:
    """(span_id, problem) for spans (start, stop, quote) that do not match ``text``."""
    return spans.filter(~F.coalesce(spans_hold(spans), F.lit(False))).select(
        "span_id", F.lit("quote does not match text").alias("problem"))


def cited_row_problems(cited: DataFrame) -> DataFrame:
    """(id, problem): non-empty cited fields that are no cell of the cited line. ``cited``: (id, text, line_no, fields)."""
    cells = F.split(line_at(F.col("text"), F.col("line_no")), "\t", -1)
    lost = F.array_except(F.filter("fields", lambda f: f != ""), cells)
    return cited.select("id", F.explode(lost).alias("field")).select(
        "id", F.concat(F.lit("field is not on the cited line: "), "field").alias("problem"))


def count_in_window(window: Column, count: Column) -> Column:
    """A stated count must appear as its own number."""
    return whole_number_in(window, count)


def qualifier_support(qualifiers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(assertion, qualifier, supported): verbatim in a text window, or a record value, also as ``name: value``.

    ``qualifiers``: (assertion, qualifier); ``evidence``: (assertion, window, fields map) with one of the two null.
    """
    value = F.when(F.contains("qualifier", F.lit(": ")), F.expr("substring(qualifier, locate(': ', qualifier) + 2)"))
    named = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    values = F.map_values("fields")
    in_record = F.array_contains(values, F.col("qualifier")) | F.array_contains(named, F.col("qualifier")) | F.coalesce(
        F.array_contains(values, value), F.lit(False))
    ok = F.coalesce(F.contains("window", F.col("qualifier")), F.lit(False)) | F.coalesce(in_record, F.lit(False))
    return qualifiers.join(evidence, "assertion", "left").groupBy("assertion", "qualifier").agg(F.bool_or(ok).alias("supported"))


def permitted_windows(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, start, stop) a reviewer may see: from the first to the last section that holds a span, else the whole text.

    ``spans``: (key, span_id, s_start, s_stop) with null bounds when no section holds the span; ``texts``: (key, len).
    """
    agg = spans.groupBy(key).agg(
        F.min("s_start").alias("lo"), F.max("s_stop").alias("hi"), (F.count("*") == F.count("s_start")).alias("all_in"))
    return texts.join(agg, key).select(
        key, F.when(F.col("all_in"), F.col("lo")).otherwise(F.lit(0)).alias("start"),
        F.when(F.col("all_in"), F.col("hi")).otherwise(F.col("len")).alias("stop"))


def audit_problems(contexts: DataFrame, audit: DataFrame, required: list[str]) -> DataFrame:
    """(context, problem): first failing audit rule. ``contexts``: (context, disease); ``audit`` adds the fields."""
    j = contexts.join(audit.withColumn("_has", F.lit(True)), "context", "left")
    absent = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in required])
    problem = (
        F.when(F.col("_has").isNull() | absent, "no complete audit entry")
        .when(~F.col("audited_disease").eqNullSafe(F.col("disease")), "audited disease differs")
        .when(F.size("justification") == 0, "no sources justify the granularity")
    )
    return j.select("context", problem.alias("problem")).filter("problem is not null")


def publication_gate(
    assertions: DataFrame, structural: DataFrame, states: DataFrame, published: DataFrame, open_buckets: DataFrame,
    conflicts: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(published assertions, withheld with the first reason in gate order).

    ``assertions``: (id, context, bucket); ``structural``: (id); ``states``: (id, state); ``published``: (context);
    ``open_buckets``: (bucket) with a disagreement; ``conflicts``: (bucket) with an accepted disposition.
    """
    def mark(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    j = (
        assertions.join(mark(structural, "id", "_bad"), "id", "left").join(states.select("id", "state"), "id", "left")
        .join(mark(published, "context", "_pub"), "context", "left")
        .join(mark(open_buckets.join(conflicts.select("bucket"), "bucket", "left_anti"), "bucket", "_open"), "bucket", "left")
    )
    reason = (
        F.when(F.col("_bad"), "structural problem")
        .when(F.coalesce("state", F.lit("pending")) != "accepted", F.concat(F.lit("review state "), F.coalesce("state", F.lit("pending"))))
        .when(F.col("context").isNotNull() & F.col("_pub").isNull(), "context is not published")
        .when(F.col("_open"), "open disagreement without disposition")
    )
    judged = j.select("id", reason.alias("reason"))
    return judged.filter("reason is null").select("id"), judged.filter("reason is not null")


def opportunity_problems(opportunities: DataFrame, assets: DataFrame, contexts: DataFrame, basis: DataFrame,
                         published: DataFrame) -> DataFrame:
    """(id, problem) rows. ``opportunities``: (id, asset, context, readiness, permission); ``basis``: (id, assertion)."""
    o = opportunities
    no_asset = o.join(assets.select("asset"), "asset", "left_anti").select("id", F.lit("asset does not resolve").alias("problem"))
    no_context = o.join(contexts.select("context"), "context", "left_anti").select("id", F.lit("starting context is not published").alias("problem"))
    cited = basis.join(o.select("id"), "id", "left_semi")
    lost = cited.join(published.select("assertion"), "assertion", "left_anti").select(
        "id", F.concat(F.lit("basis is not published: "), F.col("assertion").cast("string")).alias("problem"))
    none = o.join(basis.select("id"), "id", "left_anti").select("id", F.lit("no basis assertions").alias("problem"))
    unconfirmed = o.filter("readiness = 'reuse_confirmed' and permission <> 'explicit'").select(
        "id", F.lit("reuse needs explicit permission").alias("problem"))
    return report([no_asset, no_context, lost, none, unconfirmed])


def gap_problems(gaps: DataFrame, cited: DataFrame, coverage: DataFrame) -> DataFrame:
    """(gap, problem): absence may be claimed only when every cited search was complete.

    ``gaps``: (gap, kind); ``cited``: (gap, coverage_id); ``coverage``: (coverage_id, completion).
    """
    j = cited.join(coverage, "coverage_id", "left")
    per = j.groupBy("gap").agg(
        F.count_if(F.col("completion").isNull()).alias("unknown"),
        F.count_if(F.col("completion") != "complete_for_query").alias("incomplete"))
    g = gaps.join(per, "gap", "left")
    problem = F.when(F.col("unknown") > 0, "cites unknown coverage").when(
        (F.col("kind") == "not_found_in_search") & (F.col("incomplete").isNull() | (F.col("incomplete") > 0)),
        "incomplete or missing coverage cannot support absence")
    return g.select("gap", problem.alias("problem")).filter("problem is not null")


def fresh_explanations(stored: DataFrame, current: DataFrame, published: DataFrame) -> DataFrame:
    """(explanation, keep, reason): every stored dependency hash is current and every dependency is published.

    ``stored``: (explanation, dependency, hash); ``current``: (dependency, hash); ``published``: (dependency).
    """
    now = current.select("dependency", F.col("hash").alias("now"))
    pub = published.select("dependency").distinct().withColumn("_pub", F.lit(True))
    j = stored.join(now, "dependency", "left").join(pub, "dependency", "left")
    per = j.groupBy("explanation").agg(
        F.bool_and(F.col("hash").eqNullSafe(F.col("now"))).alias("same"), F.bool_and(F.coalesce("_pub", F.lit(False))).alias("out"))
    reason = F.when(~F.col("same"), "dependency hashes changed").when(~F.col("out"), "cites unpublished records")
    return per.select("explanation", reason.isNull().alias("keep"), reason.alias("reason"))


def outdated_reviews(latest: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_type, target_id, problem) for accepted latest reviews whose target changed (stale) or vanished (orphaned)."""
    j = latest.filter("decision = 'accepted'").join(
        targets.select("target_type", "target_id", "current_hash"), ["target_type", "target_id"], "left")
    problem = F.when(F.col("current_hash").isNull(), "orphaned").when(F.col("current_hash") != F.col("target_hash"), "stale")
    return j.select("target_type", "target_id", problem.alias("problem")).filter("problem is not null")


def judged_decisions(rows: DataFrame, targets: DataFrame, structural: DataFrame, checks: DataFrame,
                     target_types: tuple[str, ...]) -> DataFrame:
    """Decision rows with ``reason_rejected``: the first rule a row breaks, null when it is imported.

    ``rows``: (line, target_type, target_id, target_hash, reviewer, decision, disagreement).
    """
    bad = structural.select("target_id").distinct().withColumn("_bad", F.lit(True))
    failed = checks.filter("not passed").select("target_id").distinct().withColumn("_failed", F.lit(True))
    j = rows.join(targets, ["target_type", "target_id"], "left").join(bad, "target_id", "left").join(failed, "target_id", "left")
    accepts = F.col("decision") == "accepted"
    return j.withColumn(
        "reason_rejected",
        F.when(F.coalesce("reviewer", F.lit("")) == "", "no human decision recorded")
        .when(F.coalesce("decision", F.lit("")) == "", "no human decision recorded")
        .when(~F.col("target_type").isin(*target_types), "unsupported target type")
        .when(F.col("current_hash").isNull(), "target does not exist")
        .when(~F.col("target_hash").eqNullSafe(F.col("current_hash")), "stale")
        .when(accepts & F.col("_bad"), "structural failures cannot be overridden")
        .when(accepts & F.col("_failed") & F.col("disagreement").isNull(), "failed check needs a reason"),
    ).drop("_bad", "_failed")


def all_pass(*verdicts: Column) -> Column:
    return F.forall(F.array(*verdicts), lambda v: F.coalesce(v == "pass", F.lit(False)))


def exactly_one(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, completion, failure_reason): one row is complete, any other number is partial and says so."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    reason = F.when(F.col("n") != 1, F.format_string("expected exactly one, found %d", "n"))
    return n.select(key, "n", F.when(F.col("n") == 1, "complete_for_query").otherwise("partial").alias("completion"),
                    reason.alias("failure_reason"))


def coverage_class(total: Column, limit: Column, missing: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(total > limit, "capped").when(missing > 0, "partial").otherwise("complete_for_query")


def coverage_rule(completion: Column, reason: Column) -> Column:
    """A reason is required exactly when a search was not complete."""
    return (completion == "complete_for_query") == reason.isNull()


PROTOCOL_STATUSES = ("planned", "listed_record")  # what a protocol document may support


def assertion_problems(
    assertions: DataFrame, contexts: DataFrame, variants: DataFrame, entities: DataFrame, terms: DataFrame,
    support_refs: DataFrame, supports: DataFrame, evidence: DataFrame, sources: DataFrame,
) -> DataFrame:
    """(id, problem), each once: what is structurally wrong with an assertion and with everything it names.

    ``assertions``: (id, predicate, subject_id, object_id, context_id, statement_status), one row per id; ``contexts``: (id,
    disease_id); ``variants``: (id, variant_id), the typed scope of an assertion; ``entities``: (id, type); ``terms``: (id,
    current, phenotypic); ``support_refs``: (id, support_id) as listed by assertions; ``supports``: (id, assertion_id,
    evidence_id, stance), rows of one id under one assertion; ``evidence``: (id, source_document_id); ``sources``: (id,
    document_role). Equal rows count once. Each rule is a join by key on the rows that it concerns; no rule gathers an
    assertion's records. Supports meet the references under their own assertion, so that a support that very many
    assertions name in vain is no hot key, and what is said of an assertion stays where its records lie.
    """
    def said(df: DataFrame, problem: Column, *key: str) -> DataFrame:
        """The problem names the key or belongs to the assertion alone, so rows that differ in it are different problems."""
        rows = df.select("id", *key, problem.alias("problem")).filter("problem IS NOT NULL")
        return rows.distinct().select("id", "problem")

    phenotype = F.col("predicate") == "has_phenotype"
    scoped = assertions.filter("context_id IS NOT NULL").join(contexts.select(F.col("id").alias("context_id"), "disease_id", F.lit(True).alias("known")), "context_id", "left")
    context = F.when(F.col("known").isNull(), F.concat(F.lit("context "), "context_id", F.lit(" does not exist"))).when(
        phenotype & ~F.col("disease_id").eqNullSafe(F.col("subject_id")), "the subject of a scoped phenotype is not the context's disease")
    typed = variants.join(entities.select(F.col("id").alias("variant_id"), "type"), "variant_id", "left")
    variant = F.when(~F.col("type").eqNullSafe(F.lit("variant")), F.concat(F.lit("scope variant "), "variant_id", F.lit(" is no variant entity")))
    named = assertions.filter(phenotype).join(terms.select(F.col("id").alias("object_id"), "current", "phenotypic"), "object_id", "left")
    term = F.when(~F.coalesce("current", F.lit(False)), F.concat("object_id", F.lit(" is no current term"))).when(~F.col("phenotypic"), F.concat("object_id", F.lit(" is no phenotype term")))

    # One exchange of evidence by source and one by its id, where copies go; only what a rule can still say travels on.
    placed = evidence.join(sources.select(F.col("id").alias("source_document_id"), "document_role", F.lit(True).alias("captured")), "source_document_id", "left")
    role = F.col("document_role") == "protocol"
    placed = placed.select(
        F.col("id").alias("evidence_id"), F.lit(True).alias("found"), "captured", F.coalesce(role, F.lit(False)).alias("protocol"),
        F.when(role, F.col("source_document_id")).alias("source"))
    placed = placed.repartition("evidence_id").distinct()
    cited = supports.select(F.col("assertion_id").alias("id"), F.col("id").alias("support_id"), "evidence_id", "stance").filter("id IS NOT NULL")
    helps = F.coalesce(F.col("stance") == "supports", F.lit(False))
    checked = cited.join(placed, "evidence_id", "left").select(
        "id", "support_id", F.lit(False).alias("listed"), F.col("found").isNull().alias("lost"), F.coalesce(F.col("captured") & helps, F.lit(False)).alias("backs"),
        F.when(F.col("found") & F.col("captured").isNull(), F.col("evidence_id")).alias("unseen"), F.when(helps & F.col("protocol"), F.col("source")).alias("source"))
    listed = support_refs.select(
        "id", "support_id", F.lit(True).alias("listed"), F.lit(False).alias("lost"), F.lit(False).alias("backs"), F.lit(None).cast("string").alias("unseen"),
        F.lit(None).cast("string").alias("source"))
    records = listed.unionByName(checked).repartition("id").groupBy(*listed.columns).agg(F.count("*").alias("copies")).drop("copies")
    same, own = Window.partitionBy("id", "support_id"), Window.partitionBy("id")
    records = records.select("*", F.max("listed").over(same).alias("wanted"), (~F.min("listed").over(same)).alias("known"))
    records = records.select("*", F.max("listed").over(own).alias("any"), F.max(F.col("wanted") & F.col("backs")).over(own).alias("backed"))
    records = records.withColumn("place", F.row_number().over(own.orderBy("support_id")))
    held = assertions.select("id", "statement_status").join(records, "id", "left")
    support = F.when(F.col("listed") & ~F.col("known"), F.concat(F.lit("support "), "support_id", F.lit(" is missing or belongs to another assertion"))).when(
        F.col("listed") | ~F.col("wanted"), F.lit(None)).when(
        F.col("lost"), F.concat(F.lit("support "), "support_id", F.lit(" cites missing evidence"))).when(
        F.col("unseen").isNotNull(), F.concat(F.lit("evidence "), "unseen", F.lit(" cites a source that is not captured"))).when(
        F.col("source").isNotNull() & ~F.col("statement_status").isin(*PROTOCOL_STATUSES),
        F.concat("source", F.lit(" is a protocol and cannot support a "), "statement_status", F.lit(" claim")))
    none = F.when(F.coalesce("place", F.lit(1)) == 1, F.when(~F.coalesce("any", F.lit(False)), "assertion has no support records").when(
        ~F.col("backed"), "assertion has no supporting evidence"))
    found = held.select("id", F.explode(F.array_compact(F.array(support, none))).alias("problem")).distinct()
    return report([said(scoped, context, "context_id"), said(typed, variant, "variant_id"), said(named, term, "object_id"), found])
