"""Join-shaped operators. Every join is an equi-join; size estimates and adaptive execution choose the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.text import normalize_key
from claimweave.functions.vocab import IDENTITY_ALIAS_TYPES, OVERLAPS


def resolve_ids(ids: DataFrame, terms: DataFrame, alternates: DataFrame) -> DataFrame:
    """(id, resolved): the primary id, through an alternate id or one current replacement, else null.

    ``terms``: (term, is_obsolete, replaced_by array); ``alternates``: (alt_id, term).
    """
    wanted = ids.select("id").distinct()
    primary = (
        wanted.join(terms.select(F.col("term").alias("id"), F.lit(True).alias("known")), "id", "left")
        .join(alternates.select(F.col("alt_id").alias("id"), F.col("term").alias("via")), "id", "left")
        .select("id", F.when(F.col("known"), F.col("id")).otherwise(F.col("via")).alias("term"))
    )
    state = primary.join(terms, "term", "left")
    current = terms.filter(~F.col("is_obsolete")).select(F.col("term").alias("next"), F.lit(True).alias("next_ok"))
    only = F.when(F.col("is_obsolete") & (F.size("replaced_by") == 1), F.get("replaced_by", F.lit(0)))
    return state.withColumn("next", only).join(current, "next", "left").select(
        "id", F.when(F.col("is_obsolete") == F.lit(False), F.col("term"))
        .when(F.col("next_ok"), F.col("next")).alias("resolved"))


def mapped_annotations(annotations: DataFrame, mappings: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotation rows carried to entities by exact mappings, and coverage rows for terms that do not resolve.

    ``annotations``: (database_id, term, aspect, ...); ``mappings``: (entity, database_id); ``resolved``: (id, resolved).
    """
    rows = annotations.filter("aspect = 'P'").join(mappings, "database_id")
    rows = rows.join(resolved.withColumnRenamed("id", "term"), "term", "left")
    ok = rows.filter("resolved is not null")
    gone = rows.filter("resolved is null").select(
        "entity", "database_id", "term", F.lit("partial").alias("completion"),
        F.format_string("%s has no unambiguous current term", "term").alias("failure_reason"))
    return ok, gone


def alias_index(aliases: DataFrame) -> DataFrame:
    """Per normalized key: how many entities claim it, and by which kind of alias.

    ``aliases``: (entity, type, alias, alias_type). A key shared by very many entities stays a row of counts.
    """
    rows = aliases.withColumn("key", normalize_key(F.col("alias"))).withColumn(
        "identity", F.col("alias_type").isin(*IDENTITY_ALIAS_TYPES))
    per_entity = rows.groupBy("key", "entity").agg(
        F.bool_or("identity").alias("identity"), F.min(F.when(F.col("identity"), F.col("alias"))).alias("alias"))
    return per_entity.groupBy("key").agg(
        F.count("*").alias("claimants"), F.count_if("identity").alias("owners"),
        F.min(F.when(F.col("identity"), F.col("entity"))).alias("owner"),
        F.min(F.when(F.col("identity"), F.col("alias"))).alias("owner_alias"),
    )


def alias_lookup(mentions: DataFrame, identifiers: DataFrame, index: DataFrame) -> DataFrame:
    """(mention, resolved_id, candidates, ambiguous, via): an ambiguous mention is never resolved.

    ``identifiers``: (id, primary). Identifiers match exactly, aliases by normalized key.
    """
    wanted = mentions.select("mention").distinct().withColumn("stripped", F.trim("mention"))
    wanted = wanted.withColumn("key", normalize_key(F.col("stripped")))
    j = wanted.join(identifiers.select(F.col("id").alias("stripped"), "primary"), "stripped", "left").join(
        index, "key", "left")
    by_id = F.col("primary").isNotNull()
    one = F.col("owners") == 1
    alone = one & (F.col("claimants") == 1)
    some = F.coalesce("claimants", F.lit(0)) > 0
    return j.select(
        "mention",
        F.when(by_id, F.col("primary")).when(alone, F.col("owner")).alias("resolved_id"),
        F.when(by_id, F.lit(1)).when(alone, F.lit(1)).when(F.col("owners") > 1, F.col("owners"))
        .when(some, F.col("claimants")).otherwise(F.lit(0)).cast("bigint").alias("candidates"),
        F.when(by_id, F.lit(False)).when(F.coalesce("owners", F.lit(0)) > 0, ~alone)
        .otherwise(F.coalesce("claimants", F.lit(0)) > 1).alias("ambiguous"),
        F.when(by_id, "identifier").when(F.col("owners") > 0, "identity_alias").when(some, "candidate_alias")
        .otherwise("none").alias("via"),
    )


def alias_candidates(mentions: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, candidate, entity_type, matched_alias): the entities behind the number that ``alias_lookup`` gives.

    An identifier has its entity alone. Entities that own the alias as an identity hide the others when there are several
    of them, or when one owner is the only claimant; otherwise every claimant is a candidate.
    """
    wanted = mentions.select("mention").distinct().withColumn("stripped", F.trim("mention"))
    by_id = wanted.join(identifiers.select(F.col("id").alias("stripped"), "primary"), "stripped")
    exact = by_id.select("mention", F.col("primary").alias("candidate"), F.substring_index("primary", ":", 1).alias("entity_type"), F.col("stripped").alias("matched_alias"))
    rows = aliases.withColumn("key", normalize_key(F.col("alias"))).withColumn("identity", F.col("alias_type").isin(*IDENTITY_ALIAS_TYPES))
    claims = rows.groupBy("key", "entity", "type").agg(F.bool_or("identity").alias("identity"), F.min("alias").alias("matched_alias"))
    owners = claims.groupBy("key").agg(F.count_if("identity").alias("owners"))
    eligible = claims.join(owners, "key").filter((F.col("owners") <= 1) | F.col("identity"))
    named = wanted.join(by_id.select("mention"), "mention", "left_anti").withColumn("key", normalize_key(F.col("stripped")))
    return exact.unionByName(named.join(eligible, "key").select("mention", F.col("entity").alias("candidate"), F.col("type").alias("entity_type"), "matched_alias"))


def link_state(
    unplaced: Column, quotes: Column, missing_variants: Column, subject: Column, subject_ambiguous: Column,
    obj: Column, object_ambiguous: Column, contract_problems: Column,
) -> Column:
    """Resolution state of a candidate claim, in order of precedence."""
    first_bad = F.when(subject.isNull(), subject_ambiguous).when(obj.isNull(), object_ambiguous)
    return (
        F.when((unplaced > 0) | (quotes == 0), "invalid").when(missing_variants > 0, "unlinked")
        .when(first_bad.isNotNull(), F.when(first_bad, "ambiguous").otherwise("unlinked"))
        .when(contract_problems > 0, "invalid").otherwise("linked")
    )


def with_labels(rows: DataFrame, id_col: str, *sources: DataFrame) -> DataFrame:
    """``label`` from the first source (id, label) that has one, else the id."""
    out, found = rows, []
    for i, s in enumerate(sources):
        out = out.join(s.select(F.col("id").alias(id_col), F.col("label").alias(f"_l{i}")), id_col, "left")
        found.append(F.col(f"_l{i}"))
    return out.withColumn("label", F.coalesce(*found, F.col(id_col).cast("string"))).drop(*[f"_l{i}" for i in range(len(sources))])


def containing_section(spans: DataFrame, sections: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """Each span (key, span_id, start, stop) with the first section (key, pos, label, s_start, s_stop) that holds it.

    Both sides are cut into buckets of positions, so a text with very many spans and sections joins bucket by bucket;
    a section is repeated in the buckets it covers and a span is looked up in the bucket of its start.
    """
    cut = sections.select(
        key, "pos", "label", "s_start", "s_stop",
        F.explode(F.sequence(F.floor(F.col("s_start") / bucket), F.floor(F.col("s_stop") / bucket))).alias("_b"))
    j = spans.withColumn("_b", F.floor(F.col("start") / bucket)).join(cut, [key, "_b"]).filter(
        "s_start <= start and stop <= s_stop")
    first = j.groupBy(key, "span_id").agg(F.min_by(F.struct("label", "s_start", "s_stop"), F.col("pos")).alias("s"))
    return spans.join(first, [key, "span_id"], "left").select(
        key, "span_id", "start", "stop", F.col("s.label").alias("label"), F.col("s.s_start").alias("s_start"),
        F.col("s.s_stop").alias("s_stop"))


def keep_referenced(assertions: DataFrame, supports: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supports of kept assertions, and the evidence those supports cite."""
    s = supports.join(assertions.select("assertion"), "assertion", "left_semi")
    return s, evidence.join(s.select("evidence"), "evidence", "left_semi")


def missing(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two (id, hash) tables: changed, removed or appended."""
    j = before.select("id", F.col("hash").alias("old")).join(after.select("id", F.col("hash").alias("new")), "id", "full")
    change = (
        F.when(F.col("old").isNull(), "appended").when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return j.select("id", change.alias("change")).filter("change is not null")


def affected(assertions: DataFrame, members: DataFrame, mappings: DataFrame, diff: DataFrame) -> DataFrame:
    """Assertions with a dependency (``dependencies``) that changed or vanished; appended rows affect nobody.

    What changed is followed back to entities and contexts first, by the small tables, so that an assertion travels once
    for each of its ends and its context, not for everything that these bring along.
    """
    gone = diff.filter("change <> 'appended'").select("id").distinct()
    entities = gone.unionByName(mappings.join(gone.select(F.col("id").alias("mapping")), "mapping", "left_semi").select(F.col("entity").alias("id")))
    held = members.join(entities.select(F.col("id").alias("member")), "member", "left_semi").select(F.col("context").alias("id"))
    ends = assertions.select("assertion", F.explode(F.array_compact(F.array("subject", "object"))).alias("id"))
    contexts = assertions.filter("context is not null").select("assertion", F.col("context").alias("id"))
    hit = ends.join(entities, "id", "left_semi").unionByName(contexts.join(gone.unionByName(held), "id", "left_semi"))
    return hit.select("assertion").distinct()


def dependencies(assertions: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """(assertion, depends_on): both ends, the context, its members, and mappings of any of these entities.

    ``assertions``: (assertion, subject, object, context); ``members``: (context, member); ``mappings``: (mapping, entity).
    """
    ends = assertions.select("assertion", F.explode(F.array_compact(F.array("subject", "object"))).alias("depends_on"))
    contexts = assertions.filter("context is not null").select("assertion", "context")
    via_context = contexts.select("assertion", F.col("context").alias("depends_on"))
    via_member = contexts.join(members, "context").select("assertion", F.col("member").alias("depends_on"))
    entities = ends.unionByName(via_member)
    via_mapping = entities.join(mappings.select(F.col("entity").alias("depends_on"), "mapping"), "depends_on").select(
        "assertion", F.col("mapping").alias("depends_on"))
    return entities.unionByName(via_context).unionByName(via_mapping).distinct()


def covered_sets(members: DataFrame, covers: DataFrame) -> DataFrame:
    """Sets (set_id, item) that lie inside one cover (cover_id, item): (set_id, cover_id).

    Rows are counted as they come: a cover holds a set if it holds each of its rows, repeats included.
    """
    rows = members.select("set_id", "item")
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("size"))
    hits = rows.join(covers.select("cover_id", "item").distinct(), "item").groupBy("set_id", "cover_id").agg(F.count("*").alias("hit"))
    return hits.join(sizes, "set_id").filter("hit = size").select("set_id", "cover_id")


def community_anchors(direct: DataFrame, project_links: DataFrame, project_anchors: DataFrame, excluded: DataFrame) -> DataFrame:
    """(entity, anchor, predicate, record): who is tied to an anchor, directly or through a project, first record each.

    ``direct``: (entity, anchor, predicate, record); ``project_links``: (entity, project, predicate, record);
    ``project_anchors``: (project, anchor); records are never null. Both sides of the project join are reduced first, and
    the first record is taken per predicate before predicates are compared: the minimum of a number needs no sort.
    """
    def firsts(df: DataFrame, *key: str) -> DataFrame:
        return df.groupBy(*key, "predicate").agg(F.min("record").alias("record"))

    anchors = project_anchors.select("project", "anchor").distinct()
    via = firsts(firsts(project_links, "entity", "project").join(anchors, "project"), "entity", "anchor")
    rows = firsts(direct, "entity", "anchor").withColumn("way", F.lit(0)).unionByName(via.withColumn("way", F.lit(1)))
    kept = rows.join(excluded.select("entity"), "entity", "left_anti")
    return kept.groupBy("entity", "anchor").agg(F.min(F.struct("way", "record", "predicate")).alias("r")).select("entity", "anchor", "r.predicate", "r.record")


def bridges(reach: DataFrame, kinds: DataFrame, cap: int) -> DataFrame:
    """Entities tied to at least two anchors, most anchors first, persons before others, then id; the first ``cap``.

    ``kinds``: (entity, is_person).
    """
    many = reach.groupBy("entity").agg(F.count("*").alias("anchors")).filter("anchors >= 2")
    return many.join(kinds, "entity").orderBy(F.desc("anchors"), F.desc("is_person"), "entity").limit(cap)


def community_overlap(context, members: DataFrame, contexts: DataFrame, genes: DataFrame, cap: int = OVERLAPS) -> DataFrame:
    """Other contexts that share community members with one context, but neither disease nor gene.

    ``members``: (context, member, is_person); ``contexts``: (context, disease); ``genes``: (context, gene). Work is
    linear: the members of one context are joined with all memberships.
    """
    me = F.col("context") == F.lit(context)
    mine = members.filter(me).select("member").distinct()
    my_disease = contexts.filter(me).select("disease")
    my_genes = genes.filter(me).select("gene")
    related = (
        contexts.join(my_disease, "disease", "left_semi").select("context")
        .unionByName(genes.join(my_genes, "gene", "left_semi").select("context")).distinct()
    )
    shared = (
        members.filter(~me).join(related, "context", "left_anti").select("context", "member", "is_person").distinct()
        .join(mine, "member", "left_semi").groupBy("context").agg(F.count("*").alias("shared"), F.count_if("is_person").alias("persons"))
    )
    return shared.orderBy(F.desc("persons"), "context").limit(cap)


def contexts_of(rules: list[DataFrame]) -> DataFrame:
    """(entity, context): every rule contributes pairs; duplicates collapse."""
    out = rules[0].select("entity", "context")
    for r in rules[1:]:
        out = out.unionByName(r.select("entity", "context"))
    return out.distinct()


def current_checks(checks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Checks whose candidate still has the checked content; the latest per assertion.

    ``checks``: (candidate, hash, check_no, verdict); ``candidates``: (candidate, assertion, hash).
    """
    live = checks.join(candidates, ["candidate", "hash"])
    return live.groupBy("assertion").agg(F.max_by(F.struct("candidate", "verdict", "check_no"), F.col("check_no")).alias("c")).select(
        "assertion", "c.candidate", "c.check_no", "c.verdict")


def promote(candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """Linked candidates with a person's assignment where there is one, defaults otherwise."""
    return candidates.filter("state = 'linked'").join(assignments, "candidate", "left").select(
        "candidate", "subject", "predicate", "object", F.col("context").alias("context"),
        F.coalesce("study_design", F.lit("not recorded")).alias("study_design"),
        F.coalesce("independence", F.lit("unknown")).alias("independence"), "patient_count")


def first_n(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows per key; each task cuts before the shuffle."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("pos") <= n)
