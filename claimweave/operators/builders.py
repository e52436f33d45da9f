"""From scanned rows to records: sources, evidence, assertions, supports, entities and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.identity import multiset_digest, multiset_hash, sha256, stable_id
from claimweave.functions.vocab import PUBLIC_METADATA, SYNONYM_ALIAS_TYPES
from claimweave.operators.filters import lookup, stated_effect


def source_rows(df: DataFrame, *, kind: str, ref: Column, title: Column, text: Column, canonicalizer: str, policy: Column) -> DataFrame:
    """Documents with identity from (reference, content hash, canonicalizer)."""
    digest = sha256(text)
    return df.select(
        "*", stable_id("source", external_ref=ref, canonical_sha256=digest, canonicalizer=F.lit(canonicalizer)).alias("id"),
        F.lit(kind).alias("source_kind"), ref.alias("external_ref"), title.alias("title"), digest.alias("canonical_sha256"),
        F.lit(canonicalizer).alias("canonicalizer_version"), policy.alias("public_text_policy"))


def fields(**values: Column) -> Column:
    """Original field values as an ordered (name, value) list; order is that of the arguments."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in values.items()])


def structured_evidence(df: DataFrame, *, source: Column, locator: Column, payload: Column, validity: Column | None = None) -> DataFrame:
    """Evidence rows that cite a record by locator, with the cited fields verbatim."""
    return df.select(
        "*", stable_id("evidence", source=source, kind=F.lit("structured_record"), locator=locator).alias("evidence"),
        locator.alias("record_locator"), payload.alias("record_payload"),
        (validity if validity is not None else F.lit(None).cast("string")).alias("source_native_validity"))


def text_evidence(located: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """One evidence row per document with placed quotes; its spans stay rows, its id covers them in any order.

    ``located``: (key, quote_id, start, stop, status); ``documents``: (key, source_status). The publication status falls
    back to the source's.
    """
    span = sha256(F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("quote_id").cast("string")))
    per = located.filter("start is not null").groupBy(key).agg(
        *multiset_hash(span), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"), F.max("status").alias("status"))
    return per.join(documents, key).select(
        key, F.concat(F.lit("evidence:"), F.substring(multiset_digest(), 1, 32)).alias("evidence"),
        F.col("rows").cast("bigint").alias("spans"), "first_start", "last_stop",
        F.coalesce("status", "source_status", F.lit("unknown")).alias("publication_status"))


def assertion_id(subject: Column, predicate: Column, obj: Column, status: Column, qualifiers: Column) -> Column:
    """Same claim, same id; the order of qualifiers does not matter."""
    return stable_id("assertion", subject=subject, predicate=predicate, object=obj, status=status,
                     qualifiers=F.array_join(F.array_sort(F.array_distinct(qualifiers)), "|"))


def assertions_and_supports(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims``: (subject, predicate, object, status, qualifiers, evidence, origin) to pending assertions and supports."""
    rows = claims.withColumn("assertion", assertion_id(
        F.col("subject"), F.col("predicate"), F.col("object"), F.col("status"), F.col("qualifiers")))
    supports = rows.select("assertion", "evidence").distinct().select(
        stable_id("support", assertion=F.col("assertion"), evidence=F.col("evidence"), stance=F.lit("supports")).alias("support"),
        "assertion", "evidence", F.lit("supports").alias("stance"), F.lit("pending").alias("review_state"))
    merged = rows.groupBy("assertion", "subject", "predicate", "object", "status").agg(
        F.min_by("origin", "evidence").alias("origin"), F.count_distinct("evidence").alias("supports"))
    return merged.withColumn("review_state", F.lit("pending")), supports


def disease_rows(selected: DataFrame, terms: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with typed aliases for selected ids, and all their typed mappings.

    ``terms``: (term, name, synonyms array<struct<text,scope>>); ``mappings``: (term, relation, target).
    """
    kept = terms.join(selected.select("term"), "term", "left_semi")
    aliases = F.concat(
        F.array(F.struct(F.col("name").alias("text"), F.lit("label").alias("alias_type"))),
        F.transform("synonyms", lambda s: F.struct(s["text"].alias("text"), lookup(SYNONYM_ALIAS_TYPES, s["scope"]).alias("alias_type"))))
    typed = mappings.filter("relation is not null").join(selected.select("term"), "term", "left_semi")
    exact = typed.filter("relation = 'exact'").groupBy("term").agg(F.count("*").alias("exact_ids"))
    entities = kept.select("term", F.lit("disease").alias("type"), F.col("name").alias("label"), aliases.alias("aliases")).join(
        exact, "term", "left").withColumn("exact_ids", F.coalesce("exact_ids", F.lit(0)))
    mapping_rows = typed.select(
        stable_id("mapping", source=F.col("term"), target=F.col("target"), relation=F.col("relation")).alias("id"),
        "term", "relation", "target", F.lit("pending").alias("review_state"))
    return entities, mapping_rows


def phenotype_rows(referenced: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms somebody refers to, with label, alternate ids and a replacement only when there is exactly one."""
    return terms.join(referenced.select("term").distinct(), "term", "left_semi").select(
        "term", F.coalesce("name", "term").alias("label"), F.size("alternates").alias("alternates"),
        F.when(F.size("replaced_by") == 1, F.get("replaced_by", F.lit(0))).alias("replaced_by"), "is_obsolete")


def typed_edges(rows: DataFrame, subjects: DataFrame, objects: DataFrame, predicate: str) -> DataFrame:
    """Edges for rows whose both ends are known: (subject_key, object_key, ...) resolved by two joins."""
    return rows.join(subjects, "subject_key").join(objects, "object_key").withColumn("predicate", F.lit(predicate))


def process_edges(rows: DataFrame, genes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gene-process edges and the process nodes they need; a node without a label shows its id.

    ``rows``: (symbol, process, qualifier, line); ``genes``: (symbol, gene); ``labels``: (process, label).
    """
    edges = rows.join(genes, "symbol").select(
        "gene", "process", "line", F.concat(F.lit("GO qualifier: "), "qualifier").alias("qualifier_text"),
        F.when(F.array_contains(F.split("qualifier", r"\|"), "NOT"), "negated").otherwise("listed_record").alias("status"))
    nodes = edges.select("process").distinct().join(labels, "process", "left").select(
        "process", F.coalesce("label", "process").alias("label"))
    return edges, nodes


def cross_reference_ids(mappings: DataFrame) -> DataFrame:
    """(external, internal): every exact match, the members behind ``cross_reference_index``."""
    return mappings.filter("relation = 'exact'").select("external", "internal").distinct()


def phenotype_alternates(referenced: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, alternate): the alternate ids of the terms that ``phenotype_rows`` lists."""
    kept = terms.join(referenced.select("term").distinct(), "term", "left_semi")
    return kept.select("term", F.explode("alternates").alias("alternate"))


def cross_reference_index(mappings: DataFrame) -> DataFrame:
    """(external, ids, internal): how many internal ids an external id has exactly, and the id when it is one."""
    return mappings.filter("relation = 'exact'").groupBy("external").agg(
        F.count_distinct("internal").alias("ids"), F.min("internal").alias("first")).select(
        "external", "ids", F.when(F.col("ids") == 1, F.col("first")).alias("internal"))


def association_records(associations: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, mechanism proposals, unmapped): an edge needs one internal id, a proposal also a stated, assessed effect."""
    j = associations.join(index, "external", "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    edges = j.filter("ids = 1")
    proposals = edges.withColumn("effect", stated_effect(F.col("association_type"))).filter(
        "effect is not null and association_status = 'Assessed'")
    unmapped = j.filter("ids <> 1").select("external", "ids").distinct()
    return edges, proposals, unmapped


def review_summary(expert: Column) -> Column:
    return F.when(expert, "Accepted after review by a qualified expert").otherwise(
        "Accepted after source-fidelity review; not expert validation")


def with_metadata_defaults(values: Column) -> Column:
    """Public keys always present, null when unknown; given values win."""
    names = F.array(*[F.lit(k) for k in PUBLIC_METADATA])
    defaults = F.map_from_arrays(names, F.transform(names, lambda _: F.lit(None).cast("string")))
    absent = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(values, k))
    return F.map_concat(absent, values)


def review_union(log: DataFrame, imports: DataFrame) -> DataFrame:
    """The review log with the reviews that imported rows carry. ``imports``: (reviews array)."""
    return log.unionByName(imports.select(F.inline("reviews")))
