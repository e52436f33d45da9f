"""Manual imports of organizations, assets, studies and people, normalized to nodes and edges.

Remit, ownership, scope and affiliation each need evidence of their own; an edge exists once per piece of evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "array<struct<source_document_id: string, record_locator: string>>"
ORGANIZATION = f"id string, name string, official_url string, served_disease_ids array<string>, serves_evidence {EVIDENCE}"
ASSET = (f"id string, name string, kind string, owner_organization_id string, ownership_relation string, ownership_evidence {EVIDENCE}, "
         f"target_context_ids array<string>, scope_evidence {EVIDENCE}, population_scope string")
STUDY = f"id string, title string, design string, disease_ids array<string>, evidence {EVIDENCE}"
PERSON = (f"id string, name string, profile_url string, organization_id string, affiliation_evidence {EVIDENCE}, "
          f"work_entity_ids array<string>, work_evidence {EVIDENCE}")


def read_imports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    kinds = {"organizations": ORGANIZATION, "assets": ASSET, "studies": STUDY, "people": PERSON}
    return {k: spark.read.schema(ddl).json(f"{folder}/{k}") for k, ddl in kinds.items()}


def normalize_imports(imports: dict[str, DataFrame], contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, problems). ``contexts``: (context, target). An ownership without evidence is a problem, not an edge."""
    orgs, assets, studies, people = (imports[k] for k in ("organizations", "assets", "studies", "people"))

    def nodes(df: DataFrame, kind: str, label: str) -> DataFrame:
        return df.select("id", F.lit(kind).alias("type"), F.col(label).alias("label"))

    def fan(df: DataFrame, predicate: str, subject, objects, evidence: str, extra=None) -> DataFrame:
        rows = df.select(subject.alias("subject"), F.explode(objects).alias("object"), evidence,
                         (extra if extra is not None else F.lit(None).cast("string")).alias("note"))
        return rows.select("subject", F.lit(predicate).alias("predicate"), "object", F.explode(evidence).alias("e"), "note").select(
            "subject", "predicate", "object", F.concat_ws("#", "e.source_document_id", "e.record_locator").alias("evidence"), "note")

    no_support = assets.filter("owner_organization_id is not null and coalesce(size(ownership_evidence), 0) < 1").select(
        "id", F.lit("ownership needs its own source support").alias("problem"))
    half = assets.filter("(owner_organization_id is null) <> (ownership_relation is null)").select(
        "id", F.lit("owner and ownership relation are given together").alias("problem"))
    targets = assets.select("id", "scope_evidence", "population_scope", F.explode("target_context_ids").alias("context")).join(contexts, "context", "left")
    unknown = targets.filter("target is null").select("id", F.concat(F.lit("unknown context "), "context").alias("problem"))
    edges = (
        fan(orgs, "serves", F.col("id"), F.col("served_disease_ids"), "serves_evidence")
        .unionByName(fan(assets.filter("owner_organization_id is not null and ownership_relation is not null"), "owns_or_runs", F.col("owner_organization_id"), F.array("id"), "ownership_evidence", F.col("ownership_relation")))
        .unionByName(fan(targets.filter("target is not null"), "asset_for_context", F.col("id"), F.array("target"), "scope_evidence", F.col("population_scope")))
        .unionByName(fan(studies, "studies", F.col("id"), F.col("disease_ids"), "evidence"))
        .unionByName(fan(people.filter("organization_id is not null"), "professional_at", F.col("id"), F.array("organization_id"), "affiliation_evidence"))
        .unionByName(fan(people, "works_on", F.col("id"), F.col("work_entity_ids"), "work_evidence")))
    all_nodes = (nodes(orgs, "organization", "name").unionByName(nodes(assets, "asset", "name"))
                 .unionByName(nodes(studies, "study", "title")).unionByName(nodes(people, "person", "name")))
    return all_nodes, edges, no_support.unionByName(half).unionByName(unknown)
