"""Fingerprints of all record kinds: what they depend on, and what a missing record takes with it."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from claimweave.operators import fingerprints
from tests.conftest import rows


@pytest.fixture(scope="module")
def catalog(spark):
    def table(columns, *data):
        return spark.createDataFrame(list(data), ", ".join(f"{c} string" for c in columns.split()))

    return fingerprints.Catalog(
        entities=table("id type label", ("g1", "gene", "G"), ("d1", "disease", "D"), ("h1", "phenotype", "H"), ("alone", "gene", "A")),
        mappings=table("id source_id target source_document_id review_state", ("m1", "d1", "OMIM:1", "s1", "pending"), ("m2", "d1", "OMIM:2", "gone", "pending")),
        sources=table("id title fetched_at", ("s1", "first", "today"), ("s2", "second", "today")),
        contexts=table("id level definition_review_state", ("c1", "disease", "pending"), ("c2", "disease", "pending")),
        evidence=table("id source_document_id", ("e1", "s1"), ("e2", "s2"), ("e3", "gone")),
        assertions=table("id subject_id object_id context_id", ("a1", "d1", "h1", None), ("a2", "d1", "h1", "c1"), ("a3", "d1", "h1", None), ("a4", "d1", "nowhere", None)),
        supports=table("id assertion_id evidence_id checker_result_id", ("p1", "a1", "e1", "x"), ("p2", "a1", "e2", "y"), ("p3", "a2", "e1", "z"), ("p4", "a3", "e3", "w"), ("p5", "a4", "e1", "v")),
        conflicts=table("id reason", ("k1", "r"), ("k2", "r")), opportunities=table("id asset_id context_id", ("o1", "g1", "c1"), ("o2", "g1", None), ("o3", "none", None)),
        explanations=table("id text", ("x1", "t")),
        context_entities=table("id child", ("c1", "d1"), ("c1", "g1"), ("c2", "unknown")), context_assertions=table("id child", ("c1", "a1")), context_evidence=table("id child", ("c1", "e2")),
        conflict_assertions=table("id child", ("k1", "a1"), ("k1", "a2"), ("k2", "a1"), ("k2", "a3")), conflict_evidence=table("id child", ("k1", "e1")),
        partner_entities=table("id child", ("o1", "d1")), basis_assertions=table("id child", ("o1", "a2"), ("o2", "a3")))


def hashes(c):
    return {r[:2]: r[2] for r in rows(fingerprints.catalog_fingerprints(c), "target_type", "target_id", "hash")}


def test_a_missing_record_leaves_all_above_it_without_a_hash(catalog):
    got = hashes(catalog)
    missing = {k for k, h in got.items() if h is None}
    assert missing == {
        ("mapping", "m2"), ("evidence", "e3"), ("support", "p4"), ("assertion", "a3"), ("conflict", "k2"), ("opportunity", "o2"),
        ("assertion", "a4"), ("support", "p5"), ("context", "c2"), ("opportunity", "o3"),
    }
    assert len({h for h in got.values() if h}) == len(got) - len(missing)


def test_a_change_reaches_exactly_what_depends_on_it(catalog):
    before = hashes(catalog)

    def changed(**tables):
        after = hashes(replace(catalog, **tables))
        return {k for k in before if before[k] != after[k]}

    renamed = catalog.sources.withColumn("title", F.when(F.col("id") == "s2", "other").otherwise(F.col("title")))
    assert changed(sources=renamed) == {("evidence", "e2"), ("support", "p2"), ("assertion", "a1"), ("context", "c1"), ("conflict", "k1")}
    relabelled = catalog.entities.withColumn("label", F.when(F.col("id") == "g1", "new").otherwise(F.col("label")))
    assert changed(entities=relabelled) == {("entity", "g1"), ("context", "c1"), ("assertion", "a2"), ("support", "p3"), ("conflict", "k1"), ("opportunity", "o1")}
    volatile = catalog.supports.withColumn("checker_result_id", F.lit("later"))
    assert changed(supports=volatile, sources=catalog.sources.withColumn("fetched_at", F.lit("tomorrow"))) == set()
    doubled = catalog.conflict_assertions.unionByName(catalog.conflict_assertions).orderBy(F.rand(3))
    assert changed(conflict_assertions=doubled) == set()


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_catalog_moves_each_line_a_bounded_number_of_bytes(spark):
    """Hashes travel as bytes, and a table is dealt once for its distinct and the join behind it."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    before = shuffled(spark)
    entry.queries()["catalog_fingerprints"](spark, folder).write.format("noop").mode("overwrite").save()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert (shuffled(spark) - before) / lines < 300


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kinds_are_stored_one_after_the_other(catalog):
    """No shuffle of a layer is left to the last job, where those of all layers would lie on the disk together."""
    assert "Exchange" not in plan_of(fingerprints.catalog_fingerprints(catalog))


def test_targets_of_the_queue_are_dealt_once(spark):
    import re

    import __spark_entry__ as entry

    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = plan_of(entry.queries()["review_queue_items"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(name, kept)
    assert re.search(r"hashpartitioning\(target_type#\d+, target_id#\d+", plan)
    assert not re.search(r"hashpartitioning\(target_id#\d+", plan)
