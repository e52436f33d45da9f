"""Record-building and read-view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import builders, ranking, views
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query
from claimweave.plans.filters import EFFECT_SQL, association_type
from claimweave.plans.fingerprints import SNAPSHOT
from claimweave.plans.joins import LOCATED_SQL, located
from claimweave.plans.joins import baseline, BASELINE_SQL


@query("source_rows", "N-1", """
SELECT 'source:' || substr(sha256(to_json({canonical_sha256: sha256(text), canonicalizer: 'text-1', external_ref: 'DOC:' || doc_id})), 1, 32) AS id, 'DOC:' || doc_id AS external_ref,
  sha256(text) AS canonical_sha256, CASE WHEN doc_id % 3 = 0 THEN 'link_only' ELSE 'excerpt' END AS public_text_policy FROM documents""")
def source_rows(t: Tables) -> DataFrame:
    policy = F.when(F.col("doc_id") % 3 == 0, "link_only").otherwise("excerpt")
    out = builders.source_rows(t.documents, kind="literature", ref=F.concat(F.lit("DOC:"), "doc_id"), title=F.col("source"),
                               text=F.col("text"), canonicalizer="text-1", policy=policy)
    return out.select("id", "external_ref", "canonical_sha256", "public_text_policy")


@query("structured_evidence", "N-2", f"""
SELECT 'evidence:' || substr(sha256(to_json({{kind: 'structured_record', locator: {b.LINE_ID_SQL}, source: l_orderkey}})), 1, 32) AS evidence, {b.LINE_ID_SQL} AS record_locator,
  'part=' || l_partkey || ';flag=' || l_returnflag || ';status=' || l_linestatus AS payload FROM lineitem""")
def structured_evidence(t: Tables) -> DataFrame:
    payload = builders.fields(part=F.col("l_partkey"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"))
    out = builders.structured_evidence(t.lineitem, source=F.col("l_orderkey"), locator=b.line_id(), payload=payload)
    return out.select("evidence", "record_locator", F.array_join(
        F.transform("record_payload", lambda f: F.concat(f["name"], F.lit("="), f["value"])), ";").alias("payload"))


@query("text_evidence", "N-3", f"""WITH {LOCATED_SQL}
SELECT doc_id, count(*) AS spans, min(start) AS first_start, max(stop) AS last_stop, coalesce(max(CASE WHEN quote_id LIKE 's%' THEN NULL ELSE 'published' END), CASE WHEN doc_id % 2 = 0 THEN 'preprint' END, 'unknown') AS publication_status
FROM located WHERE start IS NOT NULL GROUP BY doc_id""")
def text_evidence(t: Tables) -> DataFrame:
    placed = located(t).withColumn("status", F.when(~F.col("quote_id").startswith("s"), "published"))
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "preprint").alias("source_status"))
    return builders.text_evidence(placed, docs, "doc_id").drop("evidence")


def claim_input(t: Tables) -> DataFrame:
    q = F.array(F.concat(F.lit("direction: "), "effect_direction"), F.lit("species: human"), F.lit("species: human"))
    return b.claims(t).select("subject", "predicate", "object", F.col("statement_status").alias("status"), q.alias("qualifiers"), "evidence", "origin")


ASSERTION_SQL = b.CLAIMS_SQL + """,
a AS (SELECT 'assertion:' || substr(sha256(to_json({object: object, predicate: predicate, qualifiers: 'direction: ' || effect_direction || '|species: human', status: statement_status, subject: subject})), 1, 32) AS assertion,
  subject, object, statement_status AS status, origin, evidence FROM claims)"""


@query("assertion_rows", "N-4", f"""WITH {ASSERTION_SQL}
SELECT assertion, subject, object, status, min_by(origin, evidence) AS origin, count(DISTINCT evidence) AS supports, 'pending' AS review_state FROM a GROUP BY 1, 2, 3, 4""")
def assertion_rows(t: Tables) -> DataFrame:
    return builders.assertions_and_supports(claim_input(t))[0].drop("predicate")


@query("support_rows", "N-4", f"""WITH {ASSERTION_SQL}
SELECT DISTINCT 'support:' || substr(sha256(to_json({{assertion: assertion, evidence: evidence, stance: 'supports'}})), 1, 32) AS support, assertion, evidence, 'supports' AS stance, 'pending' AS review_state FROM a""")
def support_rows(t: Tables) -> DataFrame:
    return builders.assertions_and_supports(claim_input(t))[1]


def disease_input(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    node = F.concat(F.lit("part:"), "p_partkey")
    terms = t.part.select(node.alias("term"), F.col("p_name").alias("name"), F.array(
        F.struct(F.col("p_brand").alias("text"), F.lit("EXACT").alias("scope")), F.struct(F.col("p_type").alias("text"), F.lit("BROAD").alias("scope"))).alias("synonyms"))
    maps = t.part.select(node.alias("term"), F.explode(F.array(
        F.struct(F.lit("exact").alias("relation"), F.concat(F.lit("OMIM:"), "p_size").alias("target")),
        F.struct(F.when(F.col("p_size") % 2 == 0, "broad").alias("relation"), F.concat(F.lit("ORPHA:"), "p_size").alias("target")))).alias("m")).select("term", "m.*")
    return t.part.filter("p_size <= 10").select(node.alias("term")), terms, maps


@query("disease_rows", "N-5", """
SELECT 'part:' || p_partkey AS term, 'disease' AS type, p_name AS label, p_name || '/label,' || p_brand || '/exact_synonym,' || p_type || '/broad_synonym' AS aliases, 1 AS exact_ids FROM part WHERE p_size <= 10""")
def disease_rows(t: Tables) -> DataFrame:
    e, _ = builders.disease_rows(*disease_input(t))
    return e.withColumn("aliases", F.array_join(F.transform("aliases", lambda a: F.concat(a["text"], F.lit("/"), a["alias_type"])), ","))


@query("disease_mappings", "N-5", """
WITH m AS (SELECT 'part:' || p_partkey AS term, 'exact' AS relation, 'OMIM:' || p_size AS target FROM part WHERE p_size <= 10 UNION ALL SELECT 'part:' || p_partkey, 'broad', 'ORPHA:' || p_size FROM part WHERE p_size <= 10 AND p_size % 2 = 0)
SELECT 'mapping:' || substr(sha256(to_json({relation: relation, source: term, target: target})), 1, 32) AS id, term, relation, target, 'pending' AS review_state FROM m""")
def disease_mappings(t: Tables) -> DataFrame:
    return builders.disease_rows(*disease_input(t))[1]


@query("phenotype_rows", "N-6", """
SELECT 'part:' || p_partkey AS term, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_name END, 'part:' || p_partkey) AS label, 1 + p_size % 2 AS alternates,
  CASE WHEN p_size > 40 AND p_size % 2 = 0 THEN 'part:' || (p_partkey + 1) END AS replaced_by, p_size > 40 AS is_obsolete
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def phenotype_rows(t: Tables) -> DataFrame:
    return builders.phenotype_rows(*phenotype_input(t))


@query("phenotype_alternates", "N-6", """
SELECT 'part:' || p_partkey AS term, unnest(CASE WHEN p_size % 2 = 1 THEN ['x', 'y'] ELSE ['x'] END) AS alternate FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def phenotype_alternates(t: Tables) -> DataFrame:
    return builders.phenotype_alternates(*phenotype_input(t))


def phenotype_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    node = F.concat(F.lit("part:"), "p_partkey")
    nxt = F.concat(F.lit("part:"), F.col("p_partkey") + 1)
    replaced = F.when(F.col("p_size") <= 40, F.array().cast("array<string>")).when(F.col("p_size") % 2 == 0, F.array(nxt)).otherwise(F.array(nxt, node))
    terms = t.part.select(node.alias("term"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("name"),
                          F.slice(F.array(F.lit("x"), F.lit("y")), 1, (1 + F.col("p_size") % 2).cast("int")).alias("alternates"), replaced.alias("replaced_by"), (F.col("p_size") > 40).alias("is_obsolete"))
    used = t.lineitem.filter("l_quantity >= 48").select(F.concat(F.lit("part:"), "l_partkey").alias("term"))
    return used, terms


@query("submission_edges", "N-7", f"""
SELECT {b.LINE_ID_SQL} AS row, 'gene:' || s_suppkey AS gene, 'part:' || p_partkey AS disease, 'gene_associated_with_disease' AS predicate, p_type AS native_validity,
  array_to_string(list_sort(['Mode of inheritance: ' || l_returnflag, 'Submitter: ' || s_name]), '; ') AS qualifiers
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_acctbal >= 0 AND p_size <= 10""")
def submission_edges(t: Tables) -> DataFrame:
    rows = t.lineitem.select(b.line_id().alias("row"), F.col("l_suppkey").alias("subject_key"), F.col("l_partkey").alias("object_key"), "l_returnflag")
    genes = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("subject_key"), F.concat(F.lit("gene:"), "s_suppkey").alias("gene"), "s_name")
    diseases = t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("object_key"), F.concat(F.lit("part:"), "p_partkey").alias("disease"), F.col("p_type").alias("native_validity"))
    out = builders.typed_edges(rows, genes, diseases, "gene_associated_with_disease")
    quals = F.array_sort(F.array(F.concat(F.lit("Submitter: "), "s_name"), F.concat(F.lit("Mode of inheritance: "), "l_returnflag")))
    return out.select("row", "gene", "disease", "predicate", "native_validity", F.array_join(quals, "; ").alias("qualifiers"))


PROCESS_SQL = f"""ed AS (SELECT 'gene:' || s_suppkey AS gene, 'GO:' || l_partkey AS process, {b.LINE_ID_SQL} AS line, 'GO qualifier: ' || CASE WHEN l_returnflag = 'R' THEN 'NOT|involved_in' ELSE 'involved_in' END AS qualifier_text,
  CASE WHEN l_returnflag = 'R' THEN 'negated' ELSE 'listed_record' END AS status FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F' AND s_acctbal >= 0)"""


def process_input(t: Tables):
    rows = t.lineitem.filter("l_linestatus = 'F'").select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.concat(F.lit("GO:"), "l_partkey").alias("process"),
        F.when(F.col("l_returnflag") == "R", "NOT|involved_in").otherwise("involved_in").alias("qualifier"), b.line_id().alias("line"))
    genes = t.supplier.filter("s_acctbal >= 0").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.concat(F.lit("gene:"), "s_suppkey").alias("gene"))
    labels = t.part.filter("p_size <= 30").select(F.concat(F.lit("GO:"), "p_partkey").alias("process"), F.col("p_name").alias("label"))
    return builders.process_edges(rows, genes, labels)


@query("process_edges", "N-8", f"WITH {PROCESS_SQL} SELECT gene, process, line, qualifier_text, status FROM ed")
def process_edges(t: Tables) -> DataFrame:
    return process_input(t)[0]


@query("process_nodes", "N-8", f"""WITH {PROCESS_SQL} SELECT DISTINCT process, coalesce(CASE WHEN p_size <= 30 THEN p_name END, process) AS label FROM ed LEFT JOIN part ON process = 'GO:' || p_partkey""")
def process_nodes(t: Tables) -> DataFrame:
    return process_input(t)[1]


INDEX_SQL = "idx AS (SELECT p_name || '/' || p_brand AS external, count(DISTINCT p_partkey) AS ids, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS internal FROM part WHERE p_type <> 'SMALL' GROUP BY 1)"


def xref_mappings(t: Tables) -> DataFrame:
    return t.part.select(F.when(F.col("p_type") != "SMALL", "exact").otherwise("broad").alias("relation"),
                         F.concat_ws("/", "p_name", "p_brand").alias("external"), F.col("p_partkey").alias("internal"))


def xref_index(t: Tables) -> DataFrame:
    return builders.cross_reference_index(xref_mappings(t))


@query("cross_reference_ids", "N-9", "SELECT DISTINCT p_name || '/' || p_brand AS external, p_partkey AS internal FROM part WHERE p_type <> 'SMALL'")
def cross_reference_ids(t: Tables) -> DataFrame:
    return builders.cross_reference_ids(xref_mappings(t))


@query("cross_reference_index", "N-9", f"WITH {INDEX_SQL} SELECT external, ids, internal FROM idx")
def cross_reference_index(t: Tables) -> DataFrame:
    return xref_index(t)


ASSOC_SQL = INDEX_SQL + f""", a AS (SELECT 'part:' || p_partkey AS gene, p_name || '/' || p_brand AS external, {EFFECT_SQL} AS effect, p_size % 3 <> 0 AS assessed, coalesce(ids, 0) AS ids, internal FROM part LEFT JOIN idx ON external = p_name || '/' || p_brand)"""


def association_input(t: Tables):
    rows = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("gene"), F.concat_ws("/", "p_name", "p_brand").alias("external"),
                         association_type().alias("association_type"), F.when(F.col("p_size") % 3 != 0, "Assessed").otherwise("Not yet assessed").alias("association_status"))
    return builders.association_records(rows, xref_index(t))


@query("association_edges", "N-10", f"WITH {ASSOC_SQL} SELECT gene, internal FROM a WHERE ids = 1")
def association_edges(t: Tables) -> DataFrame:
    return association_input(t)[0].select("gene", "internal")


@query("mechanism_proposals", "N-10", f"WITH {ASSOC_SQL} SELECT gene, internal, effect FROM a WHERE ids = 1 AND effect IS NOT NULL AND assessed")
def mechanism_proposals(t: Tables) -> DataFrame:
    return association_input(t)[1].select("gene", "internal", "effect")


@query("unmapped_associations", "N-10", f"WITH {ASSOC_SQL} SELECT DISTINCT external, ids FROM a WHERE ids <> 1")
def unmapped_associations(t: Tables) -> DataFrame:
    return association_input(t)[2]


@query("public_review_summary", "N-11", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'Accepted after review by a qualified expert' ELSE 'Accepted after source-fidelity review; not expert validation' END AS description,
  sha256(text) AS reviewed_content_sha256 FROM labels JOIN documents USING (doc_id)""")
def public_review_summary(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", builders.review_summary(F.col("quality") == 1).alias("description"), F.sha2("text", 256).alias("reviewed_content_sha256"))


@query("metadata_defaults", "N-12", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 10 ELSE 9 END AS n_keys, json_extract_string(props, '$.k') AS k, NULL AS doi, CASE WHEN event_type = 'view' THEN 'medrxiv' END AS server FROM events""")
def metadata_defaults(t: Tables) -> DataFrame:
    given = F.from_json("props", "map<string,string>")
    given = F.when(F.col("event_type") == "view", F.map_concat(given, F.create_map(
        F.lit("server"), F.lit("medrxiv"), F.lit("extra"), F.lit("1")))).otherwise(given)
    m = t.events.select("event_id", builders.with_metadata_defaults(given).alias("m"))
    return m.select("event_id", F.size("m").alias("n_keys"), F.col("m")["k"].alias("k"), F.col("m")["doi"].alias("doi"), F.col("m")["server"].alias("server"))


@query("review_union", "N-15", f"""WITH {b.REVIEWS_SQL},
u AS (SELECT target_type, id FROM reviews UNION ALL SELECT 'context', 1000000 + c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'assertion', 2000000 + c_custkey FROM customer WHERE c_acctbal < 0)
SELECT target_type, count(*) AS n, max(id) AS last_id FROM u GROUP BY 1""")
def review_union(t: Tables) -> DataFrame:
    log = b.reviews(t).select("target_type", "id")
    item = lambda kind, base: F.struct(F.lit(kind).alias("target_type"), (F.col("c_custkey") + base).alias("id"))
    imports = t.customer.filter("c_acctbal < 0").select(F.array(item("context", 1000000), item("assertion", 2000000)).alias("reviews"))
    return builders.review_union(log, imports).groupBy("target_type").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("backbone_edges", "N-16", BASELINE_SQL + """
SELECT entity AS subject, 'has_phenotype' AS predicate, resolved AS object, CASE WHEN negated THEN 'negated' ELSE 'listed_record' END AS status, count(*) AS n, 'source_adapter' AS origin FROM j WHERE resolved IS NOT NULL GROUP BY 1, 3, 4
UNION ALL SELECT 'nation:' || n_nationkey, 'serves', 'region:' || n_regionkey, 'listed_record', 1, 'manual_import' FROM nation""")
def backbone_edges(t: Tables) -> DataFrame:
    ok, _ = baseline(t)
    status = F.when(F.col("negated"), "negated").otherwise("listed_record")
    edges = ok.groupBy(F.col("entity").alias("subject"), F.col("resolved").alias("object"), status.alias("status")).agg(F.count("*").alias("n"))
    edges = edges.withColumn("predicate", F.lit("has_phenotype")).withColumn("origin", F.lit("source_adapter"))
    manual = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("subject"), F.concat(F.lit("region:"), "n_regionkey").alias("object"),
                             F.lit("listed_record").alias("status"), F.lit(1).cast("bigint").alias("n"), F.lit("serves").alias("predicate"), F.lit("manual_import").alias("origin"))
    return ranking.append_all([edges, manual])


# ---- read views --------------------------------------------------------------------------------------------------

@query("assertion_detail", "F-18", """
WITH s AS (SELECT l_orderkey, count(*) AS supports, count(*) FILTER (l_returnflag = 'R') AS opposing, count(DISTINCT l_suppkey) AS sources, min(n_name) AS first_kind
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
c AS (SELECT l_orderkey, count(*) AS conflicts FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 GROUP BY 1)
SELECT o_orderkey AS assertion, o_orderstatus AS status, coalesce(supports, 0) AS supports, coalesce(opposing, 0) AS opposing, coalesce(sources, 0) AS sources, first_kind, coalesce(conflicts, 0) AS conflicts
FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey""")
def assertion_detail(t: Tables) -> DataFrame:
    assertions = t.orders.select(F.col("o_orderkey").alias("assertion"), F.col("o_orderstatus").alias("status"))
    return views.assertion_details(assertions, *assertion_branches(t))


@query("assertion_evidence", "F-18", f"""
SELECT l_orderkey AS assertion, {b.LINE_ID_SQL} AS evidence, CASE WHEN l_returnflag = 'R' THEN 'opposes' ELSE 'supports' END AS stance, l_suppkey AS source, n_name AS source_kind
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def assertion_evidence(t: Tables) -> DataFrame:
    return views.assertion_evidence(*assertion_branches(t)[:3])


@query("assertion_conflicts", "F-18", f"SELECT l_orderkey AS assertion, {b.LINE_ID_SQL} AS conflict FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48")
def assertion_conflicts(t: Tables) -> DataFrame:
    return assertion_branches(t)[3]


def assertion_branches(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    li = t.lineitem
    supports = li.select(F.col("l_orderkey").alias("assertion"), b.line_id().alias("evidence"), F.when(F.col("l_returnflag") == "R", "opposes").otherwise("supports").alias("stance"))
    evidence = li.select(b.line_id().alias("evidence"), F.col("l_suppkey").alias("source"))
    sources = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source"), F.col("n_name").alias("source_kind"))
    conflicts = li.filter("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_orderkey").alias("assertion"), b.line_id().alias("conflict"))
    return supports, evidence, sources, conflicts


@query("asset_view", "F-19", f"""
WITH own AS (SELECT l_partkey, max_by(l_suppkey, {b.LINE_ID_SQL}) AS owner, count(*) AS own FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
sc AS (SELECT l_partkey, count(*) AS scoped, bool_or(l_suppkey % 10 = 3) AS exact FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT p_partkey AS asset, owner, coalesce(own, 0) + coalesce(scoped, 0) AS statements, coalesce(exact, false) AS exact
FROM part LEFT JOIN own ON own.l_partkey = p_partkey LEFT JOIN sc ON sc.l_partkey = p_partkey""")
def asset_view(t: Tables) -> DataFrame:
    return views.asset_views(t.part.select(F.col("p_partkey").alias("asset")), *asset_branches(t))


@query("asset_statements", "F-19", f"""
SELECT l_partkey AS asset, CASE l_returnflag WHEN 'A' THEN 'owner' ELSE 'scope' END AS kind, {b.LINE_ID_SQL} AS record, l_suppkey AS other, l_returnflag = 'N' AND l_suppkey % 10 = 3 AS exact
FROM lineitem WHERE l_returnflag IN ('A', 'N') AND (l_returnflag = 'A' OR l_suppkey % 10 <> 3 OR l_suppkey IN (SELECT s_suppkey FROM supplier))""")
def asset_statements(t: Tables) -> DataFrame:
    return views.asset_statements(*asset_branches(t))


def asset_branches(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = t.lineitem
    owners = li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("owner"), b.line_id().alias("record"))
    scopes = li.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("target"), b.line_id().alias("record"))
    targets = t.supplier.filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("target"))
    return owners, scopes, targets


@query("context_view", "F-23", """
WITH w AS (SELECT o_custkey, count(*) AS written FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1), d AS (SELECT o_custkey, count(*) AS templates FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
p AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS direct_terms, count(*) FILTER (o_totalprice < 20000) AS unassessed FROM orders GROUP BY 1)
SELECT c_custkey AS context, coalesce(written, templates, 0) AS sentences, written IS NOT NULL AS reviewed, concat_ws('; ', 'grouping, not a diagnosis', CASE WHEN c_acctbal < 0 THEN 'mechanism unknown' END,
  CASE WHEN coalesce(direct_terms, 0) = 0 THEN 'no baseline' END, CASE WHEN unassessed > 0 THEN 'scores withheld' END) AS limitations
FROM customer LEFT JOIN w ON w.o_custkey = c_custkey LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey""")
def context_view(t: Tables) -> DataFrame:
    o = t.orders.withColumn("context", F.col("o_custkey"))
    contexts = t.customer.select(F.col("c_custkey").alias("context"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("mechanism"))
    profiles = o.groupBy("context").agg(F.count_distinct("o_orderpriority").alias("direct_terms"), F.count_if(F.col("o_totalprice") < 20000).alias("unassessed"))
    return views.context_views(
        contexts, o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("context", F.col("o_orderkey").alias("sentence")),
        o.filter("o_orderstatus = 'F'").select("context", F.col("o_orderkey").alias("assertion")), profiles)


def _side_sql(name: str, alias: str) -> str:
    return f"{alias}.direct_terms AS {name}_terms, {alias}.unassessed AS {name}_unassessed, {alias}.denied AS {name}_disagreements, {alias}.terms AS {name}_list"


@query("context_profiles", "F-23", f"""
WITH cl AS (SELECT o_custkey AS context, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'sub' END AS level, 'part:' || l_partkey AS term, bool_or(l_returnflag <> 'R') AS stated, bool_or(l_returnflag = 'R') AS denied,
  bool_or(coalesce(p_size <= 45, false)) AS assessed FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY context, level ORDER BY term) AS i FROM cl WHERE stated),
p AS (SELECT context, level, count(*) AS direct_terms, count(*) FILTER (NOT assessed) AS unassessed, count(*) FILTER (denied) AS denied, string_agg(term, ',' ORDER BY term) FILTER (i <= 25) AS terms FROM d GROUP BY 1, 2),
c AS (SELECT c_custkey AS context, CASE WHEN c_custkey % 3 = 0 THEN 'disease' ELSE 'subgroup' END AS profile_level, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS mechanism FROM customer)
SELECT c.context, profile_level, mechanism, {_side_sql("base", "x")}, {_side_sql("subgroup", "y")},
  concat_ws('; ', 'grouping, not a diagnosis', CASE WHEN mechanism IS NULL THEN 'mechanism unknown' END, CASE WHEN x.context IS NULL THEN 'no baseline' END,
    CASE WHEN x.unassessed > 0 THEN 'scores withheld: terms without reference support' END, CASE WHEN x.denied > 0 THEN 'scores withheld: open disagreements' END,
    CASE WHEN profile_level = 'subgroup' AND y.context IS NULL THEN 'subgroup profile is missing, not empty' END) AS limitations
FROM c LEFT JOIN p x ON x.context = c.context AND x.level = 'base' LEFT JOIN p y ON y.context = c.context AND y.level = 'sub' AND profile_level = 'subgroup'""")
def context_profiles(t: Tables) -> DataFrame:
    """Customers as contexts: finished lines speak about the disease, open ones about the subgroup."""
    sizes = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") <= 45).alias("assessed"))
    lines = t.orders.select("o_orderkey", F.col("o_custkey").alias("context")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(sizes, "l_partkey", "left")
    claims = lines.select("context", F.when(F.col("l_linestatus") == "F", "disease_baseline").otherwise("subgroup").alias("level"), F.concat(F.lit("part:"), "l_partkey").alias("term"),
                          (F.col("l_returnflag") == "R").alias("negated"), F.coalesce("assessed", F.lit(False)).alias("assessed"))
    contexts = t.customer.select(F.col("c_custkey").alias("context"), F.when(F.col("c_custkey") % 3 == 0, "disease").otherwise("subgroup").alias("profile_level"),
                                 F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("mechanism"))
    sides = [F.col(f"{p}_profile.{f}").alias(f"{n}_{g}") for p, n in (("disease", "base"), ("subgroup", "subgroup"))
             for f, g in (("direct_terms", "terms"), ("unassessed_terms", "unassessed"), ("open_disagreements", "disagreements"))]
    lists = [F.array_join(f"{p}_profile.terms", ",").alias(f"{n}_list") for p, n in (("disease", "base"), ("subgroup", "subgroup"))]
    return views.context_profiles(contexts, claims).select("context", "profile_level", "mechanism", *sides, *lists, F.array_join("limitations", "; ").alias("limitations"))


@query("context_sentences", "F-23", """
WITH w AS (SELECT o_custkey AS context, o_orderkey AS record FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT context, record, 'reviewed' AS origin FROM w UNION ALL SELECT o_custkey, o_orderkey, 'record' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT context FROM w)""")
def context_sentences(t: Tables) -> DataFrame:
    o = t.orders.withColumn("context", F.col("o_custkey"))
    return views.context_sentences(
        o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("context", F.col("o_orderkey").alias("sentence")),
        o.filter("o_orderstatus = 'F'").select("context", F.col("o_orderkey").alias("assertion")))


@query("snapshot_summary", "F-24", " UNION ALL ".join(
    ["SELECT 'snapshot' AS name, 'snap_current' AS value"] + [f"SELECT 'rows:{n}', CAST(count(*) AS VARCHAR) FROM {n}" for n in SNAPSHOT]
    + ["SELECT DISTINCT 'version:' || source, lang FROM documents"]))
def snapshot_summary(t: Tables) -> DataFrame:
    versions = t.documents.select(F.col("source").alias("name"), F.col("lang").alias("value"))
    return views.snapshot_summary("snap_current", {n: getattr(t, n) for n in SNAPSHOT}, versions)
