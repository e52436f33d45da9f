"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text, web
from claimweave.functions.vocab import ID_PREFIXES, OBO_IRI
from claimweave.operators import filters, windows
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query


def spelled_ids(t: Tables) -> DataFrame:
    spelling = (
        F.when(F.col("p_size") % 5 == 0, "MIM:").when(F.col("p_size") % 5 == 1, "Orphanet:")
        .when(F.col("p_size") % 5 == 2, "decipher:").when(F.col("p_size") % 5 == 3, "Other:").otherwise("")
    )
    return t.part.select("p_partkey", F.concat(spelling, "p_partkey").alias("id"))


@query("namespace_normalization", "C-1", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'OMIM:' WHEN 1 THEN 'ORPHA:' WHEN 2 THEN 'DECIPHER:' WHEN 3 THEN 'Other:'
  ELSE '' END || p_partkey AS normalized FROM part""")
def namespace_normalization(t):
    return spelled_ids(t).select("p_partkey", web.namespace(F.col("id")).alias("normalized"))


@query("iri_to_curie", "C-2", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'HP:' || page_id ELSE url END AS curie FROM pages""")
def iri_to_curie(t):
    iri = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(OBO_IRI + "HP_"), "page_id")).otherwise(F.col("url"))
    return t.pages.select("page_id", web.curie(iri).alias("curie"))


@query("missing_sentinel_to_null", "C-3", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL ELSE o_orderpriority END AS value
FROM orders""")
def missing_sentinel_to_null(t):
    raw = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " N/A ").when(F.col("o_orderpriority") == "5-LOW", "null")
        .otherwise(F.col("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", text.missing_to_null(raw).alias("value"))


@query("positive_annotations", "C-4", "WITH " + b.ANN_SQL + """
SELECT entity, term, count(*) AS n FROM ann WHERE aspect = 'P' AND NOT negated
  AND (CASE WHEN entity % 3 = 0 THEN 'ORPHA:' ELSE 'OMIM:' END || entity) LIKE 'OMIM:%' GROUP BY 1, 2""")
def positive_annotations(t):
    rows = b.annotations(t).withColumn(
        "database_id", F.concat(F.when(F.col("entity") % 3 == 0, "ORPHA:").otherwise("OMIM:"), "entity")
    )
    return filters.positive_annotations(rows, "OMIM:").groupBy("entity", "term").agg(F.count("*").alias("n"))


@query("set_membership_selection", "C-5", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size <= 10)""")
def set_membership_selection(t):
    keys = t.part.filter("p_type = 'PROMO' and p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return filters.selected_by(t.lineitem, keys, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("negation_status", "C-6", """
SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'negated' ELSE 'listed_record' END AS status, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def negation_status(t):
    qualifier = (
        F.when(F.col("l_returnflag") == "R", "NOT|involved_in").when(F.col("l_returnflag") == "A", "NOTED|acts_in")
        .otherwise("involved_in")
    )
    rows = t.lineitem.select("l_suppkey", filters.negation_status(qualifier).alias("status"))
    return rows.groupBy("l_suppkey", "status").agg(F.count("*").alias("n"))


def classified(t: Tables) -> DataFrame:
    validity = (
        F.when(F.col("toxic") == 1, "Limited").when(F.col("quality") == 1, "Definitive")
        .when(F.col("doc_id") % 2 == 0, "Disputed Evidence").otherwise(F.lit(None))
    )
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        "doc_id", "source", validity.alias("validity")
    )


CLASSIFIED_SQL = """classified AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'Limited' WHEN quality = 1 THEN 'Definitive'
  WHEN doc_id % 2 = 0 THEN 'Disputed Evidence' END AS validity FROM labels JOIN documents USING (doc_id))"""


@query("non_positive_validity_rows", "C-7", "WITH " + CLASSIFIED_SQL + """
SELECT doc_id, source, validity FROM classified WHERE validity IS NULL OR validity NOT IN ('Limited', 'Disputed Evidence')""")
def non_positive_validity_rows(t):
    return classified(t).filter(~filters.non_positive(F.col("validity")))


@query("non_positive_validity_groups", "C-7", "WITH " + CLASSIFIED_SQL + """
SELECT doc_id % 50 AS grp, bool_or(coalesce(validity IN ('Limited', 'Disputed Evidence'), false)) AS excluded
FROM classified GROUP BY 1""")
def non_positive_validity_groups(t):
    rows = classified(t).withColumn("grp", F.col("doc_id") % 50)
    return filters.groups_with_non_positive(rows, "grp", "validity")


# Types are deliberately narrow so that the star schema breaks some rules.
KG_RULES = {
    "placed": (("customer",), ("order",), None, False),
    "contains": (("order",), ("asset",), "PROMO", False),
    "supplied_by": (("asset", "order"), ("nation",), None, True),
    "located_in": (("supplier",), ("nation",), None, True),
}


def contract_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    edges = b.kg_edges(t).withColumn(
        "effect_direction", F.when(F.length("id") % 2 == 0, "improves").otherwise("unknown")
    ).withColumn("outcome_text", F.when(F.length("subject") % 3 != 0, F.lit("outcome")))
    nodes = b.kg_nodes(t).filter("not (type = 'part' and kind = 'SMALL')").withColumn(
        "type", F.when(F.col("type") == "part", "asset").otherwise(F.col("type"))
    )
    return edges, nodes


CONTRACT_SQL = f"""WITH {b.KG_SQL}, {b.NODES_SQL},
n AS (SELECT id, CASE WHEN type = 'part' THEN 'asset' ELSE type END AS type, kind FROM nodes
  WHERE NOT (type = 'part' AND coalesce(kind, '') = 'SMALL')),
rules(predicate, st, ot, kind, dir) AS (VALUES ('placed', ['customer'], ['order'], NULL, false),
  ('contains', ['order'], ['asset'], 'PROMO', false), ('supplied_by', ['asset', 'order'], ['nation'], NULL, true),
  ('located_in', ['supplier'], ['nation'], NULL, true)),
j AS (SELECT kg.id, st, ot, s.type AS stype, o.type AS otype, o.kind AS okind, r.kind AS rkind,
    dir AND (length(kg.id) % 2 <> 0 OR length(kg.subject) % 3 = 0) AS undirected
  FROM kg LEFT JOIN rules r USING (predicate) LEFT JOIN n s ON s.id = kg.subject LEFT JOIN n o ON o.id = kg.object),
problems AS (SELECT id, 'unknown predicate' AS problem FROM j WHERE st IS NULL
  UNION ALL SELECT id, 'subject does not resolve' FROM j WHERE st IS NOT NULL AND stype IS NULL
  UNION ALL SELECT id, 'wrong subject type' FROM j WHERE NOT list_contains(st, stype)
  UNION ALL SELECT id, 'object does not resolve' FROM j WHERE st IS NOT NULL AND otype IS NULL
  UNION ALL SELECT id, 'wrong object type' FROM j WHERE NOT list_contains(ot, otype)
  UNION ALL SELECT id, 'wrong asset kind' FROM j WHERE list_contains(ot, otype) AND rkind IS NOT NULL AND otype = 'asset' AND okind IS DISTINCT FROM rkind
  UNION ALL SELECT id, 'direction and outcome required' FROM j WHERE undirected)"""


def kg_contract_problems(t: Tables) -> DataFrame:
    edges, nodes = contract_inputs(t)
    return filters.contract_problems(edges, nodes, filters.rules_frame(edges, KG_RULES))


@query("predicate_contract", "C-8", CONTRACT_SQL + " SELECT id, problem FROM problems")
def predicate_contract(t):
    return kg_contract_problems(t)


@query("record_constraints", "C-9", """
WITH v AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS placed, o_totalprice, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, 'amount is in the allowed range' AS problem FROM v WHERE NOT (o_totalprice >= 0 AND o_totalprice < 400000)
UNION ALL SELECT o_orderkey, 'status is known' FROM v WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'id fits' FROM v WHERE length('order:' || o_orderkey) > 10
UNION ALL SELECT o_orderkey, 'open orders have a priority' FROM v WHERE o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED'""")
def record_constraints(t):
    rows = t.orders.withColumn("placed", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return filters.violations(rows, "o_orderkey", {
        "time is UTC": F.col("placed").rlike(filters.UTC_PATTERN),
        "amount is in the allowed range": (F.col("o_totalprice") >= 0) & (F.col("o_totalprice") < 400000),
        "status is known": F.col("o_orderstatus").isin("F", "O"),
        "id fits": F.length(F.concat(F.lit("order:"), "o_orderkey")) <= 10,
        "open orders have a priority": (F.col("o_orderstatus") != "O") | (F.col("o_orderpriority") != "4-NOT SPECIFIED"),
    })


@query("kind_constraints", "C-9", """
WITH ent AS (SELECT CASE c_custkey % 7 WHEN 0 THEN 'customer:' WHEN 1 THEN 'ORCID:' ELSE 'person:' END || c_custkey AS id, 'person' AS type, c_name AS label FROM customer
  UNION ALL SELECT 'asset:' || p_partkey, CASE WHEN p_size = 50 THEN 'thing' ELSE 'asset' END, CASE WHEN p_size = 49 THEN ' ' ELSE p_name END FROM part
  UNION ALL SELECT 'org:' || CASE WHEN s_suppkey % 10 = 0 THEN repeat('x', 180) ELSE '' END || s_suppkey, 'organization', s_name FROM supplier),
sp AS (SELECT doc_id, doc_id % 50 AS start, doc_id % 50 + CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 40 END AS stop, substr(text, doc_id % 50 + 1, 40) AS quote, length(text) AS size FROM documents)
SELECT 'entity' AS kind, id, 'type is known' AS problem FROM ent WHERE type = 'thing'
UNION ALL SELECT 'entity', id, 'id has a prefix of its type' FROM ent WHERE type = 'person' AND id LIKE 'customer:%'
UNION ALL SELECT 'entity', id, 'id is not too long' FROM ent WHERE length(id) > 180
UNION ALL SELECT 'entity', id, 'label is not empty' FROM ent WHERE trim(label) = ''
UNION ALL SELECT 'span', CAST(doc_id AS VARCHAR), 'span is not empty' FROM sp WHERE start >= stop
UNION ALL SELECT 'span', CAST(doc_id AS VARCHAR), 'span lies inside the text' FROM sp WHERE stop > size
UNION ALL SELECT 'span', CAST(doc_id AS VARCHAR), 'quote is as long as the span' FROM sp WHERE length(quote) <> stop - start
UNION ALL SELECT 'sentence', conv_id || ':' || turn, 'sentence names a record' FROM conversations WHERE turn % 3 = 2
UNION ALL SELECT 'sentence', conv_id || ':' || turn, 'sentence has a text' FROM conversations WHERE trim(text, ' ') = ''""")
def kind_constraints(t):
    """Constraints of entities, spans and sentences in one report."""
    k = F.col("c_custkey") % 7
    entities = (
        t.customer.select(F.concat(F.when(k == 0, "customer:").when(k == 1, "ORCID:").otherwise("person:"), "c_custkey").alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("label"))
        .unionByName(t.part.select(F.concat(F.lit("asset:"), "p_partkey").alias("id"), F.when(F.col("p_size") == 50, "thing").otherwise("asset").alias("type"),
                                   F.when(F.col("p_size") == 49, " ").otherwise(F.col("p_name")).alias("label")))
        .unionByName(t.supplier.select(F.concat(F.lit("org:"), F.when(F.col("s_suppkey") % 10 == 0, F.repeat(F.lit("x"), 180)).otherwise(""), "s_suppkey").alias("id"),
                                       F.lit("organization").alias("type"), F.col("s_name").alias("label"))))
    start = (F.col("doc_id") % 50).cast("int")
    spans = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), start.alias("start"), (start + F.when(F.col("doc_id") % 11 == 0, 0).otherwise(40)).alias("stop"),
        F.substring("text", start + 1, F.lit(40)).alias("quote"), F.char_length("text").alias("size"))
    record = lambda n: F.when(F.col("turn") % 3 == n, F.array(F.concat(F.lit("r:"), "turn"))).otherwise(F.array().cast("array<string>"))
    sentences = t.conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text", record(0).alias("assertion_ids"), record(1).alias("calculation_ids"), F.lit(None).cast("array<string>").alias("opportunity_ids"))
    parts = {"entity": (entities, filters.entity_rules(ID_PREFIXES)), "span": (spans, filters.span_rules()), "sentence": (sentences, filters.sentence_rules())}
    found = [filters.violations(df, "id", rules).select(F.lit(kind).alias("kind"), "id", "problem") for kind, (df, rules) in parts.items()]
    return reduce(DataFrame.unionByName, found)


def mappings(t: Tables) -> DataFrame:
    relation = (
        F.when(F.col("p_type") == "PROMO", "exact").when(F.col("p_type") == "SMALL", "broad")
        .when(F.col("p_type") == "LARGE", "narrow").otherwise("related")
    )
    spaces = F.when(F.col("p_size") % 3 == 0, "OMIM:").when(F.col("p_size") % 3 == 1, "ORPHA:").otherwise("UMLS:")
    return t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("subject_id"), relation.alias("relation"),
                         F.concat(spaces, F.col("p_partkey") % 500).alias("object_id"))


MAPPINGS_SQL = """mappings AS (SELECT 'part:' || p_partkey AS subject_id, CASE p_type WHEN 'PROMO' THEN 'exact'
  WHEN 'SMALL' THEN 'broad' WHEN 'LARGE' THEN 'narrow' ELSE 'related' END AS relation,
  CASE p_size % 3 WHEN 0 THEN 'OMIM:' WHEN 1 THEN 'ORPHA:' ELSE 'UMLS:' END || (p_partkey % 500) AS object_id FROM part)"""


@query("exact_equivalence", "C-10", f"""WITH {MAPPINGS_SQL}
SELECT subject_id, object_id FROM mappings WHERE relation = 'exact' AND object_id NOT LIKE 'UMLS:%'""")
def exact_equivalence(t):
    return filters.exact_equivalents(mappings(t)).select("subject_id", "object_id")


@query("unique_names", "C-11", """
WITH n AS (SELECT 'part:' || p_partkey AS id, p_name AS name FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation)
SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name, count(DISTINCT id) AS holders,
  CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM n GROUP BY 1""")
def unique_names(t):
    rows = b.names(t).filter("type in ('part', 'supplier', 'nation') and alias_type = 'label'")
    return filters.unique_names(rows.select(text.words_only(F.col("alias")).alias("name"), F.col("entity").alias("id")))


def assertions(t: Tables) -> DataFrame:
    """Customers as assertions under review."""
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("predicate"),
        F.when(F.col("c_acctbal") < 0, "manual_import").otherwise("source_adapter").alias("origin"),
        F.col("c_nationkey").alias("context_id"),
    )


BATCH_SQL = f"""WITH {b.STATES_SQL}
SELECT c_custkey AS id, current_hash FROM customer JOIN states ON target_id = c_custkey
WHERE current_hash IS NOT NULL AND state = 'pending' AND c_mktsegment = 'BUILDING' AND c_acctbal >= 0
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '%URGENT%')"""


def batch(t: Tables) -> DataFrame:
    states = windows.effective_state(b.targets(t), b.reviews(t)).withColumnRenamed("target_id", "id")
    supports = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("source_ref"))
    return filters.batch_targets(assertions(t), states, supports, predicate="BUILDING", origin="source_adapter",
                                 source_contains="URGENT")


@query("batch_targets", "C-12", BATCH_SQL)
def batch_targets(t):
    return batch(t)


@query("batch_decisions", "C-13", f"""SELECT 'assertion' AS target_type, id AS target_id, current_hash AS target_hash,
  'reviewer-1' AS reviewer, '2026-01-01T00:00:00Z' AS reviewed_at, 'accepted' AS decision, 'faithful' AS reason,
  'pass' AS source_fidelity, 6 AS dimensions FROM ({BATCH_SQL})""")
def batch_decisions(t):
    rows = filters.decision_rows(batch(t), "assertion", "reviewer-1", "2026-01-01T00:00:00Z", "accepted", "faithful")
    return rows.select("*", F.col("dimensions")["source_fidelity"].alias("source_fidelity"),
                       F.size("dimensions").alias("n")).drop("dimensions").withColumnRenamed("n", "dimensions")


def source_rows(t: Tables) -> DataFrame:
    meta = F.create_map(
        F.lit("server"), F.col("source"), F.lit("doi"), F.concat(F.lit("10.1/"), "doc_id"), F.lit("n_chars"),
        F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"),
    )
    policy = F.when(F.col("doc_id") % 3 == 0, "link_only").otherwise("excerpt")
    return t.documents.select("doc_id", meta.alias("meta"), policy.alias("policy"), "text")


@query("public_metadata", "C-14", """
SELECT doc_id, 2 AS n_keys, source AS server, '10.1/' || doc_id AS doi, true AS lang_hidden FROM documents""")
def public_metadata(t):
    kept = source_rows(t).select("doc_id", filters.public_metadata(F.col("meta")).alias("m"))
    return kept.select("doc_id", F.size("m").alias("n_keys"), F.col("m")["server"].alias("server"),
                       F.col("m")["doi"].alias("doi"), (~F.map_contains_key("m", "lang")).alias("lang_hidden"))


@query("text_policy_gate", "C-15", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS spans,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS quote FROM documents""")
def text_policy_gate(t):
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("text").alias("quote")))
    rows = source_rows(t).select("doc_id", filters.spans_for_policy(F.col("policy"), span).alias("s"))
    return rows.select("doc_id", F.size("s").alias("spans"), F.get("s", F.lit(0))["quote"].alias("quote"))


REASONS_SQL = f"""WITH {b.ANN_SQL},
r AS (SELECT 'part:' || p_partkey AS target, 'curated ' || p_brand AS reason FROM part WHERE p_type NOT IN ('SMALL', 'ECONOMY')
  UNION ALL SELECT term, 'mapped ' || entity FROM (SELECT DISTINCT term, entity FROM ann WHERE aspect = 'P' AND NOT negated)
  QUALIFY count(*) OVER (PARTITION BY term) = 1)"""


def selection_input(t):
    curated = t.part.filter("p_type not in ('SMALL', 'ECONOMY')").select(
        F.concat(F.lit("part:"), "p_partkey").alias("target"), F.concat(F.lit("curated "), "p_brand").alias("reason"))
    once = b.positive(b.annotations(t)).groupBy("term").agg(
        F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter("lo = hi")
    return curated, once.select(F.col("term").alias("target"), F.concat(F.lit("mapped "), "lo").alias("reason"))


@query("disease_selection", "C-16", REASONS_SQL + " SELECT target, count(*) AS reasons, min(reason) AS first_reason FROM r GROUP BY 1")
def disease_selection(t):
    return filters.selection(*selection_input(t))


@query("disease_selection_reasons", "C-16", REASONS_SQL + " SELECT target, reason FROM r")
def disease_selection_reasons(t):
    return filters.selection_reasons(*selection_input(t))


def association_type(col: str = "p_type"):
    return (
        F.when(F.col(col) == "PROMO", "Disease-causing germline mutation(s) (loss of function) in")
        .when(F.col(col) == "SMALL", "Disease-causing germline mutation(s) (gain of function) in")
        .when(F.col(col) == "LARGE", "Disease-causing germline mutation(s) in")
        .when(F.col(col) == "MEDIUM", "Disease-causing somatic mutation(s) (gain of function) in")
        .otherwise("Candidate gene tested in")
    )


EFFECT_SQL = "CASE p_type WHEN 'PROMO' THEN 'loss' WHEN 'SMALL' THEN 'gain' WHEN 'MEDIUM' THEN 'gain' END"


@query("stated_effect", "C-17", f"SELECT p_partkey, {EFFECT_SQL} AS effect FROM part")
def stated_effect(t):
    return t.part.select("p_partkey", filters.stated_effect(association_type()).alias("effect"))


@query("protocol_role", "C-18", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def protocol_role(t):
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus", F.lit("supports").alias("stance"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "protocol").otherwise("article").alias("document_role"),
        F.when(F.col("o_orderstatus") == "F", "reported_result").when(F.col("o_orderstatus") == "P", "planned")
        .otherwise("listed_record").alias("statement_status"),
    )
    return filters.protocol_conflicts(rows).select("o_orderkey", "o_orderstatus")


HOST_SQL = r"regexp_replace(lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)), '^www\.', '')"


@query("approved_pages", "C-20", r"""
SELECT page_id, CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 10 = 0) THEN 'page' WHEN url LIKE 'https://blog.%' OR url LIKE 'http://www.cheap-pills.%' THEN 'prefix'
  ELSE 'rejected' END AS rule FROM pages""")
def approved_pages(t):
    exact = t.pages.filter("page_id % 10 = 0").select("url")
    prefixes = t.pages.select(F.regexp_extract("url", r"^(https://blog\.|http://www\.cheap-pills\.)", 1).alias("prefix"))
    ok, rejected = filters.approved(t.pages.select("page_id", "url"), exact, prefixes.filter("prefix <> ''").distinct())
    return ok.select("page_id", "rule").unionByName(rejected.select("page_id", F.lit("rejected").alias("rule")))


@query("content_marker", "C-21", """
SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND length(html) > 0 AND contains(html, '<article>')""")
def content_marker(t):
    rows = t.pages.select("page_id", F.col("html").alias("body"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"))
    return filters.with_marker(rows, F.lit("<article>")).select("page_id")


@query("endpoint_filter", "C-22", "SELECT page_id, url FROM pages WHERE contains(url, '/fr/')")
def endpoint_filter(t):
    return t.pages.filter(F.col("url").contains("/fr/")).select("page_id", "url")
