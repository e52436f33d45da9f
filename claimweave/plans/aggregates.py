"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.vocab import STATUS_PHRASES
from claimweave.operators import aggregates, filters, graph, similarity
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query
from claimweave.plans.filters import EFFECT_SQL, association_type
from claimweave.plans.similarity import World

CLAIM_KEY = ["subject", "predicate", "object", "statement_status"]


@query("claim_merge", "G-5", f"""WITH {b.CLAIMS_SQL}
SELECT subject, predicate, object, statement_status, min(evidence) AS first_evidence, min_by(origin, evidence) AS origin,
  count(DISTINCT evidence) AS supports FROM claims GROUP BY 1, 2, 3, 4""")
def claim_merge(t):
    return aggregates.merge_claims(b.claims(t), CLAIM_KEY, "evidence")


@query("claim_supports", "G-5", f"WITH {b.CLAIMS_SQL} SELECT DISTINCT subject, predicate, object, statement_status, evidence AS support FROM claims")
def claim_supports(t):
    return aggregates.claim_supports(b.claims(t), CLAIM_KEY, "evidence")


BUCKETS_SQL = b.CLAIMS_SQL + """,
buckets AS (SELECT subject, predicate, object, count(*) AS members,
  count(DISTINCT CASE statement_status WHEN 'negated' THEN 'negative' WHEN 'planned' THEN NULL ELSE 'positive' END) > 1 AS polarity_differs,
  count(DISTINCT nullif(effect_direction, 'unknown')) > 1 AS direction_differs FROM claims GROUP BY 1, 2, 3)"""


@query("disagreement_buckets", "G-6", f"WITH {BUCKETS_SQL} SELECT * FROM buckets WHERE polarity_differs OR direction_differs")
def disagreement_buckets(t):
    return aggregates.disagreements(b.claims(t), ["subject", "predicate", "object"])


def eligible_claims(t: Tables) -> DataFrame:
    """Claims with conflict, validity and mapping flags taken from labels and suppliers."""
    c = b.claims(t).withColumn("claim", F.col("evidence")).withColumn("mapped_id", F.concat(F.lit("OMIM:"), "l_suppkey"))
    flags = t.lineitem.join(t.labels, F.col("l_orderkey") == F.col("doc_id")).select(
        b.line_id().alias("claim"), (F.col("toxic") == 1).alias("in_unresolved_conflict"),
        (F.col("l_quantity") >= 25).alias("in_usable_conflict"), (F.col("l_discount") > 0.05).alias("opposed"),
        (F.col("quality") == 0).alias("non_positive"))
    exact = t.supplier.filter("s_acctbal >= 1000").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("subject"), F.concat(F.lit("OMIM:"), "s_suppkey").alias("mapped_id"))
    return aggregates.analytic_inputs(c, flags, exact)


ELIGIBLE_SQL = b.CLAIMS_SQL + f""",
elig AS (SELECT c.*, NOT coalesce(toxic = 1, false) AND NOT (coalesce(l.l_discount > 0.05 AND doc_id IS NOT NULL, false) AND NOT coalesce(l.l_quantity >= 25, false))
    AND NOT coalesce(quality = 0, false) AND (c.origin <> 'source_adapter' OR s_acctbal >= 1000) AS eligible
  FROM claims c JOIN lineitem l ON c.evidence = {b.LINE_ID_SQL.replace('l_', 'l.l_')} JOIN supplier ON s_suppkey = c.l_suppkey
  LEFT JOIN labels ON doc_id = l.l_orderkey)"""


@query("analytic_eligibility", "G-8", f"WITH {ELIGIBLE_SQL} SELECT subject, eligible, count(*) AS n FROM elig GROUP BY 1, 2")
def analytic_eligibility(t):
    return eligible_claims(t).groupBy("subject", "eligible").agg(F.count("*").alias("n"))


PROFILE_TERMS_SQL = ELIGIBLE_SQL + """,
pt AS (SELECT subject, object, count(*) FILTER (eligible AND statement_status IN ('reported_result', 'listed_record')) AS positives,
  count(*) FILTER (statement_status = 'negated') AS negated FROM elig GROUP BY 1, 2)"""


@query("profile_terms", "G-7", f"WITH {PROFILE_TERMS_SQL} SELECT subject, object, positives, negated, positives > 0 AND negated > 0 AS open FROM pt")
def profile_terms(t):
    return aggregates.profile_terms(eligible_claims(t))


@query("profile_members", "G-7", f"""WITH {ELIGIBLE_SQL},
pos AS (SELECT subject, CASE WHEN l_quantity >= 25 THEN 'disease_baseline' ELSE 'subgroup' END AS level, evidence, 'order:' || source AS family, CASE WHEN origin = 'source_adapter' THEN 'OMIM:' || l_suppkey END AS mapped_id
  FROM elig WHERE eligible AND statement_status IN ('reported_result', 'listed_record'))
SELECT DISTINCT subject, level, 'evidence' AS kind, evidence AS id FROM pos UNION ALL SELECT DISTINCT subject, level, 'family', family FROM pos
UNION ALL SELECT DISTINCT subject, level, 'mapped', mapped_id FROM pos WHERE mapped_id IS NOT NULL""")
def profile_members(t):
    """Evidence, publication families and mapped ids of both levels; lines of 25 and more speak about the disease."""
    c = eligible_claims(t)
    return aggregates.profile_members(c.select(
        "subject", F.when(F.col("l_quantity") >= 25, "disease_baseline").otherwise("subgroup").alias("level"), "statement_status", "eligible", "evidence",
        F.concat(F.lit("order:"), "source").alias("family"), F.when(F.col("origin") == "source_adapter", F.concat(F.lit("OMIM:"), "l_suppkey")).alias("mapped_id")))


@query("profile_summary", "G-7", f"""WITH {PROFILE_TERMS_SQL} SELECT subject, count(*) FILTER (positives > 0) AS direct_terms,
CAST(sum(positives) AS BIGINT) AS assertions, count(*) FILTER (positives > 0 AND negated > 0) AS open_disagreements FROM pt GROUP BY 1""")
def profile_summary(t):
    return aggregates.profiles(aggregates.profile_terms(eligible_claims(t)))


@query("publication_family", "G-9", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ref:PMID' || doc_id WHEN doc_id % 4 = 1 THEN 'family:' || source ELSE 'source:' || lang END AS family FROM documents""")
def publication_family(t):
    ref = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("PMID"), "doc_id"))
    fam = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("family:"), "source")).otherwise("")
    return t.documents.select("doc_id", aggregates.family_key(ref, fam, F.col("lang")).alias("family"))


COHORT_SQL = """rows_ AS (SELECT source, doc_id AS family, 'n' || (n_chars % 40) AS cohort FROM documents
  UNION SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' || (doc_id % 5) END FROM documents),
reach AS (WITH RECURSIVE r(source, a, b) AS (SELECT DISTINCT source, family, family FROM rows_
    UNION SELECT r.source, r.a, y.family FROM r JOIN rows_ x ON x.source = r.source AND x.family = r.b JOIN rows_ y ON y.source = x.source AND y.cohort = x.cohort)
  SELECT * FROM r)"""


@query("independent_publications", "G-10", f"""WITH {COHORT_SQL}
SELECT source, count(DISTINCT a) AS families, count(DISTINCT root) AS independent FROM (SELECT source, a, min(b) AS root FROM reach GROUP BY 1, 2) GROUP BY 1""")
def independent_publications(t):
    d = t.documents
    cohorts = F.array(F.concat(F.lit("n"), F.col("n_chars") % 40),
                      F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.col("doc_id") % 5)))
    rows = d.select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("family"), F.explode(cohorts).alias("cohort"))
    return aggregates.independent_publications(rows, ["source"])


@query("functional_effect_facet", "G-12", f"""SELECT effect, count(*) AS members, min(p_partkey) AS first_member
FROM (SELECT p_partkey, {EFFECT_SQL} AS effect FROM part) WHERE effect IS NOT NULL GROUP BY 1""")
def functional_effect_facet(t):
    return aggregates.effect_facet(t.part.select(
        F.col("p_partkey").alias("context"), filters.stated_effect(association_type()).alias("effect")))


@query("functional_effect_members", "G-12", f"SELECT effect, context FROM (SELECT p_partkey AS context, {EFFECT_SQL} AS effect FROM part) WHERE effect IS NOT NULL")
def functional_effect_members(t):
    return aggregates.effect_members(t.part.select(
        F.col("p_partkey").alias("context"), filters.stated_effect(association_type()).alias("effect")))


SHARED_GENE_SQL = """m AS (SELECT p_partkey AS context, p_brand AS gene, p_type AS disease FROM part),
sizes AS (SELECT gene, count(DISTINCT context) AS members FROM m GROUP BY gene HAVING count(DISTINCT context) >= 2),
rec AS (SELECT DISTINCT p_brand AS gene, l_orderkey AS assertion FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def shared_gene_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    members = t.part.select(F.col("p_partkey").alias("context"), F.col("p_brand").alias("gene"), F.col("p_type").alias("disease"))
    cited = t.lineitem.select(F.col("l_orderkey").alias("assertion"), F.col("l_partkey").alias("p_partkey"))
    return members, cited.join(t.part, "p_partkey").select("assertion", F.col("p_brand").alias("gene"), F.col("p_type").alias("disease"))


@query("shared_gene_facet", "G-13", f"WITH {SHARED_GENE_SQL} SELECT gene, members, count(assertion) AS assertions FROM sizes LEFT JOIN rec USING (gene) GROUP BY 1, 2")
def shared_gene_facet(t):
    return aggregates.shared_gene_facet(*shared_gene_input(t))


@query("shared_gene_records", "G-13", f"WITH {SHARED_GENE_SQL} SELECT gene, assertion FROM sizes JOIN rec USING (gene)")
def shared_gene_records(t):
    return aggregates.shared_gene_records(*shared_gene_input(t))


SETS_SQL = """sets AS (SELECT o_custkey AS owner, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS items,
  count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)"""


def priority_sets(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("item"))
    return aggregates.same_set_groups(pairs, "owner", "item")


@query("shared_set_facet", "G-14", f"""WITH {SETS_SQL} SELECT n AS set_size, count(*) AS owners, min(owner) AS first_owner
FROM sets WHERE n >= 2 GROUP BY items, n""")
def shared_set_facet(t):
    return priority_sets(t).select("set_size", "owners", "first_owner")


@query("shared_set_owners", "G-14", f"WITH {SETS_SQL} SELECT min(owner) OVER (PARTITION BY items) AS first_owner, owner FROM sets WHERE n >= 2")
def shared_set_owners(t):
    pairs = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("item"))
    return aggregates.same_set_owners(pairs, "owner", "item")


@query("shared_set_members", "G-14", f"""WITH {SETS_SQL}, g AS (SELECT min(owner) AS first_owner FROM sets WHERE n >= 2 GROUP BY items)
SELECT DISTINCT first_owner, o_orderpriority AS item FROM g JOIN orders ON o_custkey = first_owner""")
def shared_set_members(t):
    first = priority_sets(t).select("first_owner")
    return first.join(t.orders.select(F.col("o_custkey").alias("first_owner"), F.col("o_orderpriority").alias("item")), "first_owner").distinct()


@query("unclustered_remainder", "G-15", """
SELECT c_custkey AS context FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 50000)""")
def unclustered_remainder(t):
    o = t.orders
    members = o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select("o_custkey").unionByName(
        o.filter("o_orderstatus = 'P' and o_totalprice < 50000").select("o_custkey"))
    return t.customer.select(F.col("c_custkey").alias("context")).join(
        members.withColumnRenamed("o_custkey", "context"), "context", "left_anti")


@query("mechanism_process_view", "G-16", f"""WITH {ELIGIBLE_SQL}
SELECT subject AS mechanism, p_type AS process, count(*) AS assertions FROM elig JOIN part ON p_partkey = l_partkey
WHERE eligible AND statement_status IN ('reported_result', 'listed_record') GROUP BY 1, 2""")
def mechanism_process_view(t):
    ok = eligible_claims(t).filter(F.col("eligible") & F.col("statement_status").isin("reported_result", "listed_record"))
    return ok.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy(
        F.col("subject").alias("mechanism"), F.col("p_type").alias("process")).agg(F.count("*").alias("assertions"))


MECH_SQL = f"""mech AS (SELECT p_partkey AS id, p_size <= 45 AS known, coalesce({EFFECT_SQL}, 'unknown') AS effect, p_brand AS gene,
  CASE WHEN p_size % 4 <> 0 THEN p_type END AS process_key, CASE WHEN p_size % 3 <> 0 THEN p_name END AS cell, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS assay FROM part),
pairs AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) x
  JOIN lineitem y USING (l_orderkey) WHERE x.l_partkey <> y.l_partkey)"""


def mechanisms(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("id"), (size <= 45).alias("known"),
        F.coalesce(filters.stated_effect(association_type()), F.lit("unknown")).alias("effect"), F.col("p_brand").alias("gene"),
        F.when(size % 4 != 0, F.col("p_type")).alias("process_key"), F.when(size % 3 != 0, F.col("p_name")).alias("cell"),
        F.when(size % 5 != 0, F.col("p_brand")).alias("assay"), stated_by(size).alias("evidence"))


def stated_by(size: Column) -> Column:
    """Dimension -> the records of a part that state it: its type, its brand, its size sheet."""
    def ids(*names: str) -> Column:
        return F.array(*[F.concat(F.lit(f"{n}:"), "p_partkey") for n in names])

    none = F.array().cast("array<string>")
    return F.create_map(
        F.lit("functional_effect"), ids("type"), F.lit("gene"), ids("brand"), F.lit("affected_process"), F.when(size % 4 != 0, ids("type", "sheet")).otherwise(none),
        F.lit("cell_or_tissue_context"), F.when(size % 3 != 0, ids("name")).otherwise(none), F.lit("assay_or_species_context"), F.when(size % 5 != 0, ids("brand")).otherwise(none))


def mechanism_pairs(t: Tables) -> DataFrame:
    """The first part of every order with each other part of it."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    pairs = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("b")).join(first, "l_orderkey").filter("a <> b").select("a", "b").distinct()
    m = mechanisms(t)

    def side(s):
        return m.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in m.columns if c != "id"])

    return pairs.join(side("a"), "a").join(side("b"), "b")


@query("mechanism_comparison", "G-17", f"""WITH {MECH_SQL},
j AS (SELECT a, b, ma, mb FROM pairs JOIN mech ma ON ma.id = a JOIN mech mb ON mb.id = b),
f AS (SELECT a, b, 'functional_effect' AS dimension, CASE WHEN NOT (ma.known AND mb.known) OR 'unknown' IN (ma.effect, mb.effect) THEN 'unknown' WHEN ma.effect = mb.effect THEN 'same' ELSE 'different' END AS comparison FROM j
  UNION ALL SELECT a, b, 'gene', CASE WHEN ma.gene = mb.gene THEN 'same' ELSE 'different' END FROM j WHERE ma.known AND mb.known
  UNION ALL SELECT a, b, 'affected_process', CASE WHEN ma.process_key IS NULL OR mb.process_key IS NULL THEN 'unknown' WHEN ma.process_key = mb.process_key THEN 'same' ELSE 'not_comparable' END FROM j WHERE ma.known AND mb.known
  UNION ALL SELECT a, b, 'cell_or_tissue_context', CASE WHEN ma.cell IS NULL OR mb.cell IS NULL THEN 'unknown' WHEN ma.cell = mb.cell THEN 'same' ELSE 'not_comparable' END FROM j WHERE ma.known AND mb.known
  UNION ALL SELECT a, b, 'assay_or_species_context', CASE WHEN ma.assay IS NULL OR mb.assay IS NULL THEN 'unknown' WHEN ma.assay = mb.assay THEN 'same' ELSE 'not_comparable' END FROM j WHERE ma.known AND mb.known),
ev AS (SELECT p_partkey AS id, unnest([['functional_effect', 'type:' || p_partkey], ['gene', 'brand:' || p_partkey], ['affected_process', CASE WHEN p_size % 4 <> 0 THEN 'type:' || p_partkey END],
    ['affected_process', CASE WHEN p_size % 4 <> 0 THEN 'sheet:' || p_partkey END], ['cell_or_tissue_context', CASE WHEN p_size % 3 <> 0 THEN 'name:' || p_partkey END],
    ['assay_or_species_context', CASE WHEN p_size % 5 <> 0 THEN 'brand:' || p_partkey END]]) AS e FROM part),
ids AS (SELECT f.a, f.b, f.dimension, string_agg(DISTINCT e[2], ',' ORDER BY e[2]) AS assertion_ids FROM (SELECT a, b, dimension, unnest([a, b]) AS id FROM f) f JOIN ev ON ev.id = f.id AND e[1] = f.dimension WHERE e[2] IS NOT NULL GROUP BY ALL)
SELECT f.a, f.b, f.dimension, f.comparison, coalesce(assertion_ids, '') AS assertion_ids FROM f LEFT JOIN ids USING (a, b, dimension)""")
def mechanism_comparison(t):
    return aggregates.mechanism_features(mechanism_pairs(t)).withColumn("assertion_ids", F.array_join("assertion_ids", ","))


@query("status_counts", "G-23", """
SELECT 'orders' AS tbl, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2""")
def status_counts(t):
    def counted(df, name, col):
        return df.groupBy(F.col(col).alias("state")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "state", "n")

    return (counted(t.orders, "orders", "o_orderstatus").unionByName(counted(t.lineitem, "lineitem", "l_linestatus"))
            .unionByName(counted(t.events, "events", "event_type")).unionByName(counted(t.documents, "documents", "lang")))


LEDGER_SQL = """led AS (SELECT o_orderkey AS id, o_orderpriority AS provider, o_totalprice AS amount, o_custkey % 10 AS run,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'not_sent' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'uncertain' END AS outcome,
  (SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS actual FROM orders)"""
CHARGE_SQL = """round(sum(CASE WHEN outcome IS NULL OR outcome = 'uncertain' THEN amount WHEN outcome = 'completed' THEN coalesce(actual, amount) ELSE 0 END), 2) AS usd,
  count(*) FILTER (outcome IS DISTINCT FROM 'not_sent') AS requests"""


def ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    reserves = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("provider"),
                               F.col("o_totalprice").alias("amount"), (F.col("o_custkey") % 10).alias("run"))
    spent = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("actual"))
    settles = t.orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("id"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0), "not_sent")
        .when(F.col("o_orderstatus") == "F", "completed").otherwise("uncertain").alias("outcome")).join(spent, "id", "left")
    return reserves, settles


@query("ledger_rollup", "G-24", f"WITH {LEDGER_SQL} SELECT provider, {CHARGE_SQL} FROM led GROUP BY ROLLUP (provider)")
def ledger_rollup(t):
    out = aggregates.ledger_totals(*ledger(t))
    return out.select("provider", F.round("usd", 2).alias("usd"), "requests")


@query("ledger_by_run", "G-24", f"WITH {LEDGER_SQL} SELECT run, {CHARGE_SQL} FROM led GROUP BY ROLLUP (run)")
def ledger_by_run(t):
    reserves, settles = ledger(t)
    out = aggregates.ledger_totals(reserves.drop("provider").withColumnRenamed("run", "provider"), settles)
    return out.select(F.col("provider").alias("run"), F.round("usd", 2).alias("usd"), "requests")


@query("assertion_badges", "G-25", """
WITH r AS (SELECT l_partkey, 0 AS ord, 'origin' AS kind, CASE l_linestatus WHEN 'F' THEN 'source adapter' ELSE 'manual import' END AS label FROM lineitem
  UNION SELECT l_partkey, 1, 'statement_status', CASE l_returnflag WHEN 'R' THEN 'explicitly negated' WHEN 'A' THEN 'reported result' ELSE 'listed database record' END FROM lineitem
  UNION SELECT l_partkey, 2, 'conflict', 'Conflicting accounts' FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AND bool_or(l_returnflag = 'A' AND l_linestatus = 'O'))
SELECT l_partkey, string_agg(kind || '=' || label, '; ' ORDER BY ord, kind, label) AS badges FROM r GROUP BY 1""")
def assertion_badges(t):
    def badge(df, ord_, kind, label):
        return df.select("l_partkey", F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), label.alias("label"))

    li = t.lineitem.select("l_partkey", "l_linestatus", "l_returnflag")
    status = F.when(F.col("l_returnflag") == "R", "negated").when(F.col("l_returnflag") == "A", "reported_result").otherwise("listed_record")
    conflict = li.groupBy("l_partkey").agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("x"),
        F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")).alias("y")).filter("x and y")
    rows = (
        badge(li, 0, "origin", F.when(F.col("l_linestatus") == "F", "source adapter").otherwise("manual import"))
        .unionByName(badge(li, 1, "statement_status", filters.lookup(STATUS_PHRASES, status)))
        .unionByName(badge(conflict, 2, "conflict", F.lit("Conflicting accounts"))))
    return aggregates.distinct_badges(rows, "l_partkey")


@query("gene_links", "G-26", "SELECT DISTINCT l_partkey AS disease, l_suppkey AS gene FROM lineitem WHERE l_returnflag <> 'R'")
def gene_links(t):
    return t.lineitem.filter("l_returnflag <> 'R'").select(
        F.col("l_partkey").alias("disease"), F.col("l_suppkey").alias("gene")).distinct()


@query("context_draft", "G-27", """
WITH r AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY 1),
g AS (SELECT l_suppkey, count(DISTINCT p_brand) AS genes FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 GROUP BY 1)
SELECT 'ctx:supplier:' || s_suppkey AS context, coalesce(genes, 0) AS genes, CASE WHEN s_acctbal < 1000 THEN 0 ELSE 1 END AS exact_ids,
  CASE WHEN s_acctbal < 1000 THEN 0 ELSE coalesce(n, 0) END AS annotation_rows, CASE WHEN s_nationkey % 5 = 0 THEN 'grouping class' ELSE 'disease' END AS granularity,
  s_acctbal >= 1000 AND coalesce(n, 0) > 0 AS baseline_available FROM supplier LEFT JOIN r ON r.l_suppkey = s_suppkey LEFT JOIN g ON g.l_suppkey = s_suppkey""")
def context_draft(t):
    rows = t.lineitem.filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    genes = t.lineitem.filter("l_quantity = 50").join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("p_brand").alias("genes"))
    exact = F.when(F.col("s_acctbal") < 1000, 0).otherwise(1)
    n = F.when(exact == 1, F.coalesce("n", F.lit(0))).otherwise(0)
    return t.supplier.join(rows, "s_suppkey", "left").join(genes, "s_suppkey", "left").select(
        F.concat(F.lit("ctx:supplier:"), "s_suppkey").alias("context"), F.coalesce("genes", F.lit(0)).alias("genes"),
        exact.alias("exact_ids"), n.alias("annotation_rows"),
        F.when(F.col("s_nationkey") % 5 == 0, "grouping class").otherwise("disease").alias("granularity"), (n > 0).alias("baseline_available"))


@query("measurement_percentiles", "G-28", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT round(median(value), 6) AS p50, max(value) FILTER (i = CAST(floor(0.95 * n) AS BIGINT) - 1) AS p95, max(value) AS max, max(n) AS n FROM o""")
def measurement_percentiles(t):
    n = F.col("n")
    s = aggregates.order_statistics(t.events, "value", {
        "lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2), "p95": F.floor(F.lit(0.95) * n) - 1})
    return t.events.agg(F.max("value").alias("max"), F.count("value").alias("n")).select(
        F.round(F.lit((s["lo"] + s["hi"]) / 2), 6).alias("p50"), F.lit(s["p95"]).alias("p95"), "max", "n")


# ---- over similarity profiles ------------------------------------------------------------------------------------

@query("transitive_closure", "J-1", f"WITH {b.CLOSURE_SQL} SELECT node, ancestor FROM closure")
def transitive_closure(t):
    return graph.transitive_closure(b.ontology_edges(t))


@query("information_content", "G-1 H-21", f"WITH {b.ANN_SQL}, {b.CLOSURE_SQL}, {b.REF_SQL} SELECT term, n, total, round(ic, 6) + 0.0 AS ic FROM ic")
def information_content(t):
    return World(t).ic.select("term", "n", "total", (F.round("ic", 6) + F.lit(0.0)).alias("ic"))


@query("expanded_profile", "G-2", b.PROFILE_SQL + " SELECT entity, level, term FROM prof")
def expanded_profile(t):
    return World(t).expanded


@query("profile_provenance", "G-2", b.PROFILE_SQL + """
SELECT DISTINCT entity, ancestor AS term, 'claim:' || entity || ':' || term AS assertion FROM direct JOIN closure ON node = term WHERE ancestor <> 'ALL'""")
def profile_provenance(t):
    w = World(t)
    d = w.direct.withColumn("assertion", F.concat(F.lit("claim:"), "entity", F.lit(":"), "term"))
    return similarity.profile_provenance(d, w.closure, b.ROOTS)


STRICT_REF_SQL = b.PROFILE_SQL.replace("s_acctbal >= 0", "s_acctbal >= 6000")


@query("reference_coverage", "G-4", STRICT_REF_SQL + """
SELECT entity, count(*) AS direct_terms, count(ic) AS assessed_terms, round(count(ic) / count(*), 6) AS fraction, count(*) - count(ic) AS unassessed_terms
FROM (SELECT DISTINCT entity, term FROM direct) LEFT JOIN ic USING (term) GROUP BY 1""")
def reference_coverage(t):
    w = World(t)
    rich = t.supplier.filter("s_acctbal >= 6000").select(F.col("s_suppkey").alias("entity"))
    ic = similarity.information_content(b.positive(w.ann).join(rich, "entity", "left_semi"), w.closure)
    out = similarity.reference_coverage(w.direct, ic)
    return out.withColumn("fraction", F.round("fraction", 6))


@query("profile_snapshot", "G-11", b.PROFILE_SQL + """
SELECT entity, count(*) AS direct_term_count, CAST(sum(k) AS BIGINT) AS annotation_rows, count(ic) AS reference_assessed_count FROM
  (SELECT entity, term, count(*) AS k FROM ann WHERE aspect = 'P' AND NOT negated GROUP BY 1, 2) LEFT JOIN ic USING (term) GROUP BY 1""")
def profile_snapshot(t):
    w = World(t)
    terms = b.positive(w.ann).groupBy("entity", "term").agg(F.count("*").alias("n"))
    return terms.join(w.ic.select("term", "ic"), "term", "left").groupBy("entity").agg(
        F.count("*").alias("direct_term_count"), F.sum("n").alias("annotation_rows"), F.count("ic").alias("reference_assessed_count"))
