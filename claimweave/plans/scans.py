"""Scans and sinks: driver tables are written in a source format and read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import graph, joins, similarity
from claimweave.operators.filters import unique_names
from claimweave.functions.text import words_only
from claimweave.plans import exports
from claimweave.plans.catalogue import Tables, query
from claimweave.plans.scalars import PAGES_SQL, page_text_sql
from claimweave.plans.filters import HOST_SQL
from claimweave.plans.fingerprints import SNAPSHOT, hash_sql
from claimweave.session import cut_lineage, scratch_path
from claimweave.sources import annotations, captures, imports, lines, literature, ontology, records, registries, sinks


# ---- ontologies --------------------------------------------------------------------------------------------------

@query("obo_terms", "A-1", """
SELECT 'part:' || p_partkey AS id, p_name AS name, 'alt:' || p_partkey AS alt_ids, p_brand || ' "b"/EXACT,' || p_type || '/BROAD' AS synonyms, 'brand:' || split_part(p_brand, ' ', 1) || ',type:' || p_type AS is_a,
  p_size > 40 AS is_obsolete, CASE WHEN p_size > 40 THEN 'part:' || (p_partkey + 1) ELSE '' END AS replaced_by, 'OMIM:' || p_size || ' {source="m"}' AS xrefs, 'demo' AS subsets, 'hp/releases/2026-01-01' AS release FROM part""")
def obo_terms(t: Tables) -> DataFrame:
    terms, release = ontology.read_obo(t.spark, exports.obo(t))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return terms.select(
        "id", "name", joined("alt_ids"), F.array_join(F.transform("synonyms", lambda s: F.concat(s["text"], F.lit("/"), s["scope"])), ",").alias("synonyms"),
        joined("is_a"), "is_obsolete", joined("replaced_by"), F.array_join(F.transform("xrefs", lambda x: F.concat_ws(" ", x["id"], x["qualifier"])), ",").alias("xrefs"),
        joined("subsets")).withColumn("release", release.agg(F.max("release")).scalar())


@query("obo_edges", "A-1", """
SELECT 'part:' || p_partkey AS child, 0 AS pos, 'brand:' || p_brand AS parent FROM part UNION ALL SELECT 'part:' || p_partkey, 1, 'type:' || p_type FROM part""")
def obo_edges(t: Tables) -> DataFrame:
    return ontology.edges_of(ontology.read_obo(t.spark, exports.obo(t))[0])


@query("obographs_terms", "A-2 C-2", """
SELECT 'HP:' || p_partkey AS id, p_name AS name, 'HP:alt' || p_partkey AS alt_ids, p_brand || '/EXACT' AS synonyms, p_size > 40 AS is_obsolete, 'HP:' || (p_partkey + 1) AS replaced_by
FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""")
def obographs_terms(t: Tables) -> DataFrame:
    terms, _, _ = ontology.read_obographs(t.spark, exports.obographs(t))
    return terms.select("id", "name", F.array_join("alt_ids", ",").alias("alt_ids"), F.array_join(F.transform("synonyms", lambda s: F.concat(s["text"], F.lit("/"), s["scope"])), ",").alias("synonyms"),
                        "is_obsolete", F.array_join("replaced_by", ",").alias("replaced_by"))


@query("obographs_edges", "A-2", """
SELECT 'HP:' || p_partkey AS child, 'HP:b' || p_size AS parent, 'hp/releases/2026-02-02' AS release FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""")
def obographs_edges(t: Tables) -> DataFrame:
    _, edges, release = ontology.read_obographs(t.spark, exports.obographs(t))
    return edges.withColumn("release", release.agg(F.max("release")).scalar())


# ---- tables in text ----------------------------------------------------------------------------------------------

@query("annotation_rows", "A-3 E-7", """
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'OMIM:' ELSE 'ORPHA:' END || l_suppkey AS database_id, CASE WHEN l_returnflag = 'R' THEN 'NOT' ELSE '' END AS qualifier, 'part:' || l_partkey AS hpo_id,
  'PMID:' || l_orderkey AS reference, l_linenumber || '/7' AS frequency, CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'I' END AS aspect, true AS line_matches, '2026-03-03' AS version FROM lineitem""")
def annotation_rows(t: Tables) -> DataFrame:
    path = exports.annotation_lines(t)
    rows, meta = annotations.read_annotations(t.spark, path)
    version = meta.filter("key = 'version'").agg(F.max("value")).scalar()
    return rows.select("database_id", "qualifier", "hpo_id", "reference", "frequency", "aspect", (F.col("line_no") > 3).alias("line_matches")).withColumn("version", version)


@query("physical_line_numbers", "A-3", "SELECT count(*) AS data_lines, true AS contiguous FROM lineitem")
def physical_line_numbers(t: Tables) -> DataFrame:
    """Per file the line numbers are exactly 1 to the number of lines; every file carries a three-line head."""
    per = lines.read_lines(t.spark, exports.annotation_lines(t)).groupBy("file").agg(
        F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("d"))
    exact = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))
    return per.agg((F.sum("n") - 3 * F.count("*")).alias("data_lines"), F.bool_and(exact).alias("contiguous"))


@query("mapping_rows", "A-4", """
SELECT 'part:' || p_partkey AS subject_id, CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' WHEN 2 THEN 'related' WHEN 3 THEN 'related' END AS relation, CASE WHEN p_size % 2 = 0 THEN 'ORPHA:' ELSE 'OMIM:' END || p_partkey AS object_id,
  CASE WHEN p_size % 2 = 0 THEN 'Orphanet:' ELSE 'MIM:' END || p_partkey AS original_object_id, CASE WHEN p_size % 3 = 0 THEN 'semapv:Manual' END AS mapping_justification FROM part""")
def mapping_rows(t: Tables) -> DataFrame:
    rows, _ = annotations.read_mappings(t.spark, exports.mapping_lines(t))
    return rows.select("subject_id", "relation", "object_id", "original_object_id", "mapping_justification")


@query("submission_rows", "A-5 C-5", """
SELECT 'SGC-' || p_partkey AS sgc_id, 'S' || (p_partkey % 100) AS gene_symbol, p_name || ', "' || p_brand || '"' || chr(10) || 'second line' AS disease_title, CASE WHEN p_size % 4 = 0 THEN 'Limited' ELSE 'Definitive' END AS classification_title
FROM part WHERE p_partkey % 100 < 50""")
def submission_rows(t: Tables) -> DataFrame:
    symbols = t.part.select((F.col("p_partkey") % 100).alias("n")).distinct().filter("n < 50").select(F.concat(F.lit("S"), "n").alias("symbol"))
    return annotations.read_submissions(t.spark, exports.submission_csv(t), symbols).select("sgc_id", "gene_symbol", "disease_title", "classification_title")


@query("gaf_rows", "A-6", """
SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'NOT|involved_in' ELSE 'involved_in' END AS qualifier, 'GO:' || l_partkey AS process, 'PMID:' || l_orderkey AS reference, 'Demo' AS assigned_by
FROM lineitem WHERE l_linenumber <> 7 AND l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""")
def gaf_rows(t: Tables) -> DataFrame:
    symbols = t.supplier.filter("s_acctbal >= 0").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    return annotations.read_gaf(t.spark, exports.gaf_lines(t), symbols).select("symbol", "qualifier", "process", "reference", "assigned_by")


# ---- XML ---------------------------------------------------------------------------------------------------------

ASSOC_TYPE_SQL = """CASE p_type WHEN 'PROMO' THEN 'Disease-causing germline mutation(s) (loss of function) in' WHEN 'SMALL' THEN 'Disease-causing germline mutation(s) (gain of function) in'
  WHEN 'LARGE' THEN 'Disease-causing germline mutation(s) in' WHEN 'MEDIUM' THEN 'Disease-causing somatic mutation(s) (gain of function) in' ELSE 'Candidate gene tested in' END"""


@query("gene_disorder_rows", "A-7", f"""
SELECT CAST(p_partkey AS VARCHAR) AS orpha_code, p_name || ' & co' AS disorder_name, g AS gene_symbol, CASE WHEN k = 1 THEN 'HGNC:' || p_size END AS gene_hgnc, {ASSOC_TYPE_SQL} AS association_type,
  CASE WHEN k = 1 THEN 'Assessed' ELSE 'Not yet assessed' END AS association_status, 'PMID:' || p_partkey AS source_of_validation, '2026-04-04' AS release
FROM (SELECT *, 1 AS k, p_brand AS g FROM part UNION ALL SELECT *, 2, p_type FROM part)""")
def gene_disorder_rows(t: Tables) -> DataFrame:
    path = exports.gene_disorder_xml(t)
    release = literature.gene_disorder_release(t.spark, path).agg(F.max("release")).scalar()
    return literature.read_gene_disorders(t.spark, path).withColumn("release", release)


ARTICLE_SQL = """d AS (SELECT doc_id, source, replace(split_part(text, chr(10), 1), chr(10), ' ') || ' in vivo 🧬' AS title, trim(replace(CASE WHEN doc_id % 2 = 0 THEN text[1:60] ELSE text END, chr(10), ' ')) AS a1, trim(replace(text[61:], chr(10), ' ') || ' x') AS a2, doc_id % 2 = 0 AS two FROM documents WHERE doc_id % 10 <> 9)"""


@query("articles", "A-8", f"""WITH {ARTICLE_SQL}
SELECT CAST(doc_id AS VARCHAR) AS pmid, trim(title) AS title, sha256(trim(title) || chr(10) || chr(10) || a1 || CASE WHEN two THEN chr(10) || chr(10) || a2 ELSE '' END) AS text_sha,
  CASE WHEN two THEN 'title,AIM,abstract part 2' ELSE 'title,abstract' END AS labels, length(trim(title)) + 2 AS second_start, '10.1/' || doc_id AS doi, '2024' AS year, 'J ' || source AS journal FROM d""")
def articles(t: Tables) -> DataFrame:
    a = literature.read_articles(t.spark, exports.article_xml(t))
    return a.select("pmid", "title", F.sha2("canonical_text", 256).alias("text_sha"), F.array_join(F.transform("sections", lambda s: s["label"]), ",").alias("labels"),
                    F.get("sections", F.lit(1))["start"].alias("second_start"), "doi", "year", "journal")


@query("articles_not_returned", "A-8 F-11", "SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id % 10 = 9")
def articles_not_returned(t: Tables) -> DataFrame:
    found = literature.read_articles(t.spark, exports.article_xml(t))
    return literature.not_returned(t.documents.select(F.col("doc_id").cast("string").alias("pmid")), found)


# ---- JSON --------------------------------------------------------------------------------------------------------

def pins(t: Tables) -> DataFrame:
    return t.documents.filter("doc_id % 3 = 0").select(F.concat(F.lit("10.1101/"), "doc_id").alias("doi"), F.lit("10").alias("version"))


@query("preprint_documents", "A-9", """
SELECT '10.1101/' || doc_id AS doi, source AS title, length(source) + 2 AS abstract_start, '10.2/' || doc_id AS published_doi, NULL AS license, sha256(trim(source) || chr(10) || chr(10) || trim(text, ' ')) AS text_sha
FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0""")
def preprint_documents(t: Tables) -> DataFrame:
    docs, _ = literature.read_preprints(t.spark, exports.preprint_json(t), pins(t))
    return docs.select("doi", "title", F.get("sections", F.lit(1))["start"].alias("abstract_start"), "published_doi", "license", F.sha2("canonical_text", 256).alias("text_sha"))


@query("preprint_coverage", "A-9 D-18", """
SELECT '10.1101/' || doc_id AS doi, '10' AS version, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS found, CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'complete_for_query' END AS completion,
  CASE WHEN doc_id % 5 = 0 THEN 'pinned version 10 not uniquely present' END AS failure_reason FROM documents WHERE doc_id % 3 = 0""")
def preprint_coverage(t: Tables) -> DataFrame:
    return literature.read_preprints(t.spark, exports.preprint_json(t), pins(t))[1]


@query("trial_rows", "A-10", """
SELECT 'NCT' || o_orderkey AS study, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 <> 0 THEN 'INTERVENTIONAL' ELSE 'not stated' END AS design, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS status_date, c_mktsegment || ',' || o_orderpriority AS conditions
FROM orders JOIN customer ON c_custkey = o_custkey""")
def trial_rows(t: Tables) -> DataFrame:
    return registries.read_trials(t.spark, exports.trial_json(t)).select(
        "study", "title", "design", "status", "status_date", F.array_join("conditions", ",").alias("conditions"))


@query("trial_conditions", "A-10", """
SELECT 'NCT' || o_orderkey AS study, condition, 'disease:' || condition AS disease FROM (SELECT o_orderkey, unnest([c_mktsegment, o_orderpriority]) AS condition FROM orders JOIN customer ON c_custkey = o_custkey) WHERE condition IN ('BUILDING', '1-URGENT')""")
def trial_conditions(t: Tables) -> DataFrame:
    known = t.customer.select(F.col("c_mktsegment").alias("condition")).unionByName(t.orders.select(F.col("o_orderpriority").alias("condition"))).distinct()
    known = known.filter(F.col("condition").isin("BUILDING", "1-URGENT")).withColumn("disease", F.concat(F.lit("disease:"), "condition"))
    return registries.trial_conditions(registries.read_trials(t.spark, exports.trial_json(t)), known)


PROJECT_SQL = """o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey)"""


def projects(t: Tables):
    symbols = t.customer.select(F.col("c_mktsegment").alias("symbol")).distinct().withColumn("gene", F.concat(F.lit("gene:"), "symbol"))
    rows, coverage = registries.read_projects(t.spark, exports.project_json(t))
    return registries.project_graph(rows, symbols), coverage


@query("project_nodes", "A-11 H-17", f"""WITH {PROJECT_SQL}
SELECT 'study:P' || o_orderkey AS id, 'study' AS type, 'Study of ' || c_mktsegment || CASE WHEN o_orderkey % 4 = 0 THEN 'S' ELSE '' END AS label FROM o
UNION ALL SELECT DISTINCT 'org:' || substr(sha256(to_json({{key: CAST(c_nationkey AS VARCHAR)}})), 1, 32), 'organization', 'University Of Nation-' || c_nationkey FROM o
UNION ALL SELECT 'org:funder-' || lower(substr(o_orderpriority, 3, 2)), 'organization', min(o_orderpriority) FROM o GROUP BY 1
UNION ALL SELECT DISTINCT 'person:' || o_custkey, 'person', c_name FROM o""")
def project_nodes(t: Tables) -> DataFrame:
    return projects(t)[0][0]


@query("project_edges", "A-11 F-8", f"""WITH {PROJECT_SQL}, e AS (SELECT *, 'org:' || substr(sha256(to_json({{key: CAST(c_nationkey AS VARCHAR)}})), 1, 32) AS org FROM o)
SELECT org AS subject, 'owns_or_runs' AS predicate, 'study:P' || o_orderkey AS object FROM e UNION ALL SELECT 'org:funder-' || lower(substr(o_orderpriority, 3, 2)), 'funds', 'study:P' || o_orderkey FROM e
UNION ALL SELECT 'person:' || o_custkey, 'investigator_on', 'study:P' || o_orderkey FROM e UNION ALL SELECT DISTINCT 'person:' || o_custkey, 'professional_at', org FROM e WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'study:P' || o_orderkey, 'mentions', 'gene:' || c_mktsegment FROM e WHERE o_orderkey % 4 <> 0""")
def project_edges(t: Tables) -> DataFrame:
    return projects(t)[0][1]


@query("project_coverage", "A-11 D-20", """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'capped' ELSE 'complete_for_query' END AS completion, count(*) AS captures FROM orders GROUP BY 1""")
def project_coverage(t: Tables) -> DataFrame:
    return projects(t)[1].groupBy("completion").agg(F.count("*").alias("captures"))


def gene_rows(t: Tables):
    symbols = t.part.select(F.concat_ws("/", "p_name", "p_brand").alias("symbol")).distinct().unionByName(
        t.region.select(F.col("r_name").alias("symbol")))
    return registries.read_genes(t.spark, exports.gene_json(t), symbols)


@query("gene_aliases", "A-12", """
WITH g AS (SELECT min(p_partkey) AS k, p_name || '/' || p_brand AS symbol, min(p_type) AS name FROM part GROUP BY 2 HAVING count(*) = 1)
SELECT 'HGNC:' || k AS hgnc_id, symbol AS alias, 'symbol' AS alias_type FROM g UNION ALL SELECT 'HGNC:' || k, 'A' || k, 'alias_symbol' FROM g UNION ALL SELECT 'HGNC:' || k, name, 'exact_synonym' FROM g""")
def gene_aliases(t: Tables) -> DataFrame:
    return gene_rows(t)[1]


@query("gene_coverage", "A-12 D-18", """
WITH s AS (SELECT p_name || '/' || p_brand AS symbol, count(*) AS found FROM part GROUP BY 1 UNION ALL SELECT r_name, 0 FROM region)
SELECT symbol, found, CASE WHEN found = 1 THEN 'complete_for_query' ELSE 'partial' END AS completion, CASE WHEN found <> 1 THEN 'expected exactly one approved symbol, found ' || found END AS failure_reason FROM s""")
def gene_coverage(t: Tables) -> DataFrame:
    return gene_rows(t)[2]


DIRECTORY_SQL = f"""r AS (SELECT page_id, {HOST_SQL} AS domain, CASE WHEN page_id % 32 < 25 THEN 'nation:' || (page_id % 32) WHEN page_id % 32 < 27 THEN 'region:0' END AS disease FROM pages),
sel AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey < 10 UNION SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey < 10)"""


def directory(t: Tables):
    names = unique_names(
        t.nation.select(words_only(F.col("n_name")).alias("name"), F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
        .unionByName(t.region.select(words_only(F.col("r_name")).alias("name"), F.concat(F.lit("region:"), "r_regionkey").alias("id"))))
    edges = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"), F.lit(0).alias("pos"))
    selected = t.nation.filter("n_nationkey < 10").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    broader = graph.shortest_chains(edges, selected.withColumnRenamed("id", "start")).select(F.col("ancestor").alias("id")).distinct()
    return registries.directory_matches(registries.read_directory(t.spark, exports.directory_json(t)), names, selected, broader)


@query("directory_matches", "A-13 C-11 J-2", f"""WITH {DIRECTORY_SQL}
SELECT domain, disease, count(*) AS records, min('Org ' || page_id) AS organization FROM r WHERE disease IN (SELECT id FROM sel) GROUP BY 1, 2""")
def directory_matches(t: Tables) -> DataFrame:
    return directory(t)[0]


@query("directory_unmatched", "A-13", f"WITH {DIRECTORY_SQL} SELECT 'Org ' || page_id AS organization FROM r WHERE disease IS NULL OR disease NOT IN (SELECT id FROM sel)")
def directory_unmatched(t: Tables) -> DataFrame:
    return directory(t)[1].select("organization")


# ---- pages, records and captures ---------------------------------------------------------------------------------

PAGE_PIECES_SQL = rf"""WITH t AS (SELECT page_id, {page_text_sql()} || chr(10) AS x FROM {PAGES_SQL}),
p AS (SELECT page_id, length(x) AS chars, unnest(regexp_extract_all(x, '[^\n]+(?:\n[^\n]+)*|\n+')) AS piece, generate_subscripts(regexp_extract_all(x, '[^\n]+(?:\n[^\n]+)*|\n+'), 1) AS i FROM t),
o AS (SELECT *, piece[1] <> chr(10) AS body, sum(length(piece)) OVER w AS stop, count(*) FILTER (piece[1] <> chr(10)) OVER w AS n FROM p WINDOW w AS (PARTITION BY page_id ORDER BY i))"""


@query("web_page_sections", "A-14 H-10", PAGE_PIECES_SQL + " SELECT page_id, 'paragraph ' || n AS label, CAST(stop - length(piece) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM o WHERE body")
def web_page_sections(t: Tables) -> DataFrame:
    return captures.web_page_sections(t.pages)


@query("web_pages", "A-14 H-10", PAGE_PIECES_SQL + " SELECT page_id, any_value(chars) AS chars, count(*) FILTER (body) AS sections FROM o GROUP BY 1")
def web_pages(t: Tables) -> DataFrame:
    return captures.web_pages(t.pages).select("page_id", F.length("canonical_text").alias("chars"), "sections")


@query("strict_records", "A-15", """
SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events WHERE event_id % 100 NOT IN (3, 5, 7)""")
def strict_records(t: Tables) -> DataFrame:
    ok, _ = records.read_strict(t.spark, exports.event_jsonl(t), EVENT_DDL)
    return ok.drop("line_no")


EVENT_DDL = "event_id bigint, user_id bigint, event_type string, value double"


@query("strict_schema_problems", "D-2 A-15", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 100 WHEN 3 THEN 'unknown keys: surprise' WHEN 5 THEN 'wrong type of user_id' ELSE 'absent keys: value' END AS problem FROM events WHERE event_id % 100 IN (3, 5, 7)""")
def strict_schema_problems(t: Tables) -> DataFrame:
    _, problems = records.read_strict(t.spark, exports.event_jsonl(t), EVENT_DDL)
    return problems.select(F.get_json_object("value", "$.event_id").alias("event_id"), "problem")


@query("verified_captures", "A-16", "SELECT item_id AS key, CASE WHEN item_id % 10 = 3 THEN 'SHA-256 differs' END AS problem FROM benchmark WHERE item_id % 7 <> 5")
def verified_captures(t: Tables) -> DataFrame:
    path, manifest = exports.capture_files(t)
    ok, bad = records.verified_files(t.spark, path, [manifest.filter("key % 2 = 0"), manifest.filter("key % 2 = 1")])
    return ok.select("key", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("key", "problem"))


@query("capture_index", "A-18", """
SELECT user_id || ':' || event_type AS key, max(event_id) AS entry, max_by(value, event_id) AS value FROM events GROUP BY 1""")
def capture_index(t: Tables) -> DataFrame:
    log = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("entry"), "value")
    return records.capture_index(log, "key", "entry")


IMPORT_EDGES_SQL = """
SELECT 'org:' || s_suppkey AS subject, 'serves' AS predicate, o AS object, count(*) AS n FROM (SELECT s_suppkey, unnest(['nation:' || s_nationkey, 'nation:all']) AS o, unnest([1, 2]) AS _ FROM supplier), (VALUES (1), (2)) GROUP BY 1, 3
UNION ALL SELECT 'org:' || (p_partkey % 10), 'owns_or_runs', 'asset:' || p_partkey, 1 FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT 'asset:' || p_partkey, 'asset_for_context', 'nation:' || (p_size - 1), 1 FROM part WHERE p_size <= 25
UNION ALL SELECT 'NCT' || o_orderkey, 'studies', 'customer:' || o_custkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'person:' || c_custkey, 'professional_at', 'org:' || (c_custkey % 10), 1 FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'person:' || c_custkey, 'works_on', 'nation:' || c_nationkey, 1 FROM customer"""


def normalized_imports(t: Tables):
    contexts = t.nation.select(F.concat(F.lit("ctx:"), F.col("n_nationkey") + 1).alias("context"), F.concat(F.lit("nation:"), "n_nationkey").alias("target"))
    return imports.normalize_imports(imports.read_imports(t.spark, exports.import_json(t)), contexts)


@query("import_edges", "A-20", IMPORT_EDGES_SQL)
def import_edges(t: Tables) -> DataFrame:
    return normalized_imports(t)[1].groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@query("import_problems", "A-20", """
SELECT 'asset:' || p_partkey AS id, 'ownership needs its own source support' AS problem FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 6 <> 0
UNION ALL SELECT 'asset:' || p_partkey, 'unknown context ctx:' || p_size FROM part WHERE p_size > 25""")
def import_problems(t: Tables) -> DataFrame:
    return normalized_imports(t)[2]


@query("reference_bundle", "N-14", """
WITH res AS (SELECT p.p_partkey AS id, CASE WHEN p.p_size <= 40 THEN p.p_partkey WHEN n.p_size <= 40 THEN n.p_partkey END AS term FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1),
pos AS (SELECT DISTINCT l_suppkey, term FROM lineitem JOIN res ON id = l_partkey WHERE l_suppkey % 2 = 0 AND l_linestatus = 'F' AND l_returnflag <> 'R' AND term IS NOT NULL),
c AS (SELECT term, count(*) AS n FROM pos GROUP BY 1)
SELECT 'part:' || p_partkey AS term, n, round(-ln(n / (SELECT count(DISTINCT l_suppkey) FROM pos)), 6) + 0.0 AS ic FROM part LEFT JOIN c ON term = p_partkey""")
def reference_bundle(t: Tables) -> DataFrame:
    """Ontology and annotations from files, release pinned, then information content per term."""
    terms, release = ontology.read_obo(t.spark, exports.obo(t))
    rows, _ = annotations.read_annotations(t.spark, exports.annotation_lines(t))
    found = annotations.reference_terms(captures.pinned(terms, release, "2026-01-01"), rows)
    return found.select("term", "n", (F.round("ic", 6) + F.lit(0.0)).alias("ic"))


@query("reference_without_annotations", "N-14", "SELECT 'part:' || p_partkey AS term, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS ic FROM part")
def reference_without_annotations(t: Tables) -> DataFrame:
    """The same release when its annotations could not be captured: all terms, no information content."""
    terms, release = ontology.read_obo(t.spark, exports.obo(t))
    return annotations.reference_terms(captures.pinned(terms, release, "2026-01-01"), None).select("term", "n", "ic")


# ---- sinks -------------------------------------------------------------------------------------------------------

@query("canonical_jsonl", "B-1", """SELECT to_json({o_custkey: o_custkey, o_orderkey: o_orderkey, o_orderpriority: CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END, o_orderstatus: o_orderstatus}) AS value FROM orders""")
def canonical_jsonl(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("o_orderpriority"))
    sinks.write_jsonl(rows, path, "o_orderkey")
    return t.spark.read.text(path)


@query("stage_part", "B-2", "SELECT 'entities' AS kind, count(*) AS n FROM part UNION ALL SELECT 'assertions', count(*) FROM lineitem WHERE l_returnflag = 'A'")
def stage_part(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "part")
    sinks.write_part({"entities": t.part.unionByName(t.part), "assertions": t.lineitem}, path)  # an earlier run, to be replaced as a whole
    sinks.write_part({"entities": t.part, "assertions": t.lineitem.filter("l_returnflag = 'A'")}, path)
    return t.spark.read.parquet(f"{path}/entities").agg(F.count("*").alias("n")).select(F.lit("entities").alias("kind"), "n").unionByName(
        t.spark.read.parquet(f"{path}/assertions").agg(F.count("*").alias("n")).select(F.lit("assertions").alias("kind"), "n"))


CONTENT = {n: SNAPSHOT[n] for n in ("nation", "supplier", "customer", "part", "orders")}
KEYS = {"nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}


def content(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n).select(*c) for n, c in CONTENT.items()}


@query("flattened_rows", "B-5", """
SELECT 'claim:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'supplier:' || l_suppkey AS subject_id, 'part:' || l_partkey AS object_id,
  to_json({id: 'claim:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, object_id: 'part:' || l_partkey, status: l_linestatus, subject_id: 'supplier:' || l_suppkey}) AS payload_record FROM lineitem""")
def flattened_rows(t: Tables) -> DataFrame:
    key = F.concat_ws(":", F.lit("claim"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    record = F.struct(key.alias("id"), F.concat(F.lit("part:"), "l_partkey").alias("object_id"), F.col("l_linestatus").alias("status"),
                      F.concat(F.lit("supplier:"), "l_suppkey").alias("subject_id"))
    rows = sinks.flatten_rows(t.lineitem.select(record.alias("record")), {"id": "record.id", "subject_id": "record.subject_id", "object_id": "record.object_id"})
    return rows.select("id", "subject_id", "object_id", F.get_json_object("payload", "$.record").alias("payload_record"))


@query("published_snapshot", "B-3 B-4 A-19 D-19", " UNION ALL ".join(
    f"SELECT table_name, row_count, table_sha, 'published,unchanged' AS outcomes, 0 AS problems, 0 AS count_problems FROM ({hash_sql(n, c)})" for n, c in CONTENT.items()))
def published_snapshot(t: Tables) -> DataFrame:
    """Publish, publish the same content again in another order, load the pinned snapshot and validate it."""
    store = sinks.Store(t.spark, scratch_path(t.spark, "store"))
    snapshot, first = store.publish(content(t))
    again = {n: df.repartition(3) for n, df in content(t).items()}
    _, second = store.publish(again)
    loaded = records.read_snapshot(t.spark, store.base, snapshot, list(CONTENT))
    problems = sinks.load_problems(t.spark, store.base, snapshot, KEYS)
    wrong_counts = records.count_problems(loaded, store.commits().filter(F.col("snapshot") == snapshot))
    _, hashes = sinks.package(loaded)
    return hashes.withColumn("outcomes", F.lit(f"{first},{second}")).withColumn("problems", F.lit(problems.count())).withColumn("count_problems", F.lit(wrong_counts.count()))
