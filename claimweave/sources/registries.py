"""JSON registries: trials, funded projects, genes and organization directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.identity import stable_id
from claimweave.functions.text import title_case, words_only
from claimweave.functions.web import domain
from claimweave.operators.quality import exactly_one
from claimweave.operators.text_joins import symbol_mentions
from claimweave.operators.windows import first_per_key
from claimweave.sources.lines import number_rows

STUDY = """protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>,
 statusModule: struct<overallStatus: string, statusVerifiedDate: string, lastUpdatePostDateStruct: struct<date: string>>,
 designModule: struct<studyType: string>, conditionsModule: struct<conditions: array<string>, keywords: array<string>>>"""


def read_trials(spark: SparkSession, path: str, search_pages: bool = True, multi_line: bool = False) -> DataFrame:
    """(study, title, design, status, status_date, release, conditions, keywords); the first of several captures wins.

    A record without an id fails the job.
    """
    schema = f"studies array<struct<{STUDY.replace(' struct', ': struct', 1)}>>" if search_pages else STUDY
    raw = number_rows(spark.read.schema(schema).option("multiLine", multi_line).json(path)).withColumn("_seen", F.struct("file", "line_no"))
    s = raw.withColumn("_pos", F.lit(0))
    if search_pages:
        s = raw.select("_seen", F.posexplode("studies").alias("_pos", "s")).select("_seen", "_pos", "s.protocolSection")
    p = F.col("protocolSection")
    nct = p["identificationModule"]["nctId"]
    rows = s.select(
        F.coalesce(nct, F.raise_error(F.lit("trial record lacks an id")).cast("string")).alias("study"),
        F.coalesce(p["identificationModule"]["briefTitle"], nct).alias("title"),
        F.coalesce(p["designModule"]["studyType"], F.lit("not stated")).alias("design"),
        F.coalesce(p["statusModule"]["overallStatus"], F.lit("not stated")).alias("status"),
        p["statusModule"]["statusVerifiedDate"].alias("status_date"), p["statusModule"]["lastUpdatePostDateStruct"]["date"].alias("release"),
        p["conditionsModule"]["conditions"].alias("conditions"), p["conditionsModule"]["keywords"].alias("keywords"), "_seen", "_pos")
    return first_per_key(rows, ["study"], ["_seen", "_pos"]).drop("_seen", "_pos")


def trial_conditions(trials: DataFrame, condition_map: DataFrame) -> DataFrame:
    """(study, condition, disease) through a supplied (condition, disease) map only."""
    return trials.select("study", F.explode("conditions").alias("condition")).join(condition_map, "condition").select("study", "condition", "disease")


PROJECTS = """results array<struct<appl_id: string, project_num: string, fiscal_year: string, project_title: string, abstract_text: string,
 is_active: boolean, award_amount: string, project_start_date: string, project_end_date: string,
 organization: struct<org_name: string, external_org_id: string>, agency_ic_admin: struct<abbreviation: string, name: string>,
 principal_investigators: array<struct<profile_id: string, full_name: string, is_contact_pi: boolean>>>>,
 meta struct<total: bigint, limit: bigint>"""


def read_projects(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(projects, coverage): each application once, and whether a capture was cut off."""
    raw = number_rows(spark.read.schema(PROJECTS).option("multiLine", multi_line).json(path))
    coverage = raw.select(
        "meta.total", "meta.limit", F.size("results").alias("returned"),
        F.when(F.col("meta.total") > F.col("meta.limit"), "capped").otherwise("complete_for_query").alias("completion"))
    rows = raw.withColumn("_seen", F.struct("file", "line_no")).select("_seen", F.posexplode("results").alias("_pos", "r")).select("_seen", "_pos", "r.*")
    return first_per_key(rows, ["appl_id"], ["_seen", "_pos"]).drop("_seen", "_pos"), coverage


def project_graph(projects: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of funded projects; a person needs a source-assigned id, a mention only says the text names a symbol.

    ``symbols``: (symbol, gene).
    """
    def clean(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    title, abstract = clean("project_title"), clean("abstract_text")
    p = projects.withColumn("study", F.concat(F.lit("study:"), F.coalesce("project_num", "appl_id"))).withColumn(
        "org_name", clean("organization.org_name")).withColumn(
        "text", F.when(abstract != "", F.concat(title, F.lit("\n\n"), abstract)).otherwise(title))
    p = p.withColumn("org", F.when(F.col("org_name") != "", stable_id("org", key=F.coalesce("organization.external_org_id", "org_name"))))
    p = p.withColumn("funder", F.when(F.col("agency_ic_admin.abbreviation") != "", F.concat(F.lit("org:funder-"), F.lower("agency_ic_admin.abbreviation"))))
    people = p.select("study", "org", F.explode("principal_investigators").alias("i")).filter("i.profile_id is not null").withColumn(
        "person", F.concat(F.lit("person:"), "i.profile_id"))
    mentions = symbol_mentions(p.select("study", "text"), symbols, "study", "text").join(symbols, "symbol")

    def node(df: DataFrame, id_: str, kind: str, label: Column) -> DataFrame:
        return df.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(F.lit(kind).alias("type"), F.min(label).alias("label"))

    def edge(df: DataFrame, s: str, predicate: str, o: str) -> DataFrame:
        return df.filter(F.col(s).isNotNull() & F.col(o).isNotNull()).select(
            F.col(s).alias("subject"), F.lit(predicate).alias("predicate"), F.col(o).alias("object")).distinct()

    nodes = (
        node(p, "study", "study", F.coalesce(F.nullif(title, F.lit("")), "study"))
        .unionByName(node(p, "org", "organization", title_case(F.col("org_name"))))
        .unionByName(node(p, "funder", "organization", F.coalesce("agency_ic_admin.name", "agency_ic_admin.abbreviation")))
        .unionByName(node(people, "person", "person", F.coalesce(F.nullif(F.trim("i.full_name"), F.lit("")), "person"))))
    edges = (
        edge(p, "org", "owns_or_runs", "study").unionByName(edge(p, "funder", "funds", "study"))
        .unionByName(edge(people, "person", "investigator_on", "study"))
        .unionByName(edge(people.filter("i.is_contact_pi"), "person", "professional_at", "org"))
        .unionByName(edge(mentions, "study", "mentions", "gene")))
    return nodes, edges


GENES = """response struct<docs: array<struct<hgnc_id: string, symbol: string, name: string, alias_symbol: array<string>,
 prev_symbol: array<string>, date_modified: string>>>"""


def read_genes(spark: SparkSession, path: str, symbols: DataFrame, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, aliases, coverage): a symbol needs exactly one record that carries it exactly."""
    docs = spark.read.schema(GENES).option("multiLine", multi_line).json(path).select(F.inline("response.docs"))
    hits = docs.join(symbols.select("symbol"), "symbol", "left_semi")
    n = exactly_one(hits, "symbol")
    coverage = symbols.select("symbol").distinct().join(n, "symbol", "left").select(
        "symbol", F.coalesce("n", F.lit(0)).alias("found"), F.coalesce("completion", F.lit("partial")).alias("completion"),
        F.when(F.coalesce("n", F.lit(0)) != 1, F.format_string("expected exactly one approved symbol, found %d", F.coalesce("n", F.lit(0)))).alias("failure_reason"))
    genes = hits.join(n.filter("n = 1").select("symbol"), "symbol", "left_semi")
    none = F.array().cast("array<string>")

    def typed(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("alias"), F.lit(kind).alias("alias_type")))

    every = F.concat(typed(F.array("symbol"), "symbol"), typed(F.coalesce("alias_symbol", none), "alias_symbol"),
                     typed(F.coalesce("prev_symbol", none), "previous_symbol"), typed(F.array_compact(F.array("name")), "exact_synonym"))
    return genes.select("hgnc_id", "symbol", "name", "date_modified"), genes.select("hgnc_id", F.inline(every)), coverage


DIRECTORY = """organization_name string, disease_or_gene string, related_disease string, related_diseases array<string>,
 website_url string, contact_website string, product_page_url string"""


def read_directory(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Both directory layouts as (record, organization, site, fields)."""
    raw = number_rows(spark.read.schema(DIRECTORY).option("multiLine", multi_line).json(path))
    none = F.array().cast("array<string>")
    fields = F.concat(F.array_compact(F.array("disease_or_gene", "related_disease")), F.array_compact(F.coalesce("related_diseases", none)))
    return raw.select(
        F.concat_ws("#", "file", F.col("line_no").cast("string")).alias("record"), F.col("organization_name").alias("organization"),
        F.trim(F.coalesce(F.nullif("website_url", F.lit("")), "contact_website", F.lit(""))).alias("site"),
        F.filter(F.transform(fields, lambda f: F.trim(f)), lambda f: f != "").alias("fields"))


def directory_matches(records: DataFrame, names: DataFrame, selected: DataFrame, broader: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, unmatched): directory rows whose field equals a unique name of a selected disease or of a broader class.

    ``names``: (name, id) unique ones; ``selected``: (id); ``broader``: (id) classes of selected diseases. Matches are
    (domain, disease, organization, records), merged by website domain.
    """
    wanted = selected.select("id").unionByName(broader.select("id")).distinct()
    keys = names.filter("id is not null").join(wanted, "id", "left_semi")
    usable = records.filter("site <> '' and organization <> ''")
    hit = usable.select("record", "organization", "site", F.explode("fields").alias("f")).withColumn("name", words_only(F.col("f"))).join(keys, "name")
    merged = hit.withColumn("domain", domain(F.col("site"))).groupBy("domain", F.col("id").alias("disease")).agg(
        F.count_distinct("record").alias("records"), F.min("organization").alias("organization"))
    return merged, records.join(hit.select("record"), "record", "left_anti")
