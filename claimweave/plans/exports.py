"""Driver tables written by Spark in the formats the readers expect, so that scans work on data that grows with them."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.vocab import GRAPH_ALT_ID, GRAPH_REPLACED_BY, OBO_IRI
from claimweave.plans.catalogue import Tables
from claimweave.plans.filters import association_type
from claimweave.session import scratch_path


def put(df: DataFrame, name: str, **options: str) -> str:
    """Write a one-column frame as text files below the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).text(path)
    return path


def put_json(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(ignoreNullFields=True, **options).json(path)
    return path


def with_head(df: DataFrame, head: list[str], order: Column) -> DataFrame:
    """Lines of every file preceded by the same head: rows are ranged by ``order`` and the head joins each file's first line."""
    ranged = df.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o")
    first = (F.monotonically_increasing_id() % (1 << 33)) == 0
    return ranged.select(F.when(first, F.concat(F.lit("\n".join(head) + "\n"), "value")).otherwise(F.col("value")).alias("value"))


def obo(t: Tables) -> str:
    k = F.col("p_partkey").cast("string")
    lines = F.array_compact(F.array(
        F.lit("[Term]"), F.concat(F.lit("id: part:"), k), F.concat(F.lit("name: "), "p_name"), F.concat(F.lit("alt_id: alt:"), k),
        F.concat(F.lit('synonym: "'), "p_brand", F.lit(' \\"b\\"" EXACT []')), F.concat(F.lit('synonym: "'), "p_type", F.lit('" BROAD [x:1]')),
        F.concat(F.lit("is_a: brand:"), "p_brand", F.lit(" ! some brand")), F.concat(F.lit("is_a: type:"), "p_type"),
        F.when(F.col("p_size") > 40, "is_obsolete: true"), F.when(F.col("p_size") > 40, F.concat(F.lit("replaced_by: part:"), F.col("p_partkey") + 1)),
        F.concat(F.lit("xref: OMIM:"), "p_size", F.lit(' {source="m"}')), F.lit("subset: demo extra"), F.lit("")))
    typedef = F.concat(F.lit("[Typedef]\nid: rel:"), k, F.lit("\nname: not a term\n"))
    stanza = F.concat(F.array_join(lines, "\n"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("\n"), typedef)).otherwise(F.lit("")))
    head = ["format-version: 1.2", "data-version: hp/releases/2026-01-01", "! comment", ""]
    return put(with_head(t.part.select("p_partkey", stanza.alias("value")), head, F.col("p_partkey")), "obo")


def obographs(t: Tables, per_file: int = 500) -> str:
    """One JSON document per ``per_file`` parts."""
    iri = lambda c: F.concat(F.lit(OBO_IRI + "HP_"), c)
    pair = lambda p, v: F.struct(F.lit(p).alias("pred"), v.alias("val"))
    k = F.col("p_partkey").cast("string")
    prefix = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit(OBO_IRI + "GO_"), k)).otherwise(iri(k))
    node = F.struct(
        prefix.alias("id"), F.col("p_name").alias("lbl"), F.when(F.col("p_partkey") % 11 == 0, "PROPERTY").otherwise("CLASS").alias("type"),
        F.struct((F.col("p_size") > 40).alias("deprecated"), F.array(pair("hasExactSynonym", F.col("p_brand")), pair("hasOther", F.col("p_type"))).alias("synonyms"),
                 F.array(pair(GRAPH_ALT_ID, F.concat(F.lit("HP:alt"), k)), pair(GRAPH_REPLACED_BY, iri((F.col("p_partkey") + 1).cast("string")))).alias("basicPropertyValues")).alias("meta"))
    edge = F.struct(prefix.alias("sub"), F.lit("is_a").alias("pred"), iri(F.concat(F.lit("b"), F.col("p_size"))).alias("obj"))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / per_file).alias("g")).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    meta = F.struct(F.lit("http://x/hp/releases/2026-02-02/hp.json").alias("version")).alias("meta")
    return put_json(docs.select(F.array(F.struct(meta, "nodes", "edges")).alias("graphs")), "obographs", maxRecordsPerFile=1)


ANNOTATION_HEAD = ["#description: demo annotations", "#version: 2026-03-03",
                   "#database_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration"]


def annotation_lines(t: Tables) -> str:
    cells = [
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "MIM:").otherwise("Orphanet:"), "l_suppkey"), F.concat(F.lit("Supplier "), "l_suppkey"),
        F.when(F.col("l_returnflag") == "R", "NOT").otherwise(""), F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("PMID:"), "l_orderkey"),
        F.lit("PCS"), F.lit(""), F.concat("l_linenumber", F.lit("/7")), F.lit(""), F.lit(""), F.when(F.col("l_linestatus") == "F", "P").otherwise("I"), F.lit("demo")]
    value = F.array_join(F.array(*[c.cast("string") for c in cells]), "\t")
    return put(with_head(t.lineitem.select("l_orderkey", value.alias("value")), ANNOTATION_HEAD, F.col("l_orderkey")), "annotations")


def mapping_lines(t: Tables) -> str:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("skos:exactMatch", "skos:broadMatch", "skos:relatedMatch", "skos:closeMatch", "other")]), (F.col("p_size") % 5 + 1).cast("int"))
    obj = F.concat(F.when(F.col("p_size") % 2 == 0, "Orphanet:").otherwise("MIM:"), "p_partkey")
    value = F.concat_ws("\t", F.concat(F.lit("part:"), "p_partkey"), "p_name", kind, obj, F.when(F.col("p_size") % 3 == 0, "semapv:Manual").otherwise(""))
    head = ["#mapping_set_id: demo", "# license: CC0", "#curie_map:", "subject_id\tsubject_label\tpredicate_id\tobject_id\tmapping_justification"]
    return put(with_head(t.part.select("p_partkey", value.alias("value")), head, F.col("p_partkey")), "sssom")


def submission_csv(t: Tables) -> str:
    path = scratch_path(t.spark, "submissions")
    rows = t.part.select(
        F.concat(F.lit("SGC-"), "p_partkey").alias("sgc_id"), F.concat(F.lit("HGNC:"), F.col("p_partkey") % 100).alias("gene_curie"),
        F.concat(F.lit("S"), F.col("p_partkey") % 100).alias("gene_symbol"), F.concat(F.lit("part:"), "p_partkey").alias("disease_curie"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\nsecond line')).alias("disease_title"),
        F.when(F.col("p_size") % 4 == 0, "Limited").otherwise("Definitive").alias("classification_title"), F.col("p_type").alias("moi_title"),
        F.col("p_brand").alias("submitter_title"))
    rows.repartitionByRange(3, "disease_curie").sortWithinPartitions("disease_curie").write.option("header", True).option("escape", '"').csv(path)
    return path


def gaf_lines(t: Tables) -> str:
    c = {2: F.concat(F.lit("S"), "l_suppkey"), 3: F.when(F.col("l_returnflag") == "R", "NOT|involved_in").otherwise("involved_in"),
         4: F.concat(F.lit("GO:"), "l_partkey"), 5: F.concat(F.lit("PMID:"), "l_orderkey"), 6: F.lit("IDA"),
         8: F.when(F.col("l_linestatus") == "F", "P").otherwise("F"), 14: F.lit("Demo")}
    full = F.array_join(F.array(*[c.get(i, F.lit("-")) for i in range(17)]), "\t")
    value = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("short\trow\t"), "l_orderkey")).otherwise(full)
    df = t.lineitem.select("l_orderkey", value.alias("value"))
    return put(with_head(df, ["!gaf-version: 2.2", "!comment"], F.col("l_orderkey")), "gaf", compression="gzip")


def escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def gene_disorder_xml(t: Tables) -> str:
    """Parts as disorders; two associations each, the second without a registry reference."""
    def association(symbol: Column, ref: Column, status: Column) -> Column:
        return F.concat(
            F.lit("<DisorderGeneAssociation><SourceOfValidation>PMID:"), F.col("p_partkey").cast("string"), F.lit("</SourceOfValidation><Gene><Symbol>"), symbol,
            F.lit("</Symbol><ExternalReferenceList><ExternalReference><Source>Ensembl</Source><Reference>E1</Reference></ExternalReference>"), ref,
            F.lit("</ExternalReferenceList></Gene><DisorderGeneAssociationType><Name>"), association_type(),
            F.lit("</Name></DisorderGeneAssociationType><DisorderGeneAssociationStatus><Name>"), status, F.lit("</Name></DisorderGeneAssociationStatus></DisorderGeneAssociation>"))

    hgnc = F.concat(F.lit("<ExternalReference><Source>HGNC</Source><Reference>"), F.col("p_size").cast("string"), F.lit("</Reference></ExternalReference>"))
    body = F.concat(
        F.lit("<Disorder><OrphaCode>"), F.col("p_partkey").cast("string"), F.lit("</OrphaCode><Name>"), escaped(F.concat("p_name", F.lit(" & co"))), F.lit("</Name><DisorderGeneAssociationList>"),
        association(F.col("p_brand"), hgnc, F.lit("Assessed")), association(F.col("p_type"), F.lit(""), F.lit("Not yet assessed")), F.lit("</DisorderGeneAssociationList></Disorder>"))
    df = t.part.select("p_partkey", body.alias("value"))
    # Readers look for row elements, so the closing tags of the lists are left out.
    ranged = with_head(df, ['<?xml version="1.0" encoding="UTF-8"?>', '<JDBOR date="2026-04-04" version="1">', "<DisorderList>"], F.col("p_partkey"))
    return put(ranged, "orphadata")


def article_xml(t: Tables) -> str:
    """Documents as articles: first line the title, inline markup in it, the whole text in one or two abstract parts."""
    head = escaped(F.get(F.split("text", "\n", 2), F.lit(0)))
    part1, part2 = escaped(F.substring("text", 1, 60)), escaped(F.substr("text", F.lit(61)))
    two = F.concat(F.lit('<AbstractText Label="AIM">'), part1, F.lit('</AbstractText><AbstractText>'), part2, F.lit(" <sup>x</sup></AbstractText>"))
    one = F.concat(F.lit("<AbstractText>"), escaped(F.col("text")), F.lit("</AbstractText>"))
    value = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), head, F.lit(" <i>in</i> vivo 🧬</ArticleTitle><Abstract>"),
        F.when(F.col("doc_id") % 2 == 0, two).otherwise(one),
        F.lit("</Abstract><Journal><Title>J "), F.col("source"), F.lit("</Title><JournalIssue><PubDate><Year>2024</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation>"
              '<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/'), F.col("doc_id").cast("string"),
        F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    df = t.documents.filter("doc_id % 10 <> 9").select("doc_id", F.regexp_replace(value, "\n", " ").alias("value"))
    return put(with_head(df, ["<PubmedArticleSet>"], F.col("doc_id")), "articles")


def preprint_json(t: Tables) -> str:
    def version(v: Column, published: Column) -> Column:
        return F.struct(F.concat(F.lit("10.1101/"), "doc_id").alias("doi"), F.col("source").alias("title"), v.alias("version"), F.lit("2024-01-01").alias("date"),
                        F.col("text").alias("abstract"), published.alias("published"), F.lit("NA").alias("license"), F.lit("medRxiv").alias("server"))

    versions = F.array(version(F.lit("9"), F.lit("NA")), version(F.lit("10"), F.concat(F.lit("10.2/"), "doc_id")), version(F.when(F.col("doc_id") % 5 == 0, "10").otherwise("11"), F.lit("")))
    return put_json(t.documents.select(versions.alias("collection")), "preprints")


def trial_json(t: Tables) -> str:
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    p = F.struct(
        F.struct(F.concat(F.lit("NCT"), "o_orderkey").alias("nctId"), F.concat(F.lit("Order "), "o_orderkey").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("o_orderstatus").alias("overallStatus"), F.date_format("o_orderdate", "yyyy-MM").alias("statusVerifiedDate")).alias("statusModule"),
        F.struct(F.when(F.col("o_orderkey") % 3 != 0, "INTERVENTIONAL").alias("studyType")).alias("designModule"),
        F.struct(F.array("c_mktsegment", "o_orderpriority").alias("conditions"), F.array(F.lit("kw")).alias("keywords")).alias("conditionsModule"))
    return put_json(o.select(F.array(F.struct(p.alias("protocolSection")), F.struct(p.alias("protocolSection"))).alias("studies")), "trials")


def project_json(t: Tables) -> str:
    """Orders as funded projects led by their customer; one capture per order, some cut off, titles naming a segment."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"), "o_custkey")
    pis = F.array(F.struct(F.col("o_custkey").cast("string").alias("profile_id"), F.col("c_name").alias("full_name"), (F.col("o_orderkey") % 2 == 0).alias("is_contact_pi")),
                  F.struct(F.lit(None).cast("string").alias("profile_id"), F.lit("No Id").alias("full_name"), F.lit(False).alias("is_contact_pi")))
    r = F.struct(
        F.col("o_orderkey").cast("string").alias("appl_id"), F.concat(F.lit("P"), "o_orderkey").alias("project_num"),
        F.concat(F.lit(" Study of "), "c_mktsegment", F.when(F.col("o_orderkey") % 4 == 0, "S").otherwise("")).alias("project_title"),
        F.when(F.col("o_orderkey") % 3 == 0, "abstract text").alias("abstract_text"), F.lit(True).alias("is_active"),
        F.struct(F.concat(F.lit("UNIVERSITY OF NATION-"), "c_nationkey").alias("org_name"), F.col("c_nationkey").cast("string").alias("external_org_id")).alias("organization"),
        F.struct(F.substring("o_orderpriority", 3, 2).alias("abbreviation"), F.col("o_orderpriority").alias("name")).alias("agency_ic_admin"), pis.alias("principal_investigators"))
    meta = F.struct(F.when(F.col("o_orderkey") % 10 == 0, 900).otherwise(1).alias("total"), F.lit(500).alias("limit"))
    return put_json(o.select(F.array(r, r).alias("results"), meta.alias("meta")), "projects")


def gene_json(t: Tables) -> str:
    doc = F.struct(F.concat(F.lit("HGNC:"), "p_partkey").alias("hgnc_id"), F.concat_ws("/", "p_name", "p_brand").alias("symbol"), F.col("p_type").alias("name"),
                   F.array(F.concat(F.lit("A"), "p_partkey")).alias("alias_symbol"), F.lit("2026-01-01").alias("date_modified"))
    return put_json(t.part.select(F.struct(F.array(doc).alias("docs")).alias("response")), "genes")


def directory_json(t: Tables) -> str:
    k = F.col("page_id") % 32
    name = F.when(k < 25, F.concat(F.lit("nation "), k)).when(k < 27, "Africa").otherwise("nowhere")
    odd = F.col("page_id") % 2 == 1
    return put_json(t.pages.select(
        F.concat(F.lit("Org "), "page_id").alias("organization_name"), F.when(~odd, name).alias("disease_or_gene"), F.when(odd, F.array(name, F.lit("other"))).alias("related_diseases"),
        F.when(~odd, F.col("url")).alias("website_url"), F.when(odd, F.col("url")).alias("contact_website")), "directory")


def event_jsonl(t: Tables) -> str:
    """Events as records with faults: an unknown key, a number as text, an absent key, and blank lines in between."""
    e = t.events.select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    text = F.to_json(F.struct("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value"))
    extra = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.lit(1).alias("surprise")))
    absent = F.to_json(F.struct("event_id", "user_id", "event_type"))
    k = F.col("event_id") % 100
    line = F.when(k == 3, extra).when(k == 5, text).when(k == 7, absent).when(k == 9, F.concat(good, F.lit("\n\n"))).otherwise(good)
    return put(e.select(line.alias("value")), "events")


def capture_files(t: Tables) -> tuple[str, DataFrame]:
    """Benchmark texts as one file each, with a manifest that records some wrong hashes and a failed capture."""
    path = scratch_path(t.spark, "captures")
    rows = t.benchmark.select("item_id", F.regexp_replace("text", "\n", " ").alias("value"))
    named = rows.select("item_id", F.concat(F.lit("c"), F.pmod("item_id", F.lit(8)), F.lit("/"), "item_id", F.lit(".txt")).alias("path"), "value")

    def put_files(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                store.create_dir(f"{root}/{name.rsplit('/', 1)[0]}")
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(value.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named.select("path", "value").mapInArrow(put_files, "n bigint").agg(F.sum("n")).collect()
    sha = F.sha2(F.concat("value", F.lit("\n")), 256)
    manifest = named.select(
        F.col("item_id").alias("key"), "path", F.when(F.col("item_id") % 10 == 3, F.sha2("value", 256)).otherwise(sha).alias("sha256"), (F.col("item_id") % 7 != 5).alias("ok"))
    return path, manifest


def import_json(t: Tables) -> str:
    """Suppliers as organizations, parts as assets, orders as studies, customers as people."""
    base = scratch_path(t.spark, "imports")
    evidence = lambda key: F.array(F.struct(F.concat(F.lit("doc:"), key).alias("source_document_id"), F.lit("row").alias("record_locator")))
    none = F.array().cast("array<struct<source_document_id:string,record_locator:string>>")
    orgs = t.supplier.select(
        F.concat(F.lit("org:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("https://x").alias("official_url"),
        F.array(F.concat(F.lit("nation:"), "s_nationkey"), F.lit("nation:all")).alias("served_disease_ids"),
        F.concat(evidence(F.col("s_suppkey")), evidence(F.lit("x"))).alias("serves_evidence"))
    owned = F.col("p_partkey") % 3 == 0
    assets = t.part.select(
        F.concat(F.lit("asset:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("registry").alias("kind"),
        F.when(owned, F.concat(F.lit("org:"), F.col("p_partkey") % 10)).alias("owner_organization_id"), F.when(owned, F.lit("owns")).alias("ownership_relation"),
        F.when(F.col("p_partkey") % 6 == 0, evidence(F.col("p_partkey"))).otherwise(none).alias("ownership_evidence"),
        F.array(F.concat(F.lit("ctx:"), "p_size")).alias("target_context_ids"), evidence(F.col("p_partkey")).alias("scope_evidence"), F.col("p_type").alias("population_scope"))
    studies = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("NCT"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit("registry").alias("design"),
        F.array(F.concat(F.lit("customer:"), "o_custkey")).alias("disease_ids"), evidence(F.col("o_orderkey")).alias("evidence"))
    people = t.customer.select(
        F.concat(F.lit("person:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("https://p").alias("profile_url"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("org:"), F.col("c_custkey") % 10)).alias("organization_id"), evidence(F.col("c_custkey")).alias("affiliation_evidence"),
        F.array(F.concat(F.lit("nation:"), "c_nationkey")).alias("work_entity_ids"), evidence(F.col("c_custkey")).alias("work_evidence"))
    for kind, df in (("organizations", orgs), ("assets", assets), ("studies", studies), ("people", people)):
        df.write.json(f"{base}/{kind}")
    return base
