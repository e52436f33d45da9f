"""XML and JSON sources of associations, articles and preprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import line_endings, missing_to_null
from claimweave.operators.quality import exactly_one

ASSOCIATIONS = """OrphaCode string, Name string, DisorderGeneAssociationList struct<DisorderGeneAssociation: array<struct<
 SourceOfValidation: string,
 Gene: struct<Symbol: string, ExternalReferenceList: struct<ExternalReference: array<struct<Source: string, Reference: string>>>>,
 DisorderGeneAssociationType: struct<Name: string>, DisorderGeneAssociationStatus: struct<Name: string>>>>"""


def read_gene_disorders(spark: SparkSession, path: str, symbols: DataFrame | None = None) -> DataFrame:
    """One row per gene-disorder association, with the registry id taken from the reference list by source name."""
    rows = spark.read.format("xml").schema(ASSOCIATIONS).option("rowTag", "Disorder").load(path)
    a = rows.select("OrphaCode", "Name", F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a"))
    refs = F.filter("a.Gene.ExternalReferenceList.ExternalReference", lambda r: r["Source"] == "HGNC")
    number = F.get(refs, F.lit(0))["Reference"]
    blank = F.lit("")
    out = a.select(
        F.col("OrphaCode").alias("orpha_code"), F.coalesce("Name", blank).alias("disorder_name"), F.col("a.Gene.Symbol").alias("gene_symbol"),
        F.concat(F.lit("HGNC:"), number).alias("gene_hgnc"), F.coalesce("a.DisorderGeneAssociationType.Name", blank).alias("association_type"),
        F.coalesce("a.DisorderGeneAssociationStatus.Name", blank).alias("association_status"),
        F.coalesce("a.SourceOfValidation", blank).alias("source_of_validation"))
    if symbols is None:
        return out
    return out.join(symbols.select(F.col("symbol").alias("gene_symbol")), "gene_symbol", "left_semi")


def gene_disorder_release(spark: SparkSession, path: str) -> DataFrame:
    """(release): the date attribute of the root element, found without parsing the document."""
    dated = F.regexp_extract("value", r'<JDBOR\b[^>]*\bdate="([^"]*)"', 1)
    return spark.read.text(path).select(dated.alias("release")).filter("release <> ''").distinct()


ARTICLES = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: string,
 Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>>>,
 PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"""


def inner_text(markup: Column) -> Column:
    """Element content without inline tags, the five predefined entities resolved."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return line_endings(F.trim(F.regexp_replace(out, r"^\s+|\s+$", "")))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, canonical_text, sections, doi, year, journal). Sections carry label and half-open offsets."""
    raw = spark.read.format("xml").schema(ARTICLES).option("rowTag", "PubmedArticle").option("attributePrefix", "_").load(path)
    art = raw.filter("trim(MedlineCitation.PMID) <> ''").select(F.col("MedlineCitation.Article").alias("x"), "*")
    title = F.coalesce(inner_text(F.col("x.ArticleTitle")), F.concat(F.lit("PMID "), F.trim("MedlineCitation.PMID")))
    element = r"(?s)<AbstractText([^>]*?)(?:/>|>(.*?)</AbstractText>)"
    whole = F.regexp_extract_all("x.Abstract", F.lit(element), F.lit(0))
    parts = F.transform(F.coalesce(whole, F.array().cast("array<string>")), lambda e, i: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(e, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1), F.lit("")),
                   F.when(F.size(whole) == 1, F.lit("abstract")).otherwise(F.concat(F.lit("abstract part "), (i + 1).cast("string")))).alias("label"),
        inner_text(e).alias("text")))
    all_parts = F.concat(F.array(F.struct(F.lit("title").alias("label"), title.alias("text"))), parts)
    doi = F.get(F.filter("PubmedData.ArticleIdList.ArticleId", lambda a: a["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    rows = art.select(F.trim("MedlineCitation.PMID").alias("pmid"), title.alias("title"), all_parts.alias("parts"), doi.alias("doi"),
                      F.col("x.Journal.JournalIssue.PubDate.Year").alias("year"), F.col("x.Journal.Title").alias("journal"))
    # An article has a handful of sections, so offsets are folded within the row.
    empty = F.array().cast("array<struct<label:string,start:int,stop:int>>")

    def begin(acc: Column) -> Column:
        return F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"] + 2, F.lit(0))

    sections = F.aggregate("parts", empty, lambda acc, p: F.concat(acc, F.array(F.struct(
        p["label"].alias("label"), begin(acc).alias("start"), (begin(acc) + F.length(p["text"])).alias("stop")))))
    return rows.select("pmid", "title", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("canonical_text"),
                       sections.alias("sections"), "doi", "year", "journal")


def not_returned(requested: DataFrame, articles: DataFrame) -> DataFrame:
    """Requested ids that no article answers: (pmid)."""
    return requested.select("pmid").distinct().join(articles.select("pmid"), "pmid", "left_anti")


PREPRINTS = """collection array<struct<doi: string, title: string, authors: string, date: string, version: string, type: string,
 license: string, category: string, abstract: string, published: string, server: string>>"""


def read_preprints(spark: SparkSession, path: str, pins: DataFrame, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, coverage) for pinned (doi, version) pairs: exactly one match becomes a document, anything else is partial."""
    rows = spark.read.schema(PREPRINTS).option("multiLine", multi_line).json(path).select(F.inline("collection"))
    hits = rows.join(pins.select("doi", "version"), ["doi", "version"])
    n = exactly_one(hits.select(F.struct("doi", "version").alias("pin")), "pin").select("pin.*", "n")
    coverage = pins.select("doi", "version").join(n, ["doi", "version"], "left").select(
        "doi", "version", F.coalesce("n", F.lit(0)).alias("found"),
        F.when(F.col("n") == 1, "complete_for_query").otherwise("partial").alias("completion"),
        F.when(F.coalesce("n", F.lit(0)) != 1, F.format_string("pinned version %s not uniquely present", "version")).alias("failure_reason"))
    single = hits.join(n.filter("n = 1").select("doi", "version"), ["doi", "version"], "left_semi")
    title, abstract = line_endings(F.trim("title")), line_endings(F.trim("abstract"))
    documents = single.select(
        "doi", "version", title.alias("title"), F.concat_ws("\n\n", title, abstract).alias("canonical_text"),
        F.array(F.struct(F.lit("title").alias("label"), F.lit(0).alias("start"), F.length(title).alias("stop")),
                F.struct(F.lit("abstract").alias("label"), (F.length(title) + 2).alias("start"), (F.length(title) + 2 + F.length(abstract)).alias("stop"))).alias("sections"),
        missing_to_null(F.col("published")).alias("published_doi"), F.col("published").alias("original_published"),
        missing_to_null(F.col("license")).alias("license"), F.coalesce(missing_to_null(F.col("server")), F.lit("medrxiv")).alias("server"))
    return documents, coverage
