"""Ontology files: OBO text and OBO Graphs JSON to terms, edges and synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.vocab import GRAPH_ALT_ID, GRAPH_REPLACED_BY, GRAPH_SYNONYM_SCOPES
from claimweave.functions.web import curie
from claimweave.operators.filters import lookup
from claimweave.sources.split import json_elements

SYNONYM = r'^"((?:[^"\\]|\\.)*)"\s+(EXACT|BROAD|NARROW|RELATED)\b'


def synonym(value: Column) -> Column:
    """A synonym line as struct(text, scope) with escapes removed; null when it has another form."""
    scope = F.regexp_extract(value, SYNONYM, 2)
    text = F.regexp_replace(F.regexp_extract(value, SYNONYM, 1), r"\\(.)", "$1")
    return F.when(scope != "", F.struct(text.alias("text"), scope.alias("scope")))


def _values(tag: str) -> Column:
    """All trimmed values of a tag within the stanza text, a trailing `` ! label`` cut where the tag names an id."""
    raw = F.regexp_extract_all("stanza", F.lit(rf"(?m)^[ \t]*{tag}:(.*)$"), F.lit(1))
    if tag in ("is_a", "replaced_by", "alt_id"):
        raw = F.transform(raw, lambda v: F.regexp_replace(v, r" ! .*$", ""))
    return F.transform(raw, lambda v: F.trim(v))


def _first_word(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_extract(v, r"^(\S+)", 1))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, release). One row per stanza: the reader splits the file where a line starts with ``[``.

    terms: (id, name, alt_ids, synonyms, is_a, is_obsolete, replaced_by, xrefs, subsets); release: (release).
    """
    rows = spark.read.option("lineSep", "\n[").text(path).select(F.regexp_replace("value", "\r", "").alias("stanza"))
    stanza = rows.filter(F.col("stanza").rlike(r"^\[?Term\]"))
    xref = F.transform(_values("xref"), lambda v: F.struct(
        F.regexp_extract(v, r"^(\S+)", 1).alias("id"),
        F.nullif(F.regexp_extract(v, r"^\S+\s+(\{.*\})", 1), F.lit("")).alias("qualifier")))
    terms = stanza.select(
        F.element_at(_values("id"), 1).alias("id"), F.try_element_at(_values("name"), F.lit(-1)).alias("name"),
        _values("alt_id").alias("alt_ids"), F.array_compact(F.transform(_values("synonym"), synonym)).alias("synonyms"),
        _first_word(_values("is_a")).alias("is_a"),
        F.coalesce(F.try_element_at(_values("is_obsolete"), F.lit(-1)) == "true", F.lit(False)).alias("is_obsolete"),
        _first_word(_values("replaced_by")).alias("replaced_by"), xref.alias("xrefs"), _first_word(_values("subset")).alias("subsets"))
    header = rows.filter(~F.col("stanza").rlike(r"^\[?[A-Za-z]+\]"))
    release = header.select(F.element_at(_values("data-version"), -1).alias("release")).filter("release is not null")
    return terms, release


NODE_SCHEMA = """id string, lbl string, type string, meta struct<deprecated: boolean,
 synonyms: array<struct<pred: string, val: string>>, basicPropertyValues: array<struct<pred: string, val: string>>>"""
EDGE_SCHEMA = "sub string, pred string, obj string"
HEAD_SCHEMA = "graphs array<struct<meta: struct<version: string>>>"
GRAPH_DEPTH = 4  # {"graphs": [{"nodes": [ ... ], "edges": [ ... ]}]}


def read_obographs(spark: SparkSession, path: str, prefix: str = "HP:") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, edges, release) of OBO Graphs files, a large one read by many tasks (``split.json_elements``)."""
    elements, rest = json_elements(spark, path, GRAPH_DEPTH)
    nodes = elements.filter("array = 'nodes'").select(F.from_json("value", NODE_SCHEMA).alias("n"))
    nodes = nodes.filter("n.type = 'CLASS'").select(curie(F.col("n.id")).alias("id"), "n")
    empty_pairs = F.array().cast("array<struct<pred:string,val:string>>")
    props = F.coalesce("n.meta.basicPropertyValues", empty_pairs)
    synonyms = F.transform(F.coalesce("n.meta.synonyms", empty_pairs), lambda s: F.struct(
        s["val"].alias("text"), lookup(GRAPH_SYNONYM_SCOPES, s["pred"]).alias("scope")))

    def property_values(pred: str) -> Column:
        return F.transform(F.filter(props, lambda p: p["pred"] == pred), lambda p: p["val"])

    terms = nodes.filter(F.col("id").startswith(prefix)).select(
        "id", F.col("n.lbl").alias("name"), property_values(GRAPH_ALT_ID).alias("alt_ids"),
        F.filter(synonyms, lambda s: s["scope"].isNotNull() & (s["text"] != "")).alias("synonyms"),
        F.coalesce("n.meta.deprecated", F.lit(False)).alias("is_obsolete"),
        F.transform(property_values(GRAPH_REPLACED_BY), curie).alias("replaced_by"))
    edges = elements.filter("array = 'edges'").select(F.from_json("value", EDGE_SCHEMA).alias("e")).filter("e.pred = 'is_a'").select(
        curie(F.col("e.sub")).alias("child"), curie(F.col("e.obj")).alias("parent"))
    edges = edges.filter(F.col("parent").startswith(prefix)).join(terms.select(F.col("id").alias("child")), "child", "left_semi")
    graph = rest.select(F.get(F.from_json("value", HEAD_SCHEMA)["graphs"], F.lit(0)).alias("g"))
    version = F.col("g.meta.version")
    dated = F.regexp_extract(version, r"releases/([^/]+)/", 1)
    release = graph.select(F.when(dated != "", F.concat(F.lit("hp/releases/"), dated)).otherwise(version).alias("release"))
    return terms, edges, release.filter("release is not null").distinct()


def synonyms_of(terms: DataFrame) -> DataFrame:
    return terms.select("id", F.inline("synonyms"))


def edges_of(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("id").alias("child"), F.posexplode("is_a").alias("pos", "parent"))
