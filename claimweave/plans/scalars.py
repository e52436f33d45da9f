"""Scalar functions over whole tables."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text, web
from claimweave.functions.vocab import SYNONYM_ALIAS_TYPES
from claimweave.operators import filters, sections, views
from claimweave.plans.catalogue import Tables, query
from claimweave.plans.filters import HOST_SQL

WORD_SQL = r"'[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*'"


@query("normalize_key", "H-1", r"""
SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS key_sha FROM documents""")
def normalize_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.normalize_key(F.col("text")), 256).alias("key_sha"))


@query("words_only", "H-2", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS words_sha FROM documents")
def words_only(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.words_only(F.col("text")), 256).alias("words_sha"))


@query("word_tokens", "H-3", f"""
SELECT doc_id, len(k) AS n_tokens, sha256(array_to_string(k, '|')) AS tokens_sha FROM (SELECT doc_id, regexp_extract_all(text, {WORD_SQL}) AS k FROM documents)""")
def word_tokens(t: Tables) -> DataFrame:
    k = text.word_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).alias("n_tokens"), F.sha2(F.array_join(k, "|"), 256).alias("tokens_sha"))


@query("token_jaccard", "H-4", f"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), {WORD_SQL})) AS k FROM documents)
SELECT x.doc_id, round(len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))), 6) AS jaccard FROM d x JOIN d y ON y.doc_id = x.doc_id + 1""")
def token_jaccard(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.array_distinct(text.word_tokens(F.lower("text"))).alias("k"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(text.token_jaccard(F.col("k"), F.col("k2")), 6).alias("jaccard"))


@query("line_endings", "H-5", r"""
SELECT doc_id, sha256(regexp_replace(replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(13)), '\r\n?', chr(10), 'g')) AS text_sha FROM documents""")
def line_endings(t: Tables) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r"))
    return t.documents.select("doc_id", F.sha2(text.line_endings(raw), 256).alias("text_sha"))


@query("obo_synonym_text", "H-6", r"""
SELECT p_partkey, p_name || ' "' || p_brand || '"' AS text, CASE p_size % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'BROAD' WHEN 2 THEN 'NARROW' ELSE 'RELATED' END AS scope FROM part""")
def obo_synonym_text(t: Tables) -> DataFrame:
    from claimweave.sources.ontology import synonym

    scope = F.element_at(F.array(*[F.lit(s) for s in ("EXACT", "BROAD", "NARROW", "RELATED")]), (F.col("p_size") % 4 + 1).cast("int"))
    raw = F.concat(F.lit('"'), "p_name", F.lit(' \\"'), "p_brand", F.lit('\\"" '), scope, F.lit(" [source:1]"))
    s = synonym(raw)
    return t.part.select("p_partkey", s["text"].alias("text"), s["scope"].alias("scope"))


@query("line_at", "H-7", """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 12 AS n FROM documents)
SELECT doc_id, CASE WHEN n BETWEEN 1 AND len(l) THEN l[n] ELSE '' END AS line FROM d""")
def line_at(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.line_at(F.col("text"), (F.col("doc_id") % 12).cast("int")).alias("line"))


@query("website_domain", "H-8", f"SELECT page_id, {HOST_SQL} AS domain FROM pages")
def website_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", web.domain(F.col("url")).alias("domain"))


def drop_sql(x: str, tag: str) -> str:
    return f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAMED_SQL = "MAP {" + ", ".join(f"{_literal(name)}: {_literal(ch)}" for name, ch in sorted(html.entities.html5.items())) + "}"
PLACED_SQL = "MAP {" + ", ".join(f"{n}: {_literal(html.unescape(f'&#{n};'))}" for n in (0, 13, *range(128, 160))) + "}"  # numbers that stand for another character
OPEN_NAMES = range(max(len(name) for name in html.entities.html5 if not name.endswith(";")), 1, -1)  # lengths of names that need no semicolon


def unescape_sql(x: str) -> str:
    """Character references as HTML reads them: by name, by number, and old names also without their semicolon."""
    pieces = f"regexp_extract_all({x}, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)|&|[^&]+')"
    number = "CASE WHEN p[3] IN ('x', 'X') THEN TRY_CAST('0x' || rtrim(p[4:], ';') AS UBIGINT) ELSE TRY_CAST(rtrim(p[3:], ';') AS UBIGINT) END"
    gone = f"n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN {0xFDD0} AND {0xFDEF} OR n % 65536 >= 65534"
    numbered = (f"list_transform([{number}], lambda n: CASE WHEN n IS NULL OR n > {0x10FFFF} OR n BETWEEN {0xD800} AND {0xDFFF} THEN chr({0xFFFD})"
                f" WHEN n < 160 AND placed[n] IS NOT NULL THEN placed[n] WHEN {gone} THEN '' ELSE chr(CAST(n AS INT)) END)[1]")
    named = "coalesce(named[p[2:]], " + ", ".join(f"named[p[2:{k + 1}]] || p[{k + 2}:]" for k in OPEN_NAMES) + ", p)"
    return f"list_aggregate(list_transform({pieces}, lambda p: CASE WHEN p[1] <> '&' OR p = '&' THEN p WHEN p[2] = '#' THEN {numbered} ELSE {named} END), 'string_agg', '')"


def page_text_sql() -> str:
    """Visible text of ``html``; ``PAGES_SQL`` brings the tables of character references."""
    x = "regexp_replace(html, '\\r\\n?', chr(10), 'g')"
    for tag in ("script", "style", "noscript", "template", "svg"):
        x = drop_sql(x, tag)
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = (f"regexp_replace({x}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|main|nav|blockquote|pre|dt|dd|hr)(\\s[^>]*)?/?>', chr(10), 'g')")
    x = f"regexp_replace({x}, '<[/!]?[a-zA-Z][^>]*>', '', 'g')"
    x = f"coalesce({unescape_sql(f'coalesce({unescape_sql(x)}, {chr(39) * 2})')}, '')"
    x = f"regexp_replace({x}, '[ \\t\\f\\v\\x{{a0}}]+', ' ', 'g')"
    edge = "[ \\r\\x1c-\\x1f\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    x = f"regexp_replace({x}, '(?m)^{edge}|{edge}$', '', 'g')"
    x = f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    return x


PAGES_SQL = f"(SELECT * FROM pages, (SELECT {NAMED_SQL} AS named, {PLACED_SQL} AS placed))"


@query("html_text", "H-9 A-14", f"SELECT page_id, sha256(CASE WHEN x = '' THEN '' ELSE x || chr(10) END) AS text_sha FROM (SELECT page_id, {page_text_sql()} AS x FROM {PAGES_SQL})")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(text.html_text(F.col("html")), 256).alias("text_sha"))


@query("paragraph_sections", "H-10", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 2 AS start FROM l)
SELECT doc_id, 'paragraph ' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS label, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) + length(line) AS stop FROM o WHERE line <> ''""")
def paragraph_sections(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return sections.paragraph_sections(d, "doc_id", "text")


@query("query_parameter_list", "H-11", r"""
SELECT page_id, array_to_string(CASE WHEN url LIKE '%page=%' THEN string_split('11,12,' || regexp_extract(url, '[?&]page=([^&#]*)', 1), ',') ELSE [] END, '|') AS ids FROM pages""")
def query_parameter_list(t: Tables) -> DataFrame:
    url = F.regexp_replace("url", "page=", "page=11,12,")
    return t.pages.select("page_id", F.array_join(web.query_values(url, "page"), "|").alias("ids"))


@query("canonical_target", "H-12", r"""
SELECT page_id, CASE WHEN url LIKE '%page=%' THEN split_part(url, '?', 1) || '?page=2' ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN url LIKE '%utm_source=%' THEN '' ELSE regexp_extract(url, '(\?[^#]*)', 1) END END AS target FROM pages""")
def canonical_target(t: Tables) -> DataFrame:
    return t.pages.select("page_id", web.canonical_target(F.col("url"), ("ref", "utm_source")).alias("target"))


SCOPE_SQL = """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'No additional scope qualifiers recorded.' ELSE
  concat_ws('; ', CASE WHEN o_orderstatus <> 'P' THEN 'population: ' || o_orderstatus END, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'timeframe: ' || o_orderpriority END) END"""


def scope_text():
    return text.joined_or([
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("population: "), "o_orderstatus")),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.concat(F.lit("timeframe: "), "o_orderpriority"))],
        "No additional scope qualifiers recorded.")


@query("scope_text", "H-14", f"SELECT o_orderkey, {SCOPE_SQL} AS scope FROM orders")
def scope_text_query(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", scope_text().alias("scope"))


@query("record_sentence", "H-13", f"""SELECT o_orderkey, 'Customer ' || o_custkey || CASE o_orderstatus WHEN 'F' THEN ' works on' WHEN 'P' THEN ' serves the community for' ELSE ' is the recorded funder of' END || ' Order ' || o_orderkey ||
  ' (' || CASE o_orderstatus WHEN 'F' THEN 'reported result' WHEN 'P' THEN 'planned work' ELSE 'ongoing work' END || '; ' || {SCOPE_SQL} || ')' AS sentence FROM orders""")
def record_sentence(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    predicate = F.when(s == "F", "works_on").when(s == "P", "serves").otherwise("funds")
    status = F.when(s == "F", "reported_result").when(s == "P", "planned").otherwise("ongoing")
    return t.orders.select("o_orderkey", views.record_sentence(
        F.concat(F.lit("Customer "), "o_custkey"), predicate, F.concat(F.lit("Order "), "o_orderkey"), status, scope_text()).alias("sentence"))


@query("sorted_qualifiers", "H-15", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_sort(list_filter([CASE WHEN l_returnflag <> 'N' THEN 'sex: ' || l_returnflag END, CASE WHEN l_linestatus = 'F' THEN 'onset: F' END, CASE WHEN l_quantity > 25 THEN 'frequency: high' END], lambda x: x IS NOT NULL)), '; ') AS qualifiers FROM lineitem""")
def sorted_qualifiers(t: Tables) -> DataFrame:
    parts = F.array_compact(F.array(
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("sex: "), "l_returnflag")), F.when(F.col("l_linestatus") == "F", "onset: F"),
        F.when(F.col("l_quantity") > 25, "frequency: high")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.array_sort(parts), "; ").alias("qualifiers"))


@query("title_case", "H-17", """
SELECT s_suppkey, 'O''Supplier-' || 'Co#' || s_suppkey || ' Of ' || 'Nation_' || s_nationkey AS name FROM supplier""")
def title_case(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("o'SUPPLIER-co#"), "s_suppkey", F.lit(" of NATION_"), "s_nationkey")
    return t.supplier.select("s_suppkey", text.title_case(raw).alias("name"))


@query("readable_properties", "H-22", """
SELECT p_partkey, 'brands=' || p_brand || ', ' || p_type || CASE WHEN p_size > 25 THEN ';size=' || p_size ELSE '' END AS properties FROM part""")
def readable_properties(t: Tables) -> DataFrame:
    lists = F.create_map(F.lit("brands"), F.array("p_brand", "p_type"), F.lit("none"), F.array().cast("array<string>"),
                         F.lit("size"), F.when(F.col("p_size") > 25, F.array(F.col("p_size").cast("string"))))
    shown = views.readable_properties(lists)
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


@query("alias_scope_map", "H-23", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'exact_synonym' WHEN 1 THEN 'broad_synonym' WHEN 2 THEN 'narrow_synonym' WHEN 3 THEN 'related_synonym' END AS alias_type FROM part""")
def alias_scope_map(t: Tables) -> DataFrame:
    scope = F.element_at(F.array(*[F.lit(s) for s in ("EXACT", "BROAD", "NARROW", "RELATED", "OTHER")]), (F.col("p_size") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", filters.lookup(SYNONYM_ALIAS_TYPES, scope).alias("alias_type"))


@query("cost_estimate", "H-24", """
SELECT conv_id, turn, round((length(text) // 3 + length(role) // 3 + 200) / 1e6 * 2.5 + 800 / 1e6 * 10.0, 9) AS usd FROM conversations""")
def cost_estimate(t: Tables) -> DataFrame:
    tokens_in = F.expr("length(text) div 3 + length(role) div 3 + 200")
    return t.conversations.select("conv_id", "turn", F.round(tokens_in / F.lit(1e6) * 2.5 + F.lit(800 / 1e6 * 10.0), 9).alias("usd"))


@query("request_identity", "A-17", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '#key' || page_id ELSE url END AS target FROM pages""")
def request_identity(t: Tables) -> DataFrame:
    method = F.when(F.col("page_id") % 3 == 0, "POST").when(F.col("page_id") % 3 == 1, "GET")
    return t.pages.select("page_id", web.request_identity(method, F.col("url"), F.concat(F.lit("key"), "page_id")).alias("target"))
