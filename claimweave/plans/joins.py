"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import filters, joins, text_joins, windows
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query


# ---- identifiers -------------------------------------------------------------------------------------------------

def terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts as terms: large ones are obsolete with one or two replacements; every part has an alternate id."""
    node = F.concat(F.lit("part:"), "p_partkey")
    nxt, nxt2 = F.concat(F.lit("part:"), F.col("p_partkey") + 1), F.concat(F.lit("part:"), F.col("p_partkey") + 2)
    replaced = F.when(F.col("p_size") <= 40, F.array().cast("array<string>")).when(
        F.col("p_size") % 2 == 0, F.array(nxt)).otherwise(F.array(nxt, nxt2))
    rows = t.part.select(node.alias("term"), (F.col("p_size") > 40).alias("is_obsolete"), replaced.alias("replaced_by"))
    alternates = t.part.select(F.concat(F.lit("alt:"), "p_partkey").alias("alt_id"), node.alias("term"))
    return rows, alternates


TERMS_SQL = """terms AS (SELECT 'part:' || p_partkey AS term, p_size > 40 AS obsolete,
  CASE WHEN p_size > 40 AND p_size % 2 = 0 THEN 'part:' || (p_partkey + 1) END AS only FROM part),
alternates AS (SELECT 'alt:' || p_partkey AS alt_id, 'part:' || p_partkey AS term FROM part)"""
RESOLVED_SQL = TERMS_SQL + """,
ids AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'alt:' WHEN l_linenumber % 7 = 1 THEN 'gone:' ELSE 'part:' END || l_partkey AS id FROM lineitem),
resolved AS (SELECT ids.id, CASE WHEN NOT s.obsolete THEN s.term WHEN NOT n.obsolete THEN n.term END AS resolved
  FROM ids LEFT JOIN terms k ON k.term = ids.id LEFT JOIN alternates a ON a.alt_id = ids.id
  LEFT JOIN terms s ON s.term = coalesce(k.term, a.term) LEFT JOIN terms n ON n.term = s.only)"""


def cited_id():
    return F.concat(F.when(F.col("l_linenumber") % 3 == 0, "alt:").when(F.col("l_linenumber") % 7 == 1, "gone:")
                    .otherwise("part:"), "l_partkey")


def resolved_ids(t: Tables) -> DataFrame:
    rows, alternates = terms(t)
    return joins.resolve_ids(t.lineitem.select(cited_id().alias("id")), rows, alternates)


@query("id_resolution", "F-2", f"WITH {RESOLVED_SQL} SELECT id, resolved FROM resolved")
def id_resolution(t):
    return resolved_ids(t)


BASELINE_SQL = f"""WITH {RESOLVED_SQL},
rows_ AS (SELECT 'nation:' || s_nationkey AS entity, 'OMIM:' || l_suppkey AS database_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'alt:' WHEN l_linenumber % 7 = 1 THEN 'gone:' ELSE 'part:' END || l_partkey AS term,
  l_returnflag = 'R' AS negated FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F' AND s_acctbal >= 0),
j AS (SELECT rows_.*, resolved FROM rows_ JOIN resolved ON id = term)"""


def baseline(t: Tables) -> tuple[DataFrame, DataFrame]:
    ann = t.lineitem.select(
        F.concat(F.lit("OMIM:"), "l_suppkey").alias("database_id"), cited_id().alias("term"),
        (F.col("l_returnflag") == "R").alias("negated"), F.when(F.col("l_linestatus") == "F", "P").otherwise("I").alias("aspect"))
    exact = t.supplier.filter("s_acctbal >= 0").select(
        F.concat(F.lit("nation:"), "s_nationkey").alias("entity"), F.concat(F.lit("OMIM:"), "s_suppkey").alias("database_id"))
    return joins.mapped_annotations(ann, exact, resolved_ids(t))


@query("mapped_annotations", "F-1", BASELINE_SQL + """
SELECT entity, resolved AS term, count(*) FILTER (NOT negated) AS listed, count(*) FILTER (negated) AS negated
FROM j WHERE resolved IS NOT NULL GROUP BY 1, 2""")
def mapped_annotations(t):
    ok, _ = baseline(t)
    return ok.groupBy("entity", F.col("resolved").alias("term")).agg(
        F.count_if(~F.col("negated")).alias("listed"), F.count_if("negated").alias("negated"))


@query("unresolved_annotation_coverage", "F-1", BASELINE_SQL + """
SELECT DISTINCT entity, database_id, 'partial' AS completion, term || ' has no unambiguous current term' AS failure_reason
FROM j WHERE resolved IS NULL""")
def unresolved_annotation_coverage(t):
    _, gone = baseline(t)
    return gone.select("entity", "database_id", "completion", "failure_reason").distinct()


# ---- aliases -----------------------------------------------------------------------------------------------------

LOOKUP_SQL = f"""WITH {b.NAMES_SQL},
mentions AS (SELECT DISTINCT alias AS mention FROM names UNION SELECT ' ' || upper(n_name) || ' ' FROM nation
  UNION SELECT 'part:' || p_partkey FROM part UNION SELECT 'alt:' || p_partkey FROM part WHERE p_size = 2
  UNION SELECT 'unknown ' || r_name FROM region),
ids AS (SELECT 'part:' || p_partkey AS id, 'part:' || p_partkey AS target FROM part UNION ALL SELECT 'alt:' || p_partkey, 'part:' || p_partkey FROM part),
idx AS (SELECT lower(alias) AS key, count(DISTINCT entity) AS claimants, count(DISTINCT entity) FILTER (alias_type = 'label') AS owners,
  min(entity) FILTER (alias_type = 'label') AS owner FROM names GROUP BY 1),
lookup AS (SELECT mention, CASE WHEN target IS NOT NULL THEN target WHEN owners = 1 AND claimants = 1 THEN owner END AS resolved_id,
  CASE WHEN target IS NOT NULL THEN 1 WHEN owners = 1 AND claimants = 1 THEN 1 WHEN owners > 1 THEN owners ELSE coalesce(claimants, 0) END AS candidates,
  CASE WHEN target IS NOT NULL THEN false WHEN owners > 0 THEN NOT (owners = 1 AND claimants = 1) ELSE coalesce(claimants, 0) > 1 END AS ambiguous,
  CASE WHEN target IS NOT NULL THEN 'identifier' WHEN owners > 0 THEN 'identity_alias' WHEN claimants > 0 THEN 'candidate_alias' ELSE 'none' END AS via
  FROM mentions LEFT JOIN ids ON id = trim(mention) LEFT JOIN idx ON key = lower(trim(mention)))"""


def lookup_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = b.names(t)
    mentions = (
        names.select(F.col("alias").alias("mention"))
        .unionByName(t.nation.select(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("mention")))
        .unionByName(t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("mention")))
        .unionByName(t.part.filter("p_size = 2").select(F.concat(F.lit("alt:"), "p_partkey").alias("mention")))
        .unionByName(t.region.select(F.concat(F.lit("unknown "), "r_name").alias("mention")))
    )
    node = F.concat(F.lit("part:"), "p_partkey")
    ids = t.part.select(F.explode(F.array(node, F.concat(F.lit("alt:"), "p_partkey"))).alias("id"), node.alias("primary"))
    return mentions, ids, joins.alias_index(names)


@query("alias_candidates", "F-3", LOOKUP_SQL + """,
cl AS (SELECT lower(alias) AS key, entity, type, bool_or(alias_type = 'label') AS own, min(alias) AS matched FROM names GROUP BY 1, 2, 3)
SELECT mention, target AS candidate, split_part(target, ':', 1) AS entity_type, trim(mention) AS matched_alias FROM mentions JOIN ids ON id = trim(mention)
UNION ALL SELECT mention, cl.entity, cl.type, matched FROM mentions JOIN cl ON cl.key = lower(trim(mention)) JOIN idx ON idx.key = cl.key
WHERE trim(mention) NOT IN (SELECT id FROM ids) AND (owners <= 1 OR own)""")
def alias_candidates(t):
    mentions, ids, _ = lookup_inputs(t)
    return joins.alias_candidates(mentions, ids, b.names(t))


@query("alias_lookup", "F-3", LOOKUP_SQL + " SELECT mention, resolved_id, CAST(candidates AS BIGINT) AS candidates, ambiguous, via FROM lookup")
def alias_lookup(t):
    return joins.alias_lookup(*lookup_inputs(t))


@query("candidate_linking", "F-4", """
WITH c AS (SELECT c_custkey AS id, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'red widget' ELSE c_name END AS subject_mention,
  CASE WHEN c_custkey % 11 = 0 THEN 'NOWHERE' ELSE n_name END AS object_mention, c_custkey % 13 = 0 AS no_variant,
  CASE WHEN c_custkey % 17 = 0 THEN 'absent' WHEN c_custkey % 19 = 0 THEN 'o' ELSE c_name END AS quote,
  'Record of ' || c_name || ' from ' || n_name AS text, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, CASE WHEN quote IN ('absent', 'o') THEN 'invalid' WHEN no_variant THEN 'unlinked'
  WHEN subject_mention = 'red widget' THEN 'ambiguous' WHEN object_mention = 'NOWHERE' THEN 'unlinked'
  WHEN c_mktsegment = 'MACHINERY' THEN 'invalid' ELSE 'linked' END AS state FROM c""")
def candidate_linking(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    cands = c.select(
        k.alias("id"), F.when(k % 5 == 0, "red widget").otherwise(F.col("c_name")).alias("subject_mention"),
        F.when(k % 11 == 0, "NOWHERE").otherwise(F.col("n_name")).alias("object_mention"),
        F.when(k % 13 == 0, "no such part").otherwise(F.lit("NATION_1")).alias("variant_mention"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "contains").otherwise("located_in").alias("predicate"),
        F.when(k % 17 == 0, "absent").when(k % 19 == 0, "o").otherwise(F.col("c_name")).alias("quote"),
        F.concat(F.lit("Record of "), "c_name", F.lit(" from "), "n_name").alias("text"))
    index = joins.alias_index(b.names(t))
    no_ids = cands.select(F.col("subject_mention").alias("id"), F.col("subject_mention").alias("primary")).limit(0)
    mentions = cands.select(F.explode(F.array("subject_mention", "object_mention", "variant_mention")).alias("mention"))
    found = joins.alias_lookup(mentions, no_ids, index).select("mention", "resolved_id", "ambiguous")

    def side(name):
        return found.select(F.col("mention").alias(f"{name}_mention"), F.col("resolved_id").alias(f"{name}_id"),
                            F.col("ambiguous").alias(f"{name}_amb"))

    j = cands.join(side("subject"), "subject_mention").join(side("object"), "object_mention").join(side("variant"), "variant_mention")
    edges = j.filter("subject_id is not null and object_id is not null").select(
        "id", F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object"),
        F.lit("unknown").alias("effect_direction"), F.lit(None).cast("string").alias("outcome_text"))
    rules = filters.rules_frame(j, {"located_in": (("customer",), ("nation",), None, False),
                                    "contains": (("order",), ("part",), None, False)})
    broken = filters.contract_problems(edges, b.kg_nodes(t), rules).groupBy("id").agg(F.count("*").alias("broken"))
    state = joins.link_state(
        F.when(text_joins.occurrences("text", "quote") == 1, 0).otherwise(1), F.lit(1),
        F.when(F.col("variant_id").isNull(), 1).otherwise(0), F.col("subject_id"), F.col("subject_amb"),
        F.col("object_id"), F.col("object_amb"), F.coalesce("broken", F.lit(0)))
    return j.join(broken, "id", "left").select("id", state.alias("state"))


@query("label_enrichment", "F-5", """
SELECT l_partkey AS part, coalesce(CASE WHEN p_size <= 20 THEN p_name END, CASE WHEN p_size <= 40 THEN 'term ' || p_type END, 'part:' || l_partkey) AS label,
  count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def label_enrichment(t):
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    node = F.concat(F.lit("part:"), "part")
    catalog = t.part.filter("p_size <= 20").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    ontology = t.part.filter("p_size <= 40").select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit("term "), "p_type").alias("label"))
    return joins.with_labels(counts.withColumn("node", node), "node", catalog, ontology).select("part", "label", "n")


# ---- positions in text -------------------------------------------------------------------------------------------

SECTIONS_SQL = """sections AS (SELECT conv_id, turn AS pos, role AS label, s AS s_start, s + length(text) AS s_stop FROM
  (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)),
spans AS (SELECT conv_id, pos AS span_id, s_start + 3 AS start, s_start + 3 + (CASE WHEN pos % 3 = 0 THEN 5000 ELSE 10 END) AS stop FROM sections)"""


def sections(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("len"))
    out = windows.running_total(rows, ["conv_id"], "turn", F.col("len") + 2, "s_start")
    return out.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("label"), "s_start",
                      (F.col("s_start") + F.col("len")).alias("s_stop"))


def spans(t: Tables) -> DataFrame:
    s = sections(t)
    length = F.when(F.col("pos") % 3 == 0, 5000).otherwise(10)
    return s.select("conv_id", F.col("pos").alias("span_id"), (F.col("s_start") + 3).alias("start"),
                    (F.col("s_start") + 3 + length).alias("stop"))


@query("section_of_span", "F-6", f"""WITH {SECTIONS_SQL}
SELECT x.conv_id, span_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, min_by(label, pos) AS label,
  CAST(min_by(s_start, pos) AS BIGINT) AS s_start, CAST(min_by(s_stop, pos) AS BIGINT) AS s_stop
FROM spans x LEFT JOIN sections s ON s.conv_id = x.conv_id AND s_start <= start AND stop <= s_stop GROUP BY 1, 2, 3, 4""")
def section_of_span(t):
    return joins.containing_section(spans(t), sections(t), "conv_id")


def vocabulary(t: Tables) -> DataFrame:
    return t.benchmark.select(F.get(F.split("text", " ", 2), F.lit(0)).alias("symbol")).filter("symbol <> ''").distinct()


@query("symbol_mentions", "F-8", r"""
WITH v AS (SELECT DISTINCT split_part(text, ' ', 1) AS symbol FROM benchmark WHERE split_part(text, ' ', 1) <> ''),
p AS (SELECT symbol, '(?s)^(.*?)(^|[^A-Za-z0-9])(' || regexp_escape(symbol) || ')($|[^A-Za-z0-9])' AS pat FROM v),
m AS (SELECT doc_id, symbol, length(regexp_extract(text, pat, 1)) + length(regexp_extract(text, pat, 2)) AS start FROM documents, p
  WHERE contains(text, symbol) AND regexp_matches(text, pat))
SELECT doc_id, symbol, start, start + length(symbol) AS stop FROM m""")
def symbol_mentions(t):
    return text_joins.symbol_mentions(t.documents, vocabulary(t), "doc_id", "text")


def quotes(t: Tables) -> DataFrame:
    """Whole benchmark texts, and their first and last two words as short quotes."""
    words = F.split("text", " ")
    whole = t.benchmark.select(F.col("item_id").cast("string").alias("quote_id"), F.col("text").alias("quote"))
    short = t.benchmark.select(F.concat(F.lit("s"), "item_id").alias("quote_id"),
                               F.array_join(F.slice(words, -2, 2), " ").alias("quote"))
    return whole.unionByName(short)


LOCATED_SQL = """quotes AS (SELECT CAST(item_id AS VARCHAR) AS quote_id, text AS quote FROM benchmark
  UNION ALL SELECT 's' || item_id, array_to_string(string_split(text, ' ')[-2:], ' ') FROM benchmark),
located AS (SELECT doc_id, quote_id, n AS occurrences, CASE WHEN n = 1 THEN p END AS start, CASE WHEN n = 1 THEN p + length(quote) END AS stop,
  CASE WHEN n > 1 THEN 'quote occurs ' || n || ' times; a section label is needed' END AS reason
  FROM (SELECT doc_id, quote_id, quote, instr(text, quote) - 1 AS p,
    CAST((length(text) - length(replace(text, quote, ''))) / length(quote) AS INT) AS n FROM documents, quotes WHERE contains(text, quote)))"""


def located(t: Tables) -> DataFrame:
    return text_joins.locate_quotes(t.documents, quotes(t), "doc_id", "text")


@query("quote_location", "F-9", f"WITH {LOCATED_SQL} SELECT * FROM located")
def quote_location(t):
    return located(t)


@query("quotes_not_found", "F-9", f"""WITH {LOCATED_SQL} SELECT quote_id, 'quote not found verbatim' AS reason FROM quotes
WHERE quote_id NOT IN (SELECT quote_id FROM located)""")
def quotes_not_found(t):
    return text_joins.unplaced_quotes(quotes(t), located(t))


# ---- keeping and comparing sets of rows --------------------------------------------------------------------------

@query("kept_supports", "F-10", """
SELECT 'support' AS kind, l_orderkey || ':' || count(*) AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey
UNION ALL SELECT DISTINCT 'evidence', 'part:' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def kept_supports(t):
    kept = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("assertion"))
    supports = t.lineitem.select(F.col("l_orderkey").alias("assertion"), F.concat(F.lit("part:"), "l_partkey").alias("evidence"))
    evidence = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("evidence"))
    s, e = joins.keep_referenced(kept, supports, evidence)
    per = s.groupBy("assertion").agg(F.count("*").alias("n")).select(
        F.lit("support").alias("kind"), F.concat_ws(":", F.col("assertion").cast("string"), F.col("n").cast("string")).alias("id"))
    return per.unionByName(e.select(F.lit("evidence").alias("kind"), F.col("evidence").alias("id")))


@query("missing_ids", "F-11", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(t):
    return joins.missing(t.documents, t.labels, "doc_id")


def manifests(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = t.orders.filter("o_orderdate < timestamp '1999-01-01'").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.sha2("o_orderstatus", 256).alias("hash"))
    status = F.when(F.col("o_orderkey") % 20 == 1, "X").otherwise(F.col("o_orderstatus"))
    after = t.orders.filter("o_orderkey % 50 <> 0").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.sha2(status, 256).alias("hash"))
    return before, after


DIFF_SQL = """diff AS (SELECT 'order:' || o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'removed'
    WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'appended' ELSE 'changed' END AS change FROM orders
  WHERE (o_orderkey % 50 = 0 AND o_orderdate < TIMESTAMP '1999-01-01') OR (o_orderkey % 50 <> 0 AND (o_orderdate >= TIMESTAMP '1999-01-01' OR o_orderkey % 20 = 1)))"""


@query("snapshot_diff", "F-12", f"WITH {DIFF_SQL} SELECT id, change FROM diff")
def snapshot_diff(t):
    return joins.snapshot_diff(*manifests(t))


def kg_dependencies(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as assertions order -> part in the context of the order's customer, whose members are its nation."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = lines.select(
        b.line_id().alias("assertion"), F.concat(F.lit("order:"), "l_orderkey").alias("subject"),
        F.concat(F.lit("part:"), "l_partkey").alias("object"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("customer:"), "o_custkey")).alias("context"))
    members = t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("context"),
                                F.concat(F.lit("nation:"), "c_nationkey").alias("member"))
    maps = t.part.filter("p_type = 'PROMO'").select(F.concat(F.lit("map:"), "p_partkey").alias("mapping"),
                                                    F.concat(F.lit("part:"), "p_partkey").alias("entity"))
    return a, members, maps


DEPENDENCIES_SQL = f"""a AS (SELECT {b.LINE_ID_SQL} AS assertion, 'order:' || l_orderkey AS subject, 'part:' || l_partkey AS object,
  CASE WHEN l_linestatus = 'F' THEN 'customer:' || o_custkey END AS context FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ent AS (SELECT assertion, subject AS d FROM a UNION SELECT assertion, object FROM a
  UNION SELECT assertion, 'nation:' || c_nationkey FROM a JOIN customer ON context = 'customer:' || c_custkey),
deps AS (SELECT assertion, d AS depends_on FROM ent UNION SELECT assertion, context FROM a WHERE context IS NOT NULL
  UNION SELECT assertion, 'map:' || p_partkey FROM ent JOIN part ON d = 'part:' || p_partkey WHERE p_type = 'PROMO')"""


@query("dependency_expansion", "F-13", f"WITH {DEPENDENCIES_SQL} SELECT assertion, depends_on FROM deps")
def dependency_expansion(t):
    return joins.dependencies(*kg_dependencies(t))


@query("affected_assertions", "F-12", f"""WITH {DEPENDENCIES_SQL}, {DIFF_SQL}
SELECT DISTINCT assertion FROM deps JOIN diff ON id = depends_on WHERE change <> 'appended'""")
def affected_assertions(t):
    return joins.affected(*kg_dependencies(t), joins.snapshot_diff(*manifests(t)))


@query("covered_buckets", "F-14", """
WITH m AS (SELECT DISTINCT l_orderkey AS set_id, l_suppkey AS item FROM lineitem),
c AS (SELECT s_nationkey AS cover_id, s_suppkey AS item FROM supplier UNION ALL SELECT 100 + n_regionkey, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
n AS (SELECT set_id, count(*) AS size FROM m GROUP BY 1)
SELECT set_id, cover_id FROM m JOIN c USING (item) JOIN n USING (set_id) GROUP BY 1, 2, size HAVING count(*) = size""")
def covered_buckets(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("item"))
    by_nation = t.supplier.select(F.col("s_nationkey").alias("cover_id"), F.col("s_suppkey").alias("item"))
    by_region = b.levels(t).select((F.col("level") + 100).alias("cover_id"), F.col("entity").alias("item"))
    return joins.covered_sets(members, by_nation.unionByName(by_region))


# ---- communities -------------------------------------------------------------------------------------------------

REACH_SQL = """reach AS (
  SELECT entity, anchor, min_by(predicate, way || ':' || lpad(record, 20, '0')) AS predicate, min_by(record, way || ':' || lpad(record, 20, '0')) AS record FROM (
    SELECT 'supplier:' || l_suppkey AS entity, p_brand AS anchor, 'serves' AS predicate, CAST(l_orderkey AS VARCHAR) AS record, 0 AS way
      FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 45
    UNION ALL SELECT 'customer:' || o_custkey, p_brand, 'investigator_on', CAST(o_orderkey AS VARCHAR), 1
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 'supplier:' || x.l_suppkey, p_brand, 'owns_or_runs', CAST(x.l_orderkey AS VARCHAR), 1
      FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN part ON p_partkey = y.l_partkey WHERE x.l_linenumber = 1)
  WHERE entity NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1, 2)"""


def reach(t: Tables) -> DataFrame:
    """Customers and suppliers tied to brands: directly, or through an order that contains a part of it."""
    small = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("anchor"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    named = lines.join(small, "l_partkey")
    record = F.col("l_orderkey")
    supplier = F.concat(F.lit("supplier:"), "l_suppkey")
    direct = named.filter("l_quantity >= 45").select(supplier.alias("entity"), "anchor", F.lit("serves").alias("predicate"), record.alias("record"))
    investigators = t.orders.select(
        F.concat(F.lit("customer:"), "o_custkey").alias("entity"), F.col("o_orderkey").alias("project"),
        F.lit("investigator_on").alias("predicate"), F.col("o_orderkey").alias("record"))
    owners = lines.filter("l_linenumber = 1").select(
        supplier.alias("entity"), F.col("l_orderkey").alias("project"), F.lit("owns_or_runs").alias("predicate"), record.alias("record"))
    excluded = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity"))
    out = joins.community_anchors(
        direct, investigators.unionByName(owners), named.select(F.col("l_orderkey").alias("project"), "anchor"), excluded)
    return out.withColumn("record", F.col("record").cast("string"))


@query("community_anchors", "F-15", f"WITH {REACH_SQL} SELECT * FROM reach")
def community_anchors(t):
    return reach(t)


@query("bridging_entities", "I-5", f"""WITH {REACH_SQL}
SELECT entity, count(*) AS anchors, entity LIKE 'customer:%' AS is_person FROM reach GROUP BY 1 HAVING count(*) >= 2
ORDER BY anchors DESC, is_person DESC, entity LIMIT 40""")
def bridging_entities(t):
    r = reach(t)
    kinds = r.select("entity").distinct().withColumn("is_person", F.col("entity").startswith("customer:"))
    return joins.bridges(r, kinds, 40)


def nation_communities(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as contexts: members buy or sell parts there, the region is the disease, brands are genes."""
    small = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(small, "l_partkey")
    buyers = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sold = lines.join(buyers, "l_orderkey")
    # Members are numbered, suppliers even and parts odd.
    members = sold.select(F.col("c_nationkey").alias("context"), (F.col("l_suppkey") * 2).alias("member"), F.lit(False).alias("is_person")).unionByName(
        sold.select(F.col("c_nationkey").alias("context"), (F.col("l_partkey") * 2 + 1).alias("member"), F.lit(True).alias("is_person")))
    contexts = t.nation.select(F.col("n_nationkey").alias("context"), F.col("n_regionkey").alias("disease"))
    genes = t.nation.select(F.col("n_nationkey").alias("context"), (F.col("n_nationkey") % 4).alias("gene"))
    return members, contexts, genes


@query("community_overlap", "F-16 I-6", """
WITH sold AS (SELECT c_nationkey AS context, l_suppkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey),
m AS (SELECT DISTINCT context, 'supplier:' || l_suppkey AS member, false AS person FROM sold UNION ALL SELECT DISTINCT context, 'order-part:' || l_partkey, true FROM sold)
SELECT o.context, count(*) AS shared, count(*) FILTER (o.person) AS persons FROM m o JOIN m mine ON mine.member = o.member AND mine.context = 3
JOIN nation n ON n.n_nationkey = o.context WHERE o.context <> 3 AND n_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AND o.context % 4 <> 3
GROUP BY 1 ORDER BY persons DESC, o.context LIMIT 10""")
def community_overlap(t):
    return joins.community_overlap(3, *nation_communities(t))


@query("contexts_of_entity", "F-17", """
SELECT DISTINCT * FROM (
  SELECT 'nation:' || c_nationkey AS entity, 'context:' || c_custkey AS context FROM customer
  UNION ALL SELECT 'region:' || n_regionkey, 'context:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'segment:' || c_mktsegment, 'context:' || c_custkey FROM customer
  UNION ALL SELECT 'part:' || l_partkey, 'context:' || o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'
  UNION ALL SELECT 'supplier:' || l_suppkey, 'context:' || o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 48)""")
def contexts_of_entity(t):
    ctx = F.concat(F.lit("context:"), "c_custkey").alias("context")
    c = t.customer
    cited = t.lineitem.filter("l_returnflag = 'A' or l_quantity >= 48").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    lines = cited.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    buyer = F.concat(F.lit("context:"), "o_custkey").alias("context")
    return joins.contexts_of([
        c.select(F.concat(F.lit("nation:"), "c_nationkey").alias("entity"), ctx),
        c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("region:"), "n_regionkey").alias("entity"), ctx),
        c.select(F.concat(F.lit("segment:"), "c_mktsegment").alias("entity"), ctx),
        lines.filter("l_returnflag = 'A'").select(F.concat(F.lit("part:"), "l_partkey").alias("entity"), buyer),
        lines.filter("l_quantity >= 48").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("entity"), buyer),
    ])


# ---- checks and promotion ----------------------------------------------------------------------------------------

@query("current_checks", "F-21", """
SELECT doc_id % 100 AS assertion, max_by(doc_id, doc_id) AS candidate, max(doc_id) AS check_no, max_by(lang, doc_id) AS verdict
FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1""")
def current_checks(t):
    now = t.documents.select(F.col("doc_id").alias("candidate"), (F.col("doc_id") % 100).alias("assertion"), F.sha2("text", 256).alias("hash"))
    then = t.documents.select(
        F.col("doc_id").alias("candidate"), F.col("doc_id").alias("check_no"), F.col("lang").alias("verdict"),
        F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return joins.current_checks(then, now)


@query("promotion", "F-20", """
SELECT d.doc_id AS candidate, source AS subject, 'mentions' AS predicate, lang AS object, CASE WHEN quality = 1 THEN 'ctx:' || (d.doc_id % 10) END AS context,
  CASE WHEN l.doc_id IS NULL THEN 'not recorded' ELSE 'label study' END AS study_design,
  CASE WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'confirmed' END AS independence, toxic AS patient_count
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars > 500""")
def promotion(t):
    cands = t.documents.select(
        F.col("doc_id").alias("candidate"), F.col("source").alias("subject"), F.lit("mentions").alias("predicate"),
        F.col("lang").alias("object"), F.when(F.col("n_chars") > 500, "linked").otherwise("unlinked").alias("state"))
    assigned = t.labels.select(
        F.col("doc_id").alias("candidate"), F.when(F.col("quality") == 1, F.concat(F.lit("ctx:"), F.col("doc_id") % 10)).alias("context"),
        F.lit("label study").alias("study_design"), F.lit("confirmed").alias("independence"), F.col("toxic").alias("patient_count"))
    return joins.promote(cands, assigned)


@query("trial_linking", "F-22", """
SELECT 'trial:' || o_orderkey AS study, 'studies' AS predicate, 'nation:' || c_nationkey AS object FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT DISTINCT 'trial:' || o_orderkey, 'mentions', 'word:' || p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND p_name IN ('red widget', 'blue bolt', 'small ring')""")
def trial_linking(t):
    o = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    study = F.concat(F.lit("trial:"), "o_orderkey").alias("study")
    conditions = o.join(c, "o_custkey").select(study, F.col("n_name").alias("mention"))
    keywords = o.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("mention")), "l_partkey").select(study, "mention").distinct()
    terms_ = conditions.unionByName(keywords).distinct()
    index = joins.alias_index(b.names(t))
    no_ids = terms_.select(F.col("mention").alias("id"), F.col("mention").alias("primary")).limit(0)
    hits = joins.alias_lookup(terms_, no_ids, index).filter("resolved_id is not null and via in ('identifier', 'identity_alias')")
    genes = t.part.filter(F.col("p_name").isin("red widget", "blue bolt", "small ring")).select(
        F.col("p_name").alias("mention")).distinct().withColumn("object", F.concat(F.lit("word:"), "mention"))
    linked = terms_.join(hits, "mention").select("study", F.lit("studies").alias("predicate"), F.col("resolved_id").alias("object"))
    named = terms_.join(genes, "mention").select("study", F.lit("mentions").alias("predicate"), "object")
    return linked.unionByName(named).distinct()
