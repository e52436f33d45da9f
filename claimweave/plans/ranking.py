"""Order, limit, retrieval and set-operation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import ranking
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query
from claimweave.session import cut_lineage


SEARCH_SQL = f"""WITH {b.NAMES_SQL},
ents AS (SELECT entity, any_value(alias) AS label FROM names WHERE alias_type = 'label' GROUP BY 1),
al AS (SELECT entity, alias, CASE alias_type WHEN 'label' THEN 0 ELSE 1 END AS pos FROM names UNION ALL SELECT entity, entity, 1000000 FROM ents),
r AS (SELECT entity, alias, pos, CASE WHEN lower(alias) = 'red widget' THEN 0 WHEN starts_with(lower(alias), 'red widget') THEN 1 ELSE 2 END AS rank FROM al WHERE contains(lower(alias), 'red widget')),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY rank, pos) = 1)"""


@query("ranked_search", "I-1", SEARCH_SQL + """
SELECT entity, label, rank, nullif(alias, label) AS matched_alias, (SELECT count(DISTINCT entity) FROM names n WHERE lower(n.alias) = lower(best.alias)) > 1 OR (rank = 0 AND (SELECT count(*) FROM best WHERE rank = 0) > 1) AS ambiguous,
  (SELECT count(*) FROM best) AS total, (SELECT count(*) FROM best) > 20 AS truncated
FROM best JOIN ents USING (entity) ORDER BY rank, lower(label), entity LIMIT 20""")
def ranked_search(t: Tables) -> DataFrame:
    names = b.names(t)
    entities = names.filter("alias_type = 'label'").select("entity", F.col("alias").alias("label"))
    aliases = names.select("entity", "alias", F.when(F.col("alias_type") == "label", 0).otherwise(1).alias("pos"))
    return ranking.search(aliases, entities, " Red  WIDGET ")


@query("search_contexts", "I-1", SEARCH_SQL + """,
top AS (SELECT entity, rank, lower(label) AS l FROM best JOIN ents USING (entity) ORDER BY rank, l, entity LIMIT 20),
ctx AS (SELECT DISTINCT 'part:' || l_partkey AS entity, 'order:' || l_orderkey AS context FROM lineitem),
n AS (SELECT entity, count(context) AS contexts FROM top LEFT JOIN ctx USING (entity) GROUP BY 1),
shown AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY context) AS place FROM ctx WHERE entity IN (SELECT entity FROM top) QUALIFY place <= 20)
SELECT entity, place, context, contexts, CASE WHEN contexts > 20 THEN 'CONTEXTS_TRUNCATED: showing 20 of ' || contexts END AS warning FROM n LEFT JOIN shown USING (entity)
UNION ALL SELECT NULL, NULL, NULL, count(*), 'SEARCH_TRUNCATED: showing 20 of ' || count(*) FROM best HAVING count(*) > 20""")
def search_contexts(t: Tables) -> DataFrame:
    """Orders as contexts of the parts that a search finds, and both warnings."""
    matches = cut_lineage(ranked_search(t), "matches")
    contexts = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("entity"), F.concat(F.lit("order:"), "l_orderkey").alias("context"))
    found = ranking.search_contexts(matches, contexts)
    cut = matches.filter("truncated").select(F.lit(None).cast("string").alias("entity"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("context"),
                                             F.col("total").alias("contexts"), F.format_string("SEARCH_TRUNCATED: showing 20 of %d", "total").alias("warning")).distinct()
    return found.unionByName(cut)


TOKEN_SQL = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+(?:[-''][\\p{{L}}\\p{{N}}_]+)*')"


def retrieval_sql(typed: bool) -> str:
    """Best five entities of every name by token overlap, among all names or among those of the same type."""
    kind, on, by = ("type, ", "AND k.type = m.type", "m.type, ") if typed else ("", "", "")
    return f"""WITH {b.NAMES_SQL},
m AS (SELECT DISTINCT {kind}alias AS mention, list_distinct({TOKEN_SQL.format("lower(alias)")}) AS toks FROM names),
k AS (SELECT DISTINCT {kind}lower(alias) AS key, list_distinct({TOKEN_SQL.format("lower(alias)")}) AS toks FROM names),
mt AS (SELECT {kind}mention, len(toks) AS n, unnest(toks) AS tok FROM m), kt AS (SELECT {kind}key, len(toks) AS n, unnest(toks) AS tok FROM k),
j AS (SELECT {by}mention, key, count(*) / (any_value(m.n) + any_value(k.n) - count(*)) AS score FROM mt m JOIN kt k ON k.tok = m.tok {on} GROUP BY ALL),
s AS (SELECT j.mention, {"j.type, " if typed else ""}entity, round(max(score), 6) AS score FROM j JOIN names n ON lower(alias) = key {"AND n.type = j.type" if typed else ""} GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY mention{", type" if typed else ""} ORDER BY score DESC, entity) AS rank FROM s QUALIFY rank <= 5"""


@query("lexical_retrieval", "I-2", retrieval_sql(False))
def lexical_retrieval(t: Tables) -> DataFrame:
    names = b.names(t)
    out = ranking.retrieve(names.select(F.col("alias").alias("mention")), names.select("entity", "alias"))
    return out.withColumn("score", F.round("score", 6))


@query("typed_retrieval", "I-2", retrieval_sql(True))
def typed_retrieval(t: Tables) -> DataFrame:
    names = b.names(t)
    out = ranking.retrieve(names.select(F.col("alias").alias("mention"), "type"), names.select("entity", "alias", "type"))
    return out.withColumn("score", F.round("score", 6))


@query("capped_lists", "I-4", f"""WITH r AS (SELECT l_partkey, {b.LINE_ID_SQL} AS item FROM lineitem)
SELECT l_partkey, string_agg(item, ',' ORDER BY item) FILTER (i <= 25) AS items, count(*) AS total, count(*) > 25 AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY item) AS i FROM r) GROUP BY 1""")
def capped_lists(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", b.line_id().alias("item"))
    return ranking.capped_lists(rows, "l_partkey", "item", 25).withColumn("items", F.array_join("items", ","))


@query("total_order", "I-7", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def total_order(t: Tables) -> DataFrame:
    return ranking.total_order(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query("catalog_merge", "I-8", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'manual' WHEN o_orderkey % 2 = 0 THEN 'backbone' ELSE 'sources' END AS payload,
  CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS part FROM orders""")
def catalog_merge(t: Tables) -> DataFrame:
    def part(condition, payload):
        return t.orders.filter(condition).select(F.col("o_orderkey").alias("id"), F.lit(payload).alias("payload"))

    return ranking.merge_parts([part("true", "sources"), part("o_orderkey % 2 = 0", "backbone"), part("o_orderkey % 3 = 0", "manual")], "id")


@query("bag_append", "I-9", """
SELECT o_orderpriority AS kind, count(*) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority FROM orders WHERE o_totalprice > 100000) GROUP BY 1""")
def bag_append(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    both = ranking.append_all([o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 100000")])
    return both.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("set_difference", "I-11", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("term_set_intersection", "I-10", """
SELECT l_partkey AS term FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2""")
def term_set_intersection(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.filter("l_suppkey = 1").select(F.col("l_partkey").alias("term")).intersect(
        li.filter("l_suppkey = 2").select(F.col("l_partkey").alias("term")))


NEED_SQL = """refs AS (SELECT 'part:' || l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT 'supplier:' || l_suppkey FROM lineitem WHERE l_returnflag = 'A'
  UNION SELECT 'customer:' || o_custkey FROM orders WHERE o_orderstatus = 'F'),
ents AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size <= 40 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey FROM customer)"""


@query("needed_entities", "I-12", f"""WITH {NEED_SQL} SELECT id, true AS present FROM ents WHERE id IN (SELECT id FROM refs)
UNION ALL SELECT id, false FROM refs WHERE id NOT IN (SELECT id FROM ents)""")
def needed_entities(t: Tables) -> DataFrame:
    li = t.lineitem.filter("l_returnflag = 'A'")
    refs = [li.select(F.concat(F.lit("part:"), "l_partkey").alias("id")), li.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("id")),
            t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("customer:"), "o_custkey").alias("id"))]
    ents = ranking.append_all([
        t.part.filter("p_size <= 40").select(F.concat(F.lit("part:"), "p_partkey").alias("id")),
        t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id")),
        t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))])
    have, lack = ranking.needed_entities(refs, ents)
    return have.withColumn("present", F.lit(True)).unionByName(lack.withColumn("present", F.lit(False)))


@query("coverage_merge", "I-13", """
SELECT user_id AS id, max_by(completion, part) AS completion, max(part) AS part FROM (
  SELECT DISTINCT user_id, 0 AS part, 'complete_for_query' AS completion FROM events UNION ALL SELECT DISTINCT user_id, 1, 'partial' FROM events WHERE event_type = 'error' AND value > 50) GROUP BY 1""")
def coverage_merge(t: Tables) -> DataFrame:
    e = t.events
    first = e.select(F.col("user_id").alias("id")).distinct().withColumn("completion", F.lit("complete_for_query"))
    second = e.filter("event_type = 'error' and value > 50").select(F.col("user_id").alias("id")).distinct().withColumn("completion", F.lit("partial"))
    return ranking.merge_parts([first, second], "id")
