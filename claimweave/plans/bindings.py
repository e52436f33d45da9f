"""How the driver tables stand in for the operators' own inputs. Each binding exists as DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.catalogue import Tables

ROOTS = ("ALL",)


def annotations(t: Tables, sparse_negation: bool = False) -> DataFrame:
    """lineitem as annotation rows: (entity, term, negated, aspect)."""
    negated = F.col("l_returnflag") == "R"
    if sparse_negation:
        negated = negated & (F.col("l_quantity") >= 50)
    return t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.concat(F.lit("part:"), "l_partkey").alias("term"),
        negated.alias("negated"), F.when(F.col("l_linestatus") == "F", "P").otherwise("O").alias("aspect"),
    )


ANN_SQL = """ann AS (SELECT l_suppkey AS entity, 'part:' || l_partkey AS term, l_returnflag = 'R' AS negated,
  CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'O' END AS aspect FROM lineitem)"""
ANNG_SQL = ANN_SQL.replace("l_returnflag = 'R' AS negated", "(l_returnflag = 'R' AND l_quantity >= 50) AS negated")


def positive(ann: DataFrame) -> DataFrame:
    return ann.filter((F.col("aspect") == "P") & ~F.col("negated"))


def ontology_edges(t: Tables) -> DataFrame:
    """part to brand and type, both to ALL: (child, parent)."""
    p = t.part
    node = F.concat(F.lit("part:"), "p_partkey")
    brand, kind = F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type")
    parents = p.select(node.alias("child"), F.explode(F.array(brand, kind)).alias("parent"))
    tops = p.select(F.explode(F.array(brand, kind)).alias("child")).distinct()
    return parents.unionByName(tops.select("child", F.lit("ALL").alias("parent")))


EDGES_SQL = """edges AS (SELECT 'part:' || p_partkey AS child, 'brand:' || p_brand AS parent FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'type:' || p_type FROM part
  UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'ALL' FROM part
  UNION ALL SELECT DISTINCT 'type:' || p_type, 'ALL' FROM part)"""
CLOSURE_SQL = EDGES_SQL + """,
closure AS (WITH RECURSIVE up(node, ancestor) AS (
    SELECT child, child FROM edges UNION SELECT parent, parent FROM edges
    UNION SELECT up.node, edges.parent FROM up JOIN edges ON up.ancestor = edges.child)
  SELECT DISTINCT node, ancestor FROM up)"""


def levels(t: Tables) -> DataFrame:
    """The profile level of a supplier is its region: (entity, level)."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("level")
    )


LEVELS_SQL = """levels AS (SELECT s_suppkey AS entity, n_regionkey AS level FROM supplier JOIN nation
  ON s_nationkey = n_nationkey)"""


def reference_rows(t: Tables, ann: DataFrame) -> DataFrame:
    ref = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("entity"))
    return positive(ann).select("entity", "term").join(ref, "entity", "left_semi")


REF_SQL = """refpos AS (SELECT DISTINCT entity, term FROM ann JOIN supplier ON s_suppkey = entity
  WHERE aspect = 'P' AND NOT negated AND s_acctbal >= 0),
ic AS (SELECT term, n, total, -ln(n / total) + 0.0 AS ic FROM
  (SELECT ancestor AS term, count(DISTINCT entity) AS n FROM refpos JOIN closure ON node = term GROUP BY 1),
  (SELECT count(DISTINCT entity) AS total FROM refpos))"""

DIRECT_SQL = """direct AS (SELECT DISTINCT ann.entity, level, term FROM ann JOIN levels USING (entity)
  WHERE aspect = 'P' AND NOT negated),
prof AS (SELECT DISTINCT entity, level, ancestor AS term FROM direct JOIN closure ON node = term WHERE ancestor <> 'ALL')"""

# Everything up to the profiles, ready to be followed by a SELECT or further steps.
PROFILE_SQL = "WITH " + ",\n".join([ANN_SQL, CLOSURE_SQL, LEVELS_SQL, REF_SQL, DIRECT_SQL])
PROFILEG_SQL = "WITH " + ",\n".join([ANNG_SQL, CLOSURE_SQL, LEVELS_SQL, REF_SQL, DIRECT_SQL])

# Scored top-3 cards on top of either; {gate} restricts both sides.
CARDS_TAIL = """,
cover AS (SELECT entity, count(*) AS direct_terms, count(ic) AS assessed_terms FROM
  (SELECT DISTINCT entity, term FROM direct) d LEFT JOIN ic USING (term) GROUP BY 1),
usable AS (SELECT entity FROM cover WHERE direct_terms = assessed_terms {gate}),
w AS (SELECT entity, level, term, ic FROM prof JOIN ic USING (term) JOIN usable USING (entity) WHERE ic > 0),
s AS (SELECT entity, sum(ic) AS total FROM w GROUP BY 1),
pairs AS (SELECT x.level, x.entity AS a, y.entity AS b, sum(x.ic) AS shared FROM w x JOIN w y
  ON x.level = y.level AND x.term = y.term AND x.entity <> y.entity GROUP BY 1, 2, 3),
cards AS (SELECT level, a, b, shared, sa.total + sb.total - shared AS union_weight,
    round(shared / (sa.total + sb.total - shared), 12) AS score,
    row_number() OVER (PARTITION BY a ORDER BY round(shared / (sa.total + sb.total - shared), 12) DESC, b) AS rank
  FROM pairs JOIN s sa ON sa.entity = a JOIN s sb ON sb.entity = b QUALIFY rank <= 3)"""
CARDS_SQL = PROFILE_SQL + CARDS_TAIL.replace("{gate}", "")
CARDSG_SQL = PROFILEG_SQL + CARDS_TAIL.replace(
    "{gate}",
    """AND entity NOT IN (SELECT entity FROM ann WHERE aspect = 'P'
  GROUP BY entity, term HAVING bool_or(negated) AND bool_or(NOT negated))""",
)


def reviews(t: Tables) -> DataFrame:
    """events as an append-only review log."""
    decision = (
        F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "needs_context")
        .otherwise("accepted")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.when(F.col("user_id") % 3 == 0, "context").otherwise("assertion").alias("target_type"),
        F.col("user_id").alias("target_id"), F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("reviewed_at"), decision.alias("decision"),
        F.concat(F.lit("h"), F.floor(k / 50).cast("string")).alias("target_hash"),
    )


REVIEWS_SQL = """reviews AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'context' ELSE 'assertion' END AS target_type,
  user_id AS target_id, event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS reviewed_at,
  CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'needs_context' ELSE 'accepted' END AS decision,
  'h' || (CAST(json_extract(props, '$.k') AS INT) // 50) AS target_hash FROM events)"""


def targets(t: Tables) -> DataFrame:
    """Review targets: customers, of which only some were ever reviewed, with a current content hash."""
    return t.customer.select(
        F.when(F.col("c_custkey") % 3 == 0, "context").otherwise("assertion").alias("target_type"),
        F.col("c_custkey").alias("target_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("h"), (F.col("c_custkey") % 2).cast("string")))
        .alias("current_hash"),
    )


TARGETS_SQL = """targets AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'context' ELSE 'assertion' END AS target_type,
  c_custkey AS target_id, CASE WHEN c_custkey % 7 <> 0 THEN 'h' || (c_custkey % 2) END AS current_hash FROM customer)"""
LATEST_SQL = """latest AS (SELECT * FROM reviews
  QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY reviewed_at DESC, id DESC) = 1)"""
STATES_SQL = f"""{REVIEWS_SQL},
{TARGETS_SQL},
{LATEST_SQL},
states AS (SELECT t.target_type, t.target_id, t.current_hash,
  CASE WHEN l.id IS NOT NULL AND l.target_hash = t.current_hash THEN l.decision ELSE 'pending' END AS state,
  l.id IS NOT NULL AND l.target_hash IS DISTINCT FROM t.current_hash AS stale, l.id AS review_id
  FROM targets t LEFT JOIN latest l USING (target_type, target_id))"""


def line_id() -> F.Column:
    return F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


LINE_ID_SQL = "'line:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


def claims(t: Tables) -> DataFrame:
    """lineitem as claims supplier -> part, one row per claim and piece of evidence."""
    status = (
        F.when(F.col("l_returnflag") == "R", "negated").when(F.col("l_returnflag") == "A", "reported_result")
        .otherwise(F.when(F.col("l_linestatus") == "O", "planned").otherwise("listed_record"))
    )
    direction = (
        F.when(F.col("l_quantity") >= 40, "improves").when(F.col("l_quantity") <= 10, "worsens").otherwise("unknown")
    )
    return t.lineitem.select(
        F.concat(F.lit("supplier:"), "l_suppkey").alias("subject"), F.lit("has_phenotype").alias("predicate"),
        F.concat(F.lit("part:"), "l_partkey").alias("object"), status.alias("statement_status"),
        direction.alias("effect_direction"), line_id().alias("evidence"), F.col("l_orderkey").alias("source"),
        F.when(F.col("l_linestatus") == "F", "source_adapter").otherwise("manual_import").alias("origin"),
        "l_suppkey", "l_partkey", "l_quantity",
    )


CLAIMS_SQL = f"""claims AS (SELECT 'supplier:' || l_suppkey AS subject, 'has_phenotype' AS predicate,
  'part:' || l_partkey AS object,
  CASE WHEN l_returnflag = 'R' THEN 'negated' WHEN l_returnflag = 'A' THEN 'reported_result'
       WHEN l_linestatus = 'O' THEN 'planned' ELSE 'listed_record' END AS statement_status,
  CASE WHEN l_quantity >= 40 THEN 'improves' WHEN l_quantity <= 10 THEN 'worsens' ELSE 'unknown' END AS effect_direction,
  {LINE_ID_SQL} AS evidence, l_orderkey AS source,
  CASE WHEN l_linestatus = 'F' THEN 'source_adapter' ELSE 'manual_import' END AS origin,
  l_suppkey, l_partkey, l_quantity FROM lineitem)"""


def kg_edges(t: Tables) -> DataFrame:
    """The star schema as typed edges: (id, subject, predicate, object)."""
    def edge(df, pred, sub, obj, key):
        return df.select(
            F.concat_ws(":", F.lit(pred), *key).alias("id"), sub.alias("subject"), F.lit(pred).alias("predicate"),
            obj.alias("object"),
        )

    def node(kind, col):
        return F.concat(F.lit(kind + ":"), F.col(col).cast("string"))

    ps = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    op = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return (
        edge(t.orders, "placed", node("customer", "o_custkey"), node("order", "o_orderkey"), ["o_orderkey"])
        .unionByName(edge(op, "contains", node("order", "l_orderkey"), node("part", "l_partkey"), ["l_orderkey", "l_partkey"]))
        .unionByName(edge(ps, "supplied_by", node("part", "l_partkey"), node("supplier", "l_suppkey"), ["l_partkey", "l_suppkey"]))
        .unionByName(edge(t.supplier, "located_in", node("supplier", "s_suppkey"), node("nation", "s_nationkey"), ["s_suppkey"]))
        .unionByName(edge(t.nation, "part_of", node("nation", "n_nationkey"), node("region", "n_regionkey"), ["n_nationkey"]))
    )


KG_SQL = """kg AS (
  SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS subject, 'placed' AS predicate, 'order:' || o_orderkey AS object FROM orders
  UNION ALL SELECT DISTINCT 'contains:' || l_orderkey || ':' || l_partkey, 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplied_by:' || l_partkey || ':' || l_suppkey, 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'located_in:' || s_suppkey, 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'part_of:' || n_nationkey, 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey FROM nation)"""


def kg_nodes(t: Tables) -> DataFrame:
    """(id, type, label, kind)."""
    def nodes(df, kind, key, label, extra=None):
        return df.select(
            F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"),
            label.alias("label"), (extra if extra is not None else F.lit(None).cast("string")).alias("kind"),
        )

    return (
        nodes(t.customer, "customer", "c_custkey", F.col("c_name"))
        .unionByName(nodes(t.orders, "order", "o_orderkey", F.concat(F.lit("Order "), "o_orderkey")))
        .unionByName(nodes(t.part, "part", "p_partkey", F.col("p_name"), F.col("p_type")))
        .unionByName(nodes(t.supplier, "supplier", "s_suppkey", F.col("s_name")))
        .unionByName(nodes(t.nation, "nation", "n_nationkey", F.col("n_name")))
        .unionByName(nodes(t.region, "region", "r_regionkey", F.col("r_name")))
    )


NODES_SQL = """nodes AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS label, NULL AS kind FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order ' || o_orderkey, NULL FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_type FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, NULL FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, NULL FROM region)"""


def names(t: Tables) -> DataFrame:
    """Alias table over named rows: (entity, type, alias, alias_type)."""
    def rows(df, kind, key, label, alias_type="label"):
        return df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("entity"),
                         F.lit(kind).alias("type"), F.col(label).alias("alias"), F.lit(alias_type).alias("alias_type"))

    return (
        rows(t.part, "part", "p_partkey", "p_name").unionByName(rows(t.supplier, "supplier", "s_suppkey", "s_name"))
        .unionByName(rows(t.customer, "customer", "c_custkey", "c_name"))
        .unionByName(rows(t.nation, "nation", "n_nationkey", "n_name"))
        .unionByName(rows(t.region, "region", "r_regionkey", "r_name"))
        .unionByName(rows(t.part, "part", "p_partkey", "p_brand", "related_synonym"))
    )


NAMES_SQL = """names AS (SELECT 'part:' || p_partkey AS entity, 'part' AS type, p_name AS alias, 'label' AS alias_type FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'label' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'label' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'label' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, 'label' FROM region
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_brand, 'related_synonym' FROM part)"""
