"""Queries and their SQL twins on small tables with the odd rows on which they once differed."""

import html
import random

import duckdb
import pytest

import __spark_entry__ as entry
from claimweave.operators import filters, joins
from claimweave.plans.scalars import NAMED_SQL, PLACED_SQL, unescape_sql
from tools.check_queries import rows_of

TABLES = {
    "region": "SELECT range AS r_regionkey, 'REGION_' || range AS r_name FROM range(2)",
    "nation": "SELECT range AS n_nationkey, 'NATION_' || range AS n_name, range % 2 AS n_regionkey FROM range(4)",
    "supplier": "SELECT range AS s_suppkey, 'Supplier ' || range AS s_name, CAST(range % 4 AS INT) AS s_nationkey, range * 10.0 AS s_acctbal FROM range(8)",
    "customer": "SELECT range AS c_custkey, 'Customer ' || range AS c_name, CAST(range % 4 AS INT) AS c_nationkey, 1.0 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(5)",
    "part": "SELECT range AS p_partkey, 'part ' || range % 3 AS p_name, 'Brand' || range % 2 AS p_brand, 'T' AS p_type, CAST(range AS INT) AS p_size, 1.0 AS p_retailprice FROM range(6)",
    "pages": """SELECT * FROM (VALUES (1, 'https://a.org/x', '<title>fish &amp</title><p>one &copy 2 &ampnbsp; &notin; &#150;&#x41 &lt;b&gt;</p>'),
      (10, 'https://a.org/x', '<p>caf&eacute &quot;x&quot' || chr(13) || chr(10) || 'y&#8195;</p>'), (3, 'https://blog.org/', '<h1>cut &am</h1>z'), (20, NULL, '<p>a</p>'), (5, NULL, '<p>b</p>')) AS p(page_id, url, html)""",
}


@pytest.fixture()
def con(folder):
    c = duckdb.connect()
    for name, rows in TABLES.items():
        c.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def both(spark, con, folder, name):
    df = entry.queries()[name](spark, str(folder))
    res = con.execute(entry.oracle_sql()[name])
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([d[0] for d in res.description], res.fetchall())


def test_alias_candidates_of_every_identifier(spark, con, folder):
    got, want = both(spark, con, folder, "alias_candidates")
    assert got == want
    assert len([r for r in got[1] if r[3].startswith("'part:")]) == 6


def test_alias_lookup_of_every_identifier(spark, con, folder):
    got, want = both(spark, con, folder, "alias_lookup")
    assert got == want


def test_approved_pages_share_an_address(spark, con, folder):
    got, want = both(spark, con, folder, "approved_pages")
    assert got == want
    assert dict(got[1]) == {"1": "'page'", "10": "'page'", "3": "'prefix'", "20": "'rejected'", "5": "'rejected'"}


def test_character_references_in_sql():
    rng = random.Random(1)
    bits = ["&", "amp", "#", "x", "lt", ";", "6", "9", "a", "not", "in", " ", "\n", "é", "copy", "&#150;", "&#0;", "&#55296;", "&#11;", "mdash;", *html.entities.html5]
    texts = ["".join(rng.choices(bits[:20], k=6)) for _ in range(300)] + ["&" + name for name in bits[20:]]
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT unnest($1) AS x", [texts])
    got = c.execute(f"SELECT x, {unescape_sql('x')} FROM t, (SELECT {NAMED_SQL} AS named, {PLACED_SQL} AS placed)").fetchall()
    assert [(x, y) for x, y in got if (y or "") != html.unescape(x)] == []


def test_html_text_of_open_references(spark, con, folder):
    got, want = both(spark, con, folder, "html_text")
    assert got == want


def test_web_page_sections_of_open_references(spark, con, folder):
    got, want = both(spark, con, folder, "web_page_sections")
    assert got == want


def test_web_pages_of_open_references(spark, con, folder):
    got, want = both(spark, con, folder, "web_pages")
    assert got == want


def test_candidate_cards_name_the_feature_of_late_members(spark, con, folder):
    """Twenty suppliers of one band; the last two share a rare term: their card has both reasons."""
    tables = {
        "supplier": "SELECT range AS s_suppkey, 'S' || range AS s_name, CAST(0 AS INT) AS s_nationkey, 50.0 AS s_acctbal FROM range(20)",
        "part": "SELECT range AS p_partkey, 'part ' || range AS p_name, 'Brand' || range AS p_brand, 'T' || range AS p_type, 1 AS p_size FROM range(22)",
        "lineitem": """SELECT l_partkey, l_suppkey, 'N' AS l_returnflag, 'F' AS l_linestatus, 1.0 AS l_quantity
          FROM (SELECT range AS l_partkey, range AS l_suppkey FROM range(20) UNION ALL SELECT 21, 18 + range FROM range(2))""",
    }
    for name, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got, want = both(spark, con, folder, "candidate_cards")
    assert got == want
    assert len([r for r in got[1] if "'shared terms and mechanism features'" in r]) == 2


def test_assertion_problems_of_repeated_lines(spark, con, folder):
    """Lines that repeat but for stance or quantity, supports under another assertion, claims without one: each problem once."""
    tables = {
        "customer": "SELECT range AS c_custkey, 1.0 AS c_acctbal FROM range(8)",
        "part": "SELECT range AS p_partkey, CAST(CASE range WHEN 7 THEN 2 WHEN 11 THEN 50 ELSE 9 END AS INT) AS p_size FROM range(12)",
        "orders": "SELECT range AS o_orderkey, ['O', 'F', 'P'][range % 3 + 1] AS o_orderstatus, ['1-URGENT', '5-LOW'][range % 2 + 1] AS o_orderpriority FROM range(20)",
        "lineitem": """SELECT range % 23 AS l_orderkey, range % 12 AS l_partkey, range % 3 AS l_suppkey, CAST(1 + range % 7 AS INT) AS l_linenumber, CASE WHEN range % 5 = 0 THEN 13.0 ELSE 1.0 * copy END AS l_quantity,
          CASE WHEN range % 4 = 1 THEN 'R' ELSE ['R', 'A', 'N'][(range + copy) % 3 + 1] END AS l_returnflag, ['F', 'O'][(range // 5 + copy) % 2 + 1] AS l_linestatus FROM range(150), range(3) AS c(copy)""",
    }
    for name, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got, want = both(spark, con, folder, "assertion_problems")
    assert got == want
    kinds = ("missing or", "cites missing", "not captured", "cannot support", "no supporting", "does not exist", "context's disease", "no variant", "no current", "no phenotype")
    assert [k for k in kinds if not any(k in r[1].replace("\\'", "'") for r in got[1])] == []


def test_assertion_problems_moves_lines_little(spark, con, folder):
    """Claims travel once and the lines four times: as evidence, as supports, as checked supports and as references."""
    con.execute(f"COPY (SELECT range AS l_orderkey, range AS l_partkey, range AS l_suppkey, 1 AS l_linenumber, 1.0 AS l_quantity, 'N' AS l_returnflag, 'F' AS l_linestatus FROM range(100)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT range AS o_orderkey, 'O' AS o_orderstatus, '5-LOW' AS o_orderpriority FROM range(100)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    plan = entry.queries()["assertion_problems"](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 + 3  # the four uses of the claims are one exchange when it runs


def test_affected_assertions_are_those_with_a_changed_dependency(spark):
    """What changed leads back to the same assertions as the whole expansion does, over nulls, members and mappings."""
    rng = random.Random(4)
    pick = lambda kind, n, none=0.0: None if rng.random() < none else f"{kind}:{rng.randrange(n)}"
    a = spark.createDataFrame([(f"a{i}", pick("e", 60), pick("e", 60, 0.2), pick("c", 20, 0.5)) for i in range(300)], "assertion string, subject string, object string, context string")
    members = spark.createDataFrame([(f"c:{i}", pick("e", 60)) for i in range(20) for _ in range(2)], "context string, member string")
    maps = spark.createDataFrame([(f"m:{i}", pick("e", 60)) for i in range(15)], "mapping string, entity string")
    diff = spark.createDataFrame([(pick(kind, 60), rng.choice(["changed", "removed", "appended"])) for kind in "ecm" for _ in range(6)], "id string, change string")
    gone = {r.id for r in diff.collect() if r.change != "appended"}
    want = sorted({r.assertion for r in joins.dependencies(a, members, maps).collect() if r.depends_on in gone})
    found = joins.affected(a, members, maps, diff)
    assert sorted(r.assertion for r in found.collect()) == want and 0 < len(want) < 300


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covered_sets_count_rows_as_they_come(spark):
    """Repeated items and covers change nothing, and no table of distinct items is built: covers alone are made distinct."""
    rng = random.Random(5)
    sets = [(s, rng.randrange(6)) for s in range(40) for _ in range(rng.randrange(1, 5))]
    covers = [(c, i) for c in range(5) for i in range(6) if (c + i) % 3] * 2
    found = joins.covered_sets(spark.createDataFrame(sets, "set_id int, item int"), spark.createDataFrame(covers, "cover_id int, item int"))
    want = {(s, c) for s, _ in sets for c in range(5) if all((c, i) in covers for x, i in sets if x == s)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "keys=[set_id" in plan_of(found) and not any("keys=[set_id" in line and "item" in line for line in plan_of(found).splitlines())


def test_community_anchors_take_first_records_without_sorting(spark, con, folder):
    """Only the few rows left per entity, anchor and predicate are compared as structs."""
    rng = random.Random(6)
    direct = [(f"e{rng.randrange(5)}", f"a{rng.randrange(3)}", rng.choice("pq"), rng.randrange(50)) for _ in range(12)]
    links = [(f"e{rng.randrange(9)}", rng.randrange(8), rng.choice("rs"), rng.randrange(50)) for _ in range(40)]
    anchors = [(rng.randrange(8), f"a{rng.randrange(4)}") for _ in range(20)]
    found = joins.community_anchors(
        spark.createDataFrame(direct, "entity string, anchor string, predicate string, record long"), spark.createDataFrame(links, "entity string, project int, predicate string, record long"),
        spark.createDataFrame(anchors, "project int, anchor string"), spark.createDataFrame([("e3",)], "entity string"))
    assert plan_of(found).count("SortAggregate") == 2
    best = {}
    for e, a, way, r, p in [(e, a, 0, r, p) for e, a, p, r in direct] + [(e, a, 1, r, p) for e, q, p, r in links for x, a in anchors if x == q]:
        if e != "e3":
            best[e, a] = min(best.get((e, a), (9,)), (way, r, p))
    assert {(r.entity, r.anchor): (r.record, r.predicate) for r in found.collect()} == {k: v[1:] for k, v in best.items()}


def test_community_overlap_leaves_related_contexts_first(spark):
    """Members of contexts that do not count are not made distinct, and repeated members count once."""
    members = [(1, 10, True), (1, 11, False), (2, 10, True), (2, 10, True), (2, 11, False), (3, 10, True), (4, 11, False), (4, 11, False), (5, 12, True)]
    found = joins.community_overlap(
        1, spark.createDataFrame(members, "context int, member long, is_person boolean"), spark.createDataFrame([(c, c % 4) for c in range(1, 6)], "context int, disease int"),
        spark.createDataFrame([(1, 1), (3, 1), (2, 2)], "context int, gene int"))
    assert [tuple(r) for r in found.collect()] == [(2, 2, 1), (4, 1, 0)]
    plan = plan_of(found)
    assert 0 <= plan.index("LeftSemi") < plan.index("LeftAnti")  # the anti join lies below


def test_contract_rules_do_not_deal_edges_by_predicate(spark):
    """A handful of predicates would leave the edges in as many tasks."""
    edges = spark.range(50).selectExpr("cast(id as string) id", "'a:1' subject", "if(id % 2 = 0, 'p', 'q') predicate", "'b:1' object", "'unknown' effect_direction", "'x' outcome_text")
    nodes = spark.createDataFrame([("a:1", "a", None), ("b:1", "asset", "K")], "id string, type string, kind string")
    found = filters.contract_problems(edges, nodes, filters.rules_frame(edges, {"p": (("a", "c"), ("asset",), "L", True), "r": (("a",), ("b",), None, False)}))
    assert "hashpartitioning(predicate" not in plan_of(found)
    assert {r.problem for r in found.collect()} == {"unknown predicate", "wrong asset kind", "direction and outcome required"} and found.count() == 75
