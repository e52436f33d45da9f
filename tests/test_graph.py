import random
from collections import deque
from itertools import islice

import pytest
from pyspark.sql import functions as F

from claimweave.operators import graph
from claimweave.session import bucketed, cut_lineage
from tests.conftest import rows


def test_closure_with_shared_ancestor_and_dangling_parent(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "gone")], "child string, parent string")
    got = set(rows(graph.transitive_closure(e)))
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("b", "b"), ("b", "d"), ("c", "c"), ("c", "d"), ("d", "d"), ("x", "x"), ("x", "gone"), ("gone", "gone")}
    assert rows(graph.subtree(graph.transitive_closure(e), "d")) == [("a",), ("b",), ("c",), ("d",)]


def test_deep_chain(spark):
    n = 12
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "child int, parent int")
    assert graph.transitive_closure(e).count() == (n + 1) * (n + 2) // 2


def test_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")], "child string, parent string")
    assert rows(graph.cycle_nodes(e)) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(graph.cycle_nodes(e.filter("child <> 'c'"))) == []


def endless(edges):
    """Kahn's peeling from the top, edge by edge."""
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    while True:
        gone = {c for c, ps in up.items() if not ps & up.keys()}
        if not gone:
            return sorted((c,) for c in up)
        for c in gone:
            del up[c]


def test_cycles_match_peeling(spark):
    for seed in range(6):
        rng = random.Random(seed)
        n, m = rng.choice([(12, 14), (40, 38), (60, 80)])
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        if seed % 2:  # mostly upwards, so that long ways without a cycle occur
            edges = [(max(a, b), min(a, b)) for a, b in edges if a != b] + edges[:2]
        edges += [(1000 + i, 1001 + i) for i in range(9)]  # a chain
        got = rows(graph.cycle_nodes(spark.createDataFrame(edges, "child int, parent int")))
        assert got == endless(edges)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, name="cut": cuts.append(name) or cut_lineage(df, name))
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    assert graph.cycle_nodes(chain).count() == 0 and cuts.count("jumps") < 30
    cuts.clear()
    ring = chain.unionByName(spark.range(1).select(F.lit(n).alias("child"), F.lit(n // 2).alias("parent")))
    assert graph.cycle_nodes(ring).count() == n + 1 and cuts.count("jumps") < 30


def test_shortest_chain_prefers_early_parents(spark):
    e = spark.createDataFrame([("s", "p", 0), ("s", "q", 1), ("p", "t", 0), ("q", "t", 0), ("t", "u", 0), ("u", "v", 0), ("v", "w", 0)],
                              "child string, parent string, pos int")
    got = {r.ancestor: (r.depth, r.chain) for r in graph.shortest_chains(e, spark.createDataFrame([("s",)], "start string")).collect()}
    assert got["t"] == (2, ["s", "p", "t"]) and got["v"][0] == 4 and "w" not in got


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200, i) for i in range(201, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = sorted((n, find(n)) for n in parent)
    assert rows(graph.connected_components(spark.createDataFrame(links, "a int, b int"))) == want


def kg(spark, edges):
    return graph.two_way(spark.createDataFrame([(f"e{i}", a, p, b) for i, (a, p, b) in enumerate(edges)], "id string, subject string, predicate string, object string"))


def test_paths_are_shortest_continuous_and_avoid_mentions(spark):
    e = kg(spark, [("a", "p", "b"), ("b", "p", "z"), ("a", "p", "c"), ("c", "p", "z"), ("a", "p", "d"), ("d", "p", "z"), ("a", "q", "f"), ("f", "q", "z"), ("a", "mentions", "z")])
    got = {}
    for r in graph.shortest_paths(e, "a", "z").orderBy("path_no", "step").collect():
        got.setdefault(r.path_no, []).append((r.from_node, r.to_node))
    assert got == {1: [("a", "b"), ("b", "z")], 2: [("a", "c"), ("c", "z")], 3: [("a", "d"), ("d", "z")]}
    assert graph.shortest_paths(e, "a", "nowhere").count() == 0
    assert graph.shortest_paths(kg(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d")]), "a", "d", max_length=2).count() == 0


def reference_paths(edges, start, goal, most, paths=3):
    by = {}
    for i, (a, p, b) in enumerate(edges):
        by.setdefault(a, []).append((p, f"e{i}", b))
        by.setdefault(b, []).append((p, f"e{i}", a))
    depth, parents, frontier = {start: 0}, {start: []}, [start]
    while frontier and goal not in depth and depth[frontier[0]] < most:
        after = []
        for n in frontier:
            for p, link, o in sorted(by.get(n, [])):
                if o not in depth:
                    depth[o], parents[o] = depth[n] + 1, []
                    after.append(o)
                if depth[o] == depth[n] + 1 and len(parents[o]) < paths and all(q != n for q, _ in parents[o]):
                    parents[o].append((n, link))
        frontier = after

    def walk(node):
        if node == start:
            yield []
        for n, link in parents.get(node, []):
            yield from ([*way, (n, node, link)] for way in walk(n))

    return list(islice(walk(goal), paths)) if goal in depth and start != goal else []


def test_paths_match_breadth_first_search(spark):
    for seed in range(5):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(30)}", rng.choice("pq"), f"n{rng.randrange(30)}") for _ in range(50)]
        links = bucketed(kg(spark, edges), "node")
        for goal in ("n1", "n7", "n12"):
            got = {}
            for r in graph.shortest_paths(links, "n0", goal, max_length=4).orderBy("path_no", "step").collect():
                got.setdefault(r.path_no, []).append((r.from_node, r.to_node, r.link_id))
            assert [got[k] for k in sorted(got)] == reference_paths(edges, "n0", goal, 4)


def test_paths_read_the_edges_once_a_step(spark, monkeypatch):
    edges = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("b", "q", "c2"), ("c2", "p", "d"), ("d", "p", "e"), ("x", "p", "e")]
    links = bucketed(kg(spark, edges), "node")
    stored, cut, reads = set(links.inputFiles()), graph.cut_lineage, []

    def spy(df, name="cut"):
        reads.append(bool(stored & set(df.inputFiles())))
        return cut(df, name)

    monkeypatch.setattr(graph, "cut_lineage", spy)
    found = graph.shortest_paths(links, "a", "e").orderBy("path_no", "step").collect()
    assert [(r.path_no, r.from_node, r.to_node) for r in found] == [(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "d", "e"), (2, "a", "b"), (2, "b", "c2"), (2, "c2", "d"), (2, "d", "e")]
    assert sum(reads) == 4


def reference_neighborhood(edges, focus, depth, max_nodes, max_links):
    by = {}
    for i, (a, p, b) in enumerate(edges):
        by.setdefault(a, []).append((p, f"e{i}", b))
        if a != b:
            by.setdefault(b, []).append((p, f"e{i}", a))
    nodes, links, queue, cut = [focus], [], deque([(focus, 0)]), False
    while queue:
        n, d = queue.popleft()
        if d >= depth:
            continue
        for p, lid, o in sorted(by.get(n, [])):
            if o not in nodes:
                if len(nodes) >= max_nodes:
                    cut = True
                    continue
                nodes.append(o)
                queue.append((o, d + 1))
            if lid not in links:
                if len(links) >= max_links:
                    cut = True
                    continue
                links.append(lid)
    return sorted(nodes), sorted(links), cut


def test_neighborhood_matches_queue(spark):
    rng = random.Random(9)
    for max_nodes, max_links in ((60, 100), (9, 100), (12, 10)):
        edges = [(f"n{rng.randrange(25)}", rng.choice("pqr"), f"n{rng.randrange(25)}") for _ in range(60)]
        edges = [x for x in edges if x[0] != x[2]] + [("n0", "p", "n1")]
        nodes, links = graph.bounded_neighborhood(kg(spark, edges), "n0", 2, max_nodes, max_links)
        want = reference_neighborhood(edges, "n0", 2, max_nodes, max_links)
        assert (sorted(r.node for r in nodes.collect()), sorted(r.link_id for r in links.collect()), nodes.first().truncated) == want


def map_branch(spark, name, pairs):
    return spark.createDataFrame([(f"{i:03d}", f"{name}{i}", a, b, name) for i, (a, b) in enumerate(pairs)], "key string, link_id string, source string, target string, relation string")


def slow_map(contexts, steps, max_nodes, max_links):
    """The budgets step by step; a step is (name, pairs, whether it only joins nodes that are there)."""
    nodes, links = sorted(contexts)[:max_nodes], []
    for name, pairs, present_only in steps:
        there, pairs_seen = list(nodes), set()
        for i, ends in enumerate(pairs):
            if present_only and (ends in pairs_seen or not set(ends) <= set(there)):
                continue
            pairs_seen.add(ends)
            if len(links) == max_links:
                return nodes, links
            for n in ends:
                if n in nodes:
                    continue
                if len(nodes) == max_nodes:
                    break
                nodes.append(n)
            if set(ends) <= set(nodes):
                links.append(f"{name}{i}")
    return nodes, links


def test_whole_map_keeps_to_both_budgets(spark):
    rng = random.Random(9)
    for max_nodes, max_links in ((4, 4), (6, 5), (8, 30), (3, 30), (20, 9)):
        names = [f"n{i}" for i in range(12)]
        pick = lambda k: [tuple(rng.sample(names, 2)) for _ in range(k)]
        contexts, first, second, records, third = names[:3], pick(5), pick(5), pick(25) + pick(5), pick(6)
        nodes, links = graph.whole_map(
            spark.createDataFrame([(c,) for c in contexts], "node string"), [map_branch(spark, "x", first), map_branch(spark, "y", second), map_branch(spark, "z", third)],
            (2, map_branch(spark, "r", records)), max_nodes, max_links)
        want = slow_map(contexts, [("x", first, False), ("y", second, False), ("r", records, True), ("z", third, False)], max_nodes, max_links)
        assert (sorted(r.node for r in nodes.collect()), sorted(r.link_id for r in links.collect())) == (sorted(want[0]), sorted(want[1]))


def test_both_ends_come_from_one_reading(spark, tmp_path):
    spark.createDataFrame([("e0", "a", "p", "b"), ("e1", "c", "p", "c")], "id string, subject string, predicate string, object string").write.parquet(str(tmp_path / "edges"))
    ends = graph.two_way(spark.read.parquet(str(tmp_path / "edges")))
    assert ends._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.node, r.other, r.outgoing) for r in ends.collect()) == [("a", "b", True), ("b", "a", False), ("c", "c", True)]


@pytest.mark.parametrize("crowd", [0, 12, 100_000])
def test_pages_are_the_same_for_crowded_and_other_nodes(spark, crowd):
    """A node with many links, a link to itself, equal ends, ends without a label; all, some or no nodes are cut before the shuffle."""
    rng = random.Random(4)
    links = [("hub", rng.choice("pq"), f"n{i % 17}") for i in range(40)] + [("hub", "p", "hub")] + [tuple(rng.choice(x) for x in (["a", "b", "c"], "pq", ["b", "c", "d"])) for _ in range(9)]
    labels = {"hub": "Hub", "a": "A", "n1": "N1", "x": "X"}
    want = []
    seen = {}
    for i, (s, p, o) in enumerate(links):
        seen.setdefault(s, []).append((p, f"e{i}", 0, o))
        if s != o:
            seen.setdefault(o, []).append((p, f"e{i}", 1, s))
    for node, found in seen.items():
        for pos, (p, link, way, other) in enumerate(sorted(found)[:5], 1):
            want.append((node, pos, p, ("outgoing", "incoming")[way], other, labels.get(other, other), link, len(found), len(found) > 5))
    got = graph.entity_page(kg(spark, links), spark.createDataFrame(list(labels.items()), "id string, label string"), 5, crowd=crowd)
    assert rows(got) == sorted(want)
