"""Graph operators: hierarchies, components, neighbourhoods and paths over edge tables.

Iterations join a frontier with the edge table and cut lineage by a written table. A frontier only ever holds rows that
are new, and the leaves of a hierarchy, which are nearly all of it, are joined once at the end instead of in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimweave.functions.vocab import GRAPH_LINKS, GRAPH_NODES, PATHS
from claimweave.session import cut_lineage

BUCKETS = 1 << 16  # of node names, in which links are counted before a page of each node is made
CROWD = 100_000  # links of a bucket beyond which its nodes are cut before they are shuffled


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(child, parent) edges to (node, ancestor), each node its own ancestor, every pair once.

    Parents that are no node themselves are kept as ancestors.
    """
    edges = edges.select("child", "parent").distinct()
    inner = cut_lineage(edges.select(F.col("parent").alias("child")).distinct(), "inner-nodes")
    inner_edges = cut_lineage(edges.join(inner, "child", "left_semi"), "inner-edges")
    known = inner.select(F.col("child").alias("node"), F.col("child").alias("ancestor"))
    frontier = known
    while True:
        step = (
            frontier.join(inner_edges, frontier.ancestor == inner_edges.child)
            .select("node", F.col("parent").alias("ancestor"))
            .distinct()
            .join(known, ["node", "ancestor"], "left_anti")
        )
        frontier = cut_lineage(step, "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)  # a union of written tables, one per level
    inner_closure = known
    leaves = edges.join(inner, "child", "left_anti")
    via_parents = (
        leaves.join(inner_closure, leaves.parent == inner_closure.node)
        .select(leaves.child.alias("node"), "ancestor")
        .distinct()
    )
    itself = leaves.select(F.col("child").alias("node"), F.col("child").alias("ancestor")).distinct()
    return inner_closure.unionByName(via_parents).unionByName(itself)


def subtree(closure: DataFrame, root: str) -> DataFrame:
    """Nodes at or below ``root``."""
    return closure.filter(F.col("ancestor") == root).select("node").distinct()


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on or below a cycle, that is those from which parents can be followed without end.

    Leaves, nearly all of a hierarchy, are joined once at the end. Above them three steps alternate: parents that have no
    parents are trimmed; a node with one way up points to where its way ends, found by pointer jumping, so a chain takes
    as many rounds as the logarithm of its length; and a node with an endless parent is endless itself. Edges that only
    repeat after this contraction go. When nothing changes any more, every node left has a parent left.
    """
    edges = cut_lineage(edges.select("child", "parent").distinct(), "cycle-edges")
    inner = edges.select(F.col("parent").alias("child")).distinct()
    endless = cut_lineage(_endless(edges.join(inner, "child", "left_semi")), "endless")
    below = edges.join(endless.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node"))
    return endless.unionByName(below).distinct()


def _endless(edges: DataFrame) -> DataFrame:
    """(node) of all nodes with an endless way up. A null parent stands for one that is known to be endless."""
    kind = edges.schema["child"].dataType
    itself = F.when(F.col("parent") != F.col("child"), F.col("parent"))
    left = cut_lineage(edges.select("child", itself.alias("parent")).distinct(), "ways")
    decided: list[DataFrame] = []  # (node, to): the fate of a node is that of where it leads
    before = -1
    while True:
        trimmed = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")
        left = cut_lineage(trimmed.unionByName(left.filter("parent IS NULL").select("child", "parent")), "ways")
        ways = left.groupBy("child").agg(F.count("*").alias("n"), F.bool_or(F.col("parent").isNull()).alias("sure"), F.min("parent").alias("first"))
        ways = cut_lineage(ways.select("child", ((F.col("n") == 1) | F.col("sure")).alias("one"), F.when(~F.col("sure"), F.col("first")).alias("first"), "n"), "ways-up")
        now = left.count()
        if now == 0:
            break
        single = ways.filter("one").select(F.col("child").alias("node"), F.col("first").alias("to"))
        if now == before and single.isEmpty():
            decided.append(ways.select(F.col("child").alias("node"), F.lit(None).cast(kind).alias("to")))
            break
        leads = _jumped(single)
        decided.append(leads)
        via = leads.select(F.col("node").alias("parent"), "to", F.lit(True).alias("leads"))
        rest = left.join(leads.select(F.col("node").alias("child")), "child", "left_anti").join(via, "parent", "left")
        target = F.when(F.col("leads"), F.col("to")).otherwise(F.col("parent"))
        rest = rest.select("child", target.alias("parent")).select("child", itself.alias("parent")).distinct()
        before = now if single.isEmpty() else -1
        left = cut_lineage(rest, "ways")
    endless = edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}")
    for leads in reversed(decided):
        more = leads.filter("to IS NULL").select("node").unionByName(leads.join(endless.select(F.col("node").alias("to")), "to", "left_semi").select("node"))
        endless = cut_lineage(endless.unionByName(more), "endless")
    return endless


def _jumped(single: DataFrame) -> DataFrame:
    """(node, to) with ``to`` moved to the end of the way; null if it runs in a circle. Each round doubles the step."""
    names = single.select(F.col("node").alias("to"), F.lit(True).alias("more"))
    step = cut_lineage(single.join(names, "to", "left").select("node", "to", F.coalesce("more", F.lit(False)).alias("open")), "jumps")
    waiting = step.filter("open").count()
    while waiting:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("open").alias("still"))
        moved = step.filter("open").join(ahead, "to").select("node", F.col("next").alias("to"), F.col("still").alias("open"))
        step = cut_lineage(moved.unionByName(step.filter("NOT open")), "jumps")
        left = step.filter("open").count()
        if left == waiting:  # no way of the next length ends: the rest are circles
            break
        waiting = left
    return step.select("node", F.when(~F.col("open"), F.col("to")).alias("to"))


def shortest_chains(edges: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """(start, ancestor, depth, chain): one shortest chain per ancestor, ties by parent order along the chain.

    ``edges`` has (child, parent, pos); ``starts`` has (start). A chain stops where an ancestor was reached earlier.
    """
    level = starts.select(
        "start", F.col("start").alias("at"), F.array("start").alias("chain"), F.array().cast("array<int>").alias("order")
    )
    levels = []
    seen = level.select("start", "at")
    for depth in range(1, max_depth + 1):
        reached = (
            level.join(edges, level["at"] == edges["child"])
            .select(
                "start",
                F.col("parent").alias("at"),
                F.concat("chain", F.array("parent")).alias("chain"),
                F.concat("order", F.array("pos")).alias("order"),
            )
            .join(seen, ["start", "at"], "left_anti")
        )
        best = reached.groupBy("start", "at").agg(F.min_by(F.struct("chain", "order"), F.col("order")).alias("b"))
        level = cut_lineage(best.select("start", "at", "b.chain", "b.order"), "chains")
        levels.append(level.select("start", F.col("at").alias("ancestor"), F.lit(depth).alias("depth"), "chain"))
        seen = seen.unionByName(level.select("start", "at"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) undirected links to (node, component), the component named by its smallest node.

    Alternates two steps: every node tells its larger neighbours about its smallest one, then smaller ones. Both are
    grouped minima and joins, so a node with very many links is never gathered in one place.
    """
    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """The edges as a table, with what tells one state of them from another: observed while they are written."""
        seen = Observation()
        state = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        return cut_lineage(e.observe(seen, *state), "links"), seen.get

    current, before = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def larger(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def smaller(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v")))

    while True:
        step = larger(current).filter("u <> v").distinct()
        current, after = written(smaller(step).filter("u <> v").distinct())
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.join(current.select(F.col("u").alias("node")), "node", "left_anti")
        .select("node", F.col("node").alias("component"))
    )


def two_way(edges: DataFrame) -> DataFrame:
    """Edges seen from both ends: (node, other, link_id, predicate, source, target, outgoing)."""
    source, target = F.col("subject").alias("source"), F.col("object").alias("target")
    ends = F.array(  # both ends of a row at once, so that the edges are computed once
        F.struct(F.col("subject").alias("node"), F.col("object").alias("other"), F.lit(True).alias("outgoing")),
        F.struct(F.col("object").alias("node"), F.col("subject").alias("other"), F.lit(False).alias("outgoing")),
    )
    rows = edges.select(F.col("id").alias("link_id"), "predicate", source, target, F.inline(ends))
    return rows.filter("outgoing OR source <> target").select("node", "other", "link_id", "predicate", "source", "target", "outgoing")


def unified_edges(assertions: DataFrame, scopes: DataFrame, similar: DataFrame) -> DataFrame:
    """One edge view over claims, context membership and computed similarity, each with its provenance.

    ``assertions``: (id, subject, predicate, object); ``scopes``: (context, target); ``similar``: (id, a, b, basis).
    """
    cols = ["link_id", "source", "target", "relation", "provenance", "computed"]
    claimed = assertions.select(
        F.concat(F.lit("assertion:"), "id").alias("link_id"), F.col("subject").alias("source"),
        F.col("object").alias("target"), F.col("predicate").alias("relation"), F.col("id").alias("provenance"),
        F.lit(False).alias("computed"),
    )
    scoped = scopes.select(
        F.concat(F.lit("scope:"), "context", F.lit(":"), "target").alias("link_id"), F.col("context").alias("source"),
        "target", F.lit("context_scope").alias("relation"), F.lit(None).cast("string").alias("provenance"),
        F.lit(False).alias("computed"),
    )
    computed = similar.select(
        F.concat(F.lit("computed:"), "id").alias("link_id"), F.col("a").alias("source"), F.col("b").alias("target"),
        F.concat(F.lit("similarity:"), "basis").alias("relation"), F.col("id").alias("provenance"),
        F.lit(True).alias("computed"),
    )
    return claimed.select(cols).unionByName(scoped.select(cols)).unionByName(computed.select(cols))


def bounded_neighborhood(
    edges: DataFrame, focus: str, depth: int = 2, max_nodes: int = GRAPH_NODES, max_links: int = GRAPH_LINKS
) -> tuple[DataFrame, DataFrame]:
    """Nodes and links within one or two steps of ``focus`` in discovery order, capped, with a truncation flag.

    ``edges`` comes from ``two_way``. Discovery order is breadth first; a node's links are read by (predicate, id). Caps
    are ordered limits, so each task passes on at most that many rows. Both results are bounded by the caps.
    """
    first = cut_lineage(edges.filter(F.col("node") == focus), "first-links")
    found = (
        first.filter(F.col("other") != focus).groupBy("other")
        .agg(F.min(F.struct("predicate", "link_id")).alias("via"))
    )
    spark = edges.sparkSession
    order1 = Window.orderBy("via.predicate", "via.link_id", "other")
    near = found.orderBy("via.predicate", "via.link_id", "other").limit(max_nodes - 1)
    near = cut_lineage(near.withColumn("ord", F.row_number().over(order1)), "near")  # at most max_nodes rows
    missed = found.count() > near.count()
    start = spark.createDataFrame([(focus, 0, 0)], "node string, ord int, depth int")
    nodes = start.unionByName(near.select(F.col("other").alias("node"), "ord", F.lit(1).alias("depth")))
    seen_links = first.withColumn("parent_ord", F.lit(0))
    if depth >= 2:
        second = edges.join(near.select(F.col("other").alias("node"), F.col("ord").alias("parent_ord")), "node")
        second = cut_lineage(second, "second-links")  # read three times below
        fresh = (
            second.join(nodes.select(F.col("node").alias("other")), "other", "left_anti").groupBy("other")
            .agg(F.min(F.struct("parent_ord", "predicate", "link_id")).alias("via"))
        )
        room = max_nodes - nodes.count()
        order2 = ["via.parent_ord", "via.predicate", "via.link_id", "other"]
        far = fresh.orderBy(*order2).limit(max(room, 0))
        far = far.withColumn("ord", F.row_number().over(Window.orderBy(*order2)) + F.lit(max_nodes))
        far = cut_lineage(far, "far")
        missed = missed or fresh.count() > far.count()
        nodes = nodes.unionByName(far.select(F.col("other").alias("node"), "ord", F.lit(2).alias("depth")))
        seen_links = seen_links.unionByName(second.select(*seen_links.columns))
    links = (
        seen_links.join(nodes.select(F.col("node").alias("other")), "other", "left_semi")
        .groupBy("link_id", "predicate", "source", "target")
        .agg(F.min("parent_ord").alias("parent_ord"))
    )
    kept = links.orderBy("parent_ord", "predicate", "link_id").limit(max_links)
    missed = missed or links.count() > max_links
    flag = F.lit(bool(missed)).alias("truncated")
    return nodes.select("node", "depth", flag), kept.select("link_id", "predicate", "source", "target", flag)


def _level_links(edges: DataFrame, start: str, goal: str, max_length: int) -> list[DataFrame] | None:
    """(node, other, predicate, link_id) between the levels of the shortest ways from ``start`` to ``goal``, in order; none if there are none.

    Both ends go out in turn, the side with the smaller frontier first, and each step keeps the links to what is new, so
    ``edges`` is read once a step and no link is kept twice. The first time a frontier meets the other one, the number of
    steps is the distance, and links that do not lie between the ends are pruned away from the middle to both sides.
    """
    spark = edges.sparkSession
    fronts = [spark.createDataFrame([(n,)], "node string") for n in (start, goal)]
    seen, sizes = list(fronts), [1, 1]
    links: list[list[DataFrame]] = [[], []]
    while True:
        if len(links[0]) + len(links[1]) >= max_length:
            return None
        k = 0 if sizes[0] <= sizes[1] else 1
        step = edges.join(fronts[k], "node", "left_semi").join(seen[k].select(F.col("node").alias("other")), "other", "left_anti")
        step = cut_lineage(step.select("node", "other", "predicate", "link_id"), "level-links")
        links[k].append(step)
        fronts[k] = cut_lineage(step.select(F.col("other").alias("node")).distinct(), "frontier")
        sizes[k] = fronts[k].count()
        if not sizes[k]:
            return None
        seen[k] = cut_lineage(seen[k].unionByName(fronts[k]), "seen")
        middle = fronts[k].join(fronts[1 - k], "node", "left_semi")
        if not middle.isEmpty():
            break
    middle = cut_lineage(middle, "middle")
    halves: list[list[DataFrame]] = [[], []]
    for half, steps in zip(halves, links):
        kept = middle
        for step in reversed(steps):
            half.append(cut_lineage(step.join(kept.select(F.col("node").alias("other")), "other", "left_semi").select(*step.columns), "between"))
            kept = half[-1].select("node").distinct()
    turned = [step.select(F.col("other").alias("node"), F.col("node").alias("other"), "predicate", "link_id") for step in halves[1]]
    return [*reversed(halves[0]), *turned]


def shortest_paths(
    edges: DataFrame, start: str, goal: str, max_length: int = 5, max_paths: int = PATHS,
    excluded: tuple[str, ...] = ("mentions",),
) -> DataFrame:
    """Up to ``max_paths`` shortest paths: (path_no, step, from_node, to_node, link_id).

    ``edges`` comes from ``two_way``; stored bucketed by node (``session.bucketed``) no step of the search moves it. The
    links between both ends are found from both of them; on these alone, which hold every predecessor on a shortest way,
    each node keeps its first ``max_paths`` distinct parents in discovery order (the order of the first way that reaches
    the parent, then predicate and link), and the paths are read back from the goal by the ranks of the parents.
    """
    spark = edges.sparkSession
    usable = edges.filter(~F.col("predicate").isin(*excluded))
    empty = "path_no int, step int, from_node string, to_node string, link_id string"
    steps = _level_links(usable, start, goal, max_length) if start != goal else None
    if steps is None:
        return spark.createDataFrame([], empty)
    frontier = spark.createDataFrame([(start, [])], "node string, ord array<string>")
    parents: list[DataFrame] = []
    for links in steps:
        step = links.join(frontier, "node").groupBy("other", "node", "ord").agg(F.min(F.struct("predicate", "link_id")).alias("via"))
        by_order = Window.partitionBy("other").orderBy("ord", "via.predicate", "via.link_id")
        kept = step.withColumn("rank", F.row_number().over(by_order)).filter(F.col("rank") <= max_paths)
        kept = cut_lineage(
            kept.select("other", "node", "rank", F.col("via.link_id").alias("link_id"),
                        F.concat("ord", F.array("via.predicate", "via.link_id")).alias("path_ord")),
            "parents",
        )
        parents.append(kept)
        frontier = kept.filter("rank = 1").select(F.col("other").alias("node"), F.col("path_ord").alias("ord"))
    walk = spark.createDataFrame([(goal,)], "at string").select(
        "at", F.array().cast("array<int>").alias("key"),
        F.array().cast("array<struct<from_node:string,to_node:string,link_id:string>>").alias("steps"),
    )
    for level in reversed(parents):
        walk = (
            walk.join(level, walk["at"] == level["other"])
            .select(
                F.col("node").alias("at"), F.concat("key", F.array("rank")).alias("key"),
                F.concat(F.array(F.struct(F.col("node").alias("from_node"), F.col("at").alias("to_node"), "link_id")),
                         "steps").alias("steps"),
            )
            .orderBy("key").limit(max_paths)
        )
    numbered = walk.withColumn("path_no", F.row_number().over(Window.orderBy("key")))  # at most max_paths rows
    return numbered.select("path_no", F.posexplode("steps").alias("step", "s")).select(
        "path_no", (F.col("step") + 1).alias("step"), "s.from_node", "s.to_node", "s.link_id"
    )


def whole_map(
    contexts: DataFrame, branches: list[DataFrame], records: tuple[int, DataFrame] | None, max_nodes: int, max_links: int
) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of an ordered list of edge branches under a node and a link budget.

    ``contexts``: (node), on the map before any link, first by name. A branch has (key, link_id, source, target, relation)
    and is read in the order of (key, link_id). A link brings the ends that are new while there is room for nodes, and
    counts only when both its ends are on the map; links stop at ``max_links`` and bring no nodes from there on.
    ``records`` is (place among the branches, branch): its links never bring nodes, only the first of a pair of ends
    counts, and both ends must be on the map already when its turn comes.

    Nothing is collected: the room for nodes goes to the first nodes by first appearance, an aggregate and an ordered
    limit, and the links between at most ``max_nodes`` nodes are cut by another ordered limit.
    """
    known = cut_lineage(contexts.select("node").distinct().orderBy("node").limit(max_nodes), "map-contexts")
    all_links = branches[0].withColumn("branch", F.lit(0))
    for i, part in enumerate(branches[1:], 1):
        all_links = all_links.unionByName(part.withColumn("branch", F.lit(i)))
    place = F.struct("branch", "key", "link_id")
    all_links = cut_lineage(all_links.groupBy("link_id").agg(F.min(F.struct("branch", "key", "source", "target", "relation")).alias("l")).select("link_id", "l.*"), "map-links")
    ends = all_links.select(place.alias("at"), F.posexplode(F.array("source", "target")).alias("end", "node"))
    firsts = ends.join(known, "node", "left_anti").groupBy("node").agg(F.min(F.struct("at", "end")).alias("first"))
    room = max_nodes - known.count()
    new = cut_lineage(firsts.orderBy("first").limit(room), "map-nodes")
    nodes = known.select("node", F.lit(-1).alias("since")).unionByName(new.select("node", F.col("first.at.branch").alias("since")))
    among = (
        all_links.join(nodes.select(F.col("node").alias("source")), "source", "left_semi")
        .join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    )
    if records is not None:
        turn, rows = records
        present = nodes.filter(F.col("since") < turn)
        own = (
            rows.join(present.select(F.col("node").alias("source")), "source", "left_semi")
            .join(present.select(F.col("node").alias("target")), "target", "left_semi")
            .groupBy("source", "target").agg(F.min(F.struct("key", "link_id", "relation")).alias("l"))
            .select(F.col("l.link_id").alias("link_id"), F.lit(turn - 0.5).alias("branch"), F.col("l.key").alias("key"), "source", "target", F.col("l.relation").alias("relation"))
        )
        among = among.withColumn("branch", F.col("branch").cast("double")).unionByName(own)
    kept = cut_lineage(among.orderBy("branch", "key", "link_id").limit(max_links), "map-kept")
    if kept.count() == max_links:  # what first appears behind the last link never came
        bound = kept.agg(F.max(F.struct(F.col("branch").cast("double").alias("branch"), "key", "link_id"))).scalar()
        new = new.filter(F.struct(F.col("first.at.branch").cast("double").alias("branch"), F.col("first.at.key").alias("key"), F.col("first.at.link_id").alias("link_id")) <= bound)
    return known.unionByName(new.select("node")), kept.select("link_id", "source", "target", "relation")


def entity_page(edges: DataFrame, labels: DataFrame, cap: int, crowd: int = CROWD) -> DataFrame:
    """Each node's links with direction and the other end's label, first ``cap`` by (predicate, id), total kept.

    ``edges`` comes from ``two_way``, stored, as it is read more than once; ``labels``: (id, label). Nodes are counted in
    ``BUCKETS`` by hash. Those of buckets with up to ``crowd`` links are sorted once, behind one shuffle; for the others the
    count is aggregated before the cut, and the cut runs per task before the shuffle, so no node is sorted whole. Names share
    their first letters, so rows are sorted and joined by a hash of the name before the name itself.
    """
    edges = edges.select(F.hash("node").alias("h"), "node", "other", "link_id", "predicate", "outgoing")
    bucket = F.pmod("h", F.lit(BUCKETS)).alias("bucket")
    crowded = cut_lineage(edges.groupBy(bucket).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("bucket"), "crowded")
    node = Window.partitionBy("h", "node")

    def cut(rows: DataFrame) -> DataFrame:
        order = node.orderBy("predicate", "link_id", F.desc("outgoing"))
        return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= cap)

    if crowded.isEmpty():
        listed = cut(edges.withColumn("assertion_count", F.count("*").over(node)))
    else:
        edges = edges.select("*", bucket)
        few, many = (edges.join(crowded, "bucket", how).drop("bucket") for how in ("left_anti", "left_semi"))
        totals = many.groupBy("h", "node").agg(F.count("*").alias("assertion_count"))
        listed = cut(few.withColumn("assertion_count", F.count("*").over(node))).unionByName(cut(many).join(totals, ["h", "node"]))
    named = labels.select(F.hash("id").alias("other_h"), F.col("id").alias("other"), F.col("label").alias("other_label"))
    return (
        listed.withColumn("other_h", F.hash("other")).join(named, ["other_h", "other"], "left")
        .select(
            "node", "pos", "predicate", F.when(F.col("outgoing"), "outgoing").otherwise("incoming").alias("direction"),
            "other", F.coalesce("other_label", "other").alias("other_label"), "link_id", "assertion_count",
            (F.col("assertion_count") > cap).alias("truncated"),
        )
    )


def link_key(*cols: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in cols])
