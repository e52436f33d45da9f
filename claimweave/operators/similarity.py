"""Information-content-weighted similarity between term profiles.

Profiles are long tables of distinct (entity, level, term). Scores never come from comparing every pair: an inverted
index joins entities through terms that are rare enough, and terms held by very many entities are searched as a
tree of prefixes with bounds on what a branch can still give.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.identity import stable_id
from claimweave.functions.text import score_text
from claimweave.functions.vocab import SPARSE_DIRECT_TERMS, SPECIFIC_SHARE
from claimweave.operators.windows import top_cards
from claimweave.session import cut_lineage

SPECIFIC_IC = math.log(SPECIFIC_SHARE)
WEIGHT = "decimal(38,15)"
BANDS = 64  # of heavy weight, in which partners are bounded together
HEAVY_TERM = 2000  # holders of a term within one level beyond which pairs are not listed through it


def information_content(positive: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, n, total, ic): distinct reference entities per ancestor-closed term.

    ``positive``: (entity, term) rows of the reference population; ``closure``: (node, ancestor). A term nobody has is
    absent, so its information content is null after a left join, never infinite.
    """
    pairs = positive.select("entity", "term").distinct()
    held = (
        pairs.join(closure, pairs.term == closure.node)
        .select("entity", F.col("ancestor").alias("term"))
        .distinct()
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    total = pairs.select("entity").distinct().agg(F.count("*").alias("total"))
    return held.withColumn("total", total.scalar()).withColumn("ic", -F.log(F.col("n") / F.col("total")) + F.lit(0.0))


def expanded_profile(direct: DataFrame, closure: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """Direct (entity, level, term) rows to distinct ancestor-closed rows without the roots."""
    return (
        direct.select("entity", "level", "term").distinct()
        .join(closure.filter(~F.col("ancestor").isin(*roots)), F.col("term") == F.col("node"))
        .select("entity", "level", F.col("ancestor").alias("term"))
        .distinct()
    )


def profile_provenance(direct: DataFrame, closure: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """Which claims stand behind each expanded term, one row per (entity, term, assertion)."""
    return (
        direct.select("entity", "term", "assertion").distinct()
        .join(closure.filter(~F.col("ancestor").isin(*roots)), F.col("term") == F.col("node"))
        .select("entity", F.col("ancestor").alias("term"), "assertion")
        .distinct()
    )


def reference_coverage(direct: DataFrame, ic: DataFrame) -> DataFrame:
    """(entity, direct_terms, assessed_terms, fraction, unassessed_terms)."""
    rows = direct.select("entity", "term").distinct().join(ic.select("term", "ic"), "term", "left")
    return rows.groupBy("entity").agg(
        F.count("*").alias("direct_terms"),
        F.count("ic").alias("assessed_terms"),
        (F.count("ic") / F.count("*")).alias("fraction"),
        (F.count("*") - F.count("ic")).alias("unassessed_terms"),
    )


def unassessed_terms(direct: DataFrame, ic: DataFrame) -> DataFrame:
    """The (entity, term) rows behind ``reference_coverage``'s count."""
    return direct.select("entity", "term").distinct().join(ic.select("term"), "term", "left_anti").select("entity", "term")


def top_partners(
    left: DataFrame, right: DataFrame, k: int, heavy: int = HEAVY_TERM, exclude_self: bool = True
) -> DataFrame:
    """The ``k`` best partners of every left entity by weighted Jaccard, ties by partner id: (a, b, level, shared, score).

    Inputs are distinct (entity, level, term, weight) with positive weights equal for equal terms; partners overlap in
    at least one term. If ``right`` has a column ``owner``, equal for all rows of an entity, the partners are owners: each
    counts with its best entity, ties go by owner, and ``b`` in the result is the owner. The result is exact:

    1. Pairs are listed only through terms with at most ``heavy`` holders in the level. What they share in heavy terms
       lies between bounds that follow from both heavy weights; pairs that cannot be among the first ``k`` go, and only
       for the others are the two lists of heavy terms intersected.
    2. A pair that shares heavy terms only is bounded in the same way over bands of partners. An entity whose k-th score
       is above this bound is finished.
    3. The others look at the lightest entities below each prefix of their own heavy terms, which gives every one of
       them a bar, and then search the tree of prefixes of all lists of heavy terms, leaving every branch whose best
       possible score is below the bar (``_search_prefixes``).
    """
    same = left is right
    exact = F.col("weight").cast("decimal(28,15)")  # decimal sums do not depend on the order of rows
    left = cut_lineage(left.withColumn("weight", exact), "profiles")
    right = left if same else cut_lineage(right.withColumn("weight", exact), "profiles")
    holders = right.groupBy("level", "term").agg(F.count("*").alias("holders"))
    hot = holders.filter(F.col("holders") > heavy).select("level", "term")
    has_hot = not hot.isEmpty()
    hot = cut_lineage(hot, "hot-terms") if has_hot else hot

    owned = "owner" in right.columns

    def totals(p: DataFrame, *more: Column) -> DataFrame:
        return p.groupBy("level", "entity").agg(F.sum("weight").cast(WEIGHT).alias("total"), *more)

    def split(p: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not has_hot:
            return p, p.limit(0)
        return p.join(hot, ["level", "term"], "left_anti"), p.join(hot, ["level", "term"], "left_semi")

    left_rare, left_hot = split(left)
    right_rare, right_hot = (left_rare, left_hot) if same else split(right)
    a, b = left_rare.alias("a"), right_rare.alias("b")
    on = (F.col("a.level") == F.col("b.level")) & (F.col("a.term") == F.col("b.term"))
    if same:  # symmetric: list each pair once and mirror it
        on = on & (F.col("a.entity") < F.col("b.entity"))
    elif exclude_self:
        on = on & (F.col("a.entity") != F.col("b.entity"))
    pairs = (
        a.join(b, on)
        .groupBy(F.col("a.level").alias("level"), F.col("a.entity").alias("a"), F.col("b.entity").alias("b"))
        .agg(F.sum("a.weight").cast(WEIGHT).alias("shared"))
    )
    left_total = totals(left).select("level", F.col("entity").alias("a"), F.col("total").alias("total_a"))
    owner = F.first("owner") if owned else F.first("entity")
    right_total = totals(right, owner.alias("owner")).select("level", F.col("entity").alias("b"), F.col("total").alias("total_b"), "owner")

    def scored(p: DataFrame) -> DataFrame:
        union = F.col("total_a") + F.col("total_b") - F.col("shared")
        return p.withColumn("score", F.round(F.col("shared").cast("double") / union.cast("double"), 12))

    def both_ways(p: DataFrame) -> DataFrame:
        if not same:
            return p
        return p.unionByName(p.select("level", F.col("b").alias("a"), F.col("a").alias("b"), "shared",
                                      F.col("total_b").alias("total_a"), F.col("total_a").alias("total_b"),
                                      F.col("a").alias("owner"), *[c for c in p.columns if c == "score"]))

    best = Window.partitionBy("level", "a").orderBy(F.desc("score"), "owner")
    best_of_owner = Window.partitionBy("level", "a", "owner").orderBy(F.desc("score"), "b")

    def top(p: DataFrame) -> DataFrame:
        if owned:
            p = p.withColumn("rank", F.row_number().over(best_of_owner)).filter("rank = 1")
        return p.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    columns = ["a", F.col("owner").alias("b"), "level", F.col("shared").cast("double").alias("shared"), "score", "rank"]
    if not has_hot:
        full = pairs.join(left_total, ["level", "a"]).join(right_total, ["level", "b"])
        return top(both_ways(scored(full))).select(columns)

    def hot_lists(p: DataFrame, name: str) -> DataFrame:
        """Heavy terms of an entity by falling weight: the order in which a search looks at them."""
        item = F.struct((-F.col("weight")).alias("less"), "term", "weight")
        return p.groupBy("level", "entity").agg(F.array_sort(F.collect_list(item)).alias(f"hot_{name}")).withColumnRenamed("entity", name)

    def heavy_part(p: DataFrame) -> DataFrame:
        return p.groupBy("level", "entity").agg(F.sum("weight").cast(WEIGHT).alias("heavy"))

    nothing = F.lit(0).cast(WEIGHT)
    size_a = cut_lineage(left_total.join(heavy_part(left_hot).withColumnsRenamed({"entity": "a", "heavy": "heavy_a"}), ["level", "a"], "left")
                         .withColumn("heavy_a", F.coalesce("heavy_a", nothing)), "sizes")
    size_b = cut_lineage(right_total.join(heavy_part(right_hot).withColumnsRenamed({"entity": "b", "heavy": "heavy_b"}), ["level", "b"], "left")
                         .withColumn("heavy_b", F.coalesce("heavy_b", nothing)), "sizes")
    whole = cut_lineage(right_hot.select("level", "term", "weight").distinct().groupBy("level").agg(F.sum("weight").cast(WEIGHT).alias("whole")), "heavy-whole")
    lists_a = cut_lineage(hot_lists(left_hot, "a"), "hot-lists")
    lists_b = lists_a.withColumnsRenamed({"a": "b", "hot_a": "hot_b"}) if same else cut_lineage(hot_lists(right_hot, "b"), "hot-lists")
    met = pairs.join(size_a, ["level", "a"]).join(size_b, ["level", "b"]).join(whole, "level", "left")
    met = cut_lineage(met.withColumn("whole", F.coalesce("whole", nothing)), "light-pairs")
    if same:
        back = {"a": "b", "b": "a", "total_a": "total_b", "total_b": "total_a", "heavy_a": "heavy_b", "heavy_b": "heavy_a"}
        met = met.unionByName(met.select(*[F.col(back.get(c, c)).alias(c) for c in met.columns if c != "owner"], F.col("a").alias("owner")))
    floor = _kth(top(met.withColumn("score", _with_heavy(F.greatest(nothing, F.col("heavy_a") + F.col("heavy_b") - F.col("whole"))))), k)
    may = met.join(floor, ["level", "a"]).filter(_with_heavy(F.least("heavy_a", "heavy_b")) >= F.col("kth")).select("level", "a", "b", "owner", "shared", "total_a", "total_b")
    full = may.join(lists_a, ["level", "a"], "left").join(lists_b, ["level", "b"], "left")
    common = F.coalesce(_weight(F.array_intersect("hot_a", "hot_b")), nothing)
    light = cut_lineage(top(scored(full.withColumn("shared", (F.col("shared") + common).cast(WEIGHT)).drop("hot_a", "hot_b"))).drop("rank"), "light-top")
    starts = cut_lineage(_unfinished(size_a.join(_kth(light, k), ["level", "a"], "left").fillna(0.0, ["kth"]), size_b, whole), "unfinished")
    if starts.isEmpty():
        return top(light).select(columns)
    info_a = starts.drop("heavy_a", "kth").join(lists_a, ["level", "a"])
    with_hot = size_b.drop("heavy_b").join(lists_b, ["level", "b"])
    tree = cut_lineage(_prefixes(with_hot), "hot-prefixes")
    near = _first_guesses(info_a, tree, with_hot, k, owned, starts, size_b)
    if exclude_self:
        near = near.filter("a <> b")
    known = cut_lineage(_larger(light, scored(near)), "known")
    bar = _kth(top(known), k)
    probes = _search_prefixes(info_a.join(bar, ["level", "a"], "left").fillna(0.0, ["kth"]), tree, k, owned)
    if exclude_self:
        probes = probes.filter("a <> b")
    return top(_larger(known, scored(probes))).select(columns)


def _with_heavy(more: Column) -> Column:
    """The score of a pair if it shared ``more`` weight of heavy terms."""
    shared = (F.col("shared") + more).cast("double")
    union = (F.col("total_a") + F.col("total_b") - F.col("shared") - more).cast("double")
    return F.round(shared / union, 12)


def _kth(listed: DataFrame, k: int) -> DataFrame:
    """(level, a, kth): the lowest score of ``k`` listed partners, 0 with fewer."""
    found = listed.groupBy("level", "a").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    return found.select("level", "a", F.when(F.col("found") >= k, F.col("kth")).otherwise(0.0).alias("kth"))


def _unfinished(starts: DataFrame, partners: DataFrame, whole: DataFrame) -> DataFrame:
    """The starts that some partner may reach ``kth`` with through heavy terms alone.

    Partners are put in ``BANDS`` by their heavy weight; the largest heavy weight and the smallest total of a band bound
    what any of its members can give.
    """
    band = F.floor(F.col("heavy_b").cast("double") / F.col("whole").cast("double") * BANDS)
    bands = partners.filter("heavy_b > 0").join(whole, "level").groupBy("level", band.alias("band")).agg(F.max("heavy_b").alias("most"), F.min("total_b").alias("lightest"))
    gain = F.least("heavy_a", "most").cast("double")
    union = F.greatest(F.col("total_a").cast("double"), (F.col("total_a") + F.col("lightest") - F.least("heavy_a", "most")).cast("double"))
    met = starts.filter("heavy_a > 0").join(bands, "level").filter(F.round(gain / union, 12) >= F.col("kth"))
    return starts.join(met.select("level", "a").distinct(), ["level", "a"], "left_semi")


def _weight(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast(WEIGHT), lambda acc, x: (acc + x["weight"]).cast(WEIGHT))


def _larger(*parts: DataFrame) -> DataFrame:
    """Pairs once each. One that also shares rare terms is underestimated by the search over heavy ones: the larger counts."""
    both = reduce(DataFrame.unionByName, [p.select("level", "a", "b", "owner", "shared", "score") for p in parts])
    return both.groupBy("level", "a", "b", "owner").agg(F.max_by("shared", "score").alias("shared"), F.max("score").alias("score"))


def _lightest(rows: DataFrame, k: int, owned: bool) -> DataFrame:
    """Of each (level, node) the lightest ``k`` + 1 entities, of different owners if they have any."""
    if owned:
        one = Window.partitionBy("level", "node", "owner").orderBy("total_b", "b")
        rows = rows.withColumn("place", F.row_number().over(one)).filter("place = 1")
    order = Window.partitionBy("level", "node").orderBy("total_b", "owner")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")


def _node(items: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", F.transform(items, lambda x: x["term"])))


#: Lengths at which heavy-term lists are cut: single terms where weights are large, longer stretches behind them.
CUTS = (1, 2, 3, 4, 6, 9, 13, 19, 28, 42, 63, 94, 141, 211, 316, 474, 711, 1066)


def _prefixes(entities: DataFrame) -> DataFrame:
    """(level, node, depth, parent, stretch, whole, b, total_b, owner): every entity below each prefix of its heavy terms.

    ``stretch`` are the terms that the node adds to its parent; ``whole`` marks the full list of the entity.
    """
    n = F.size("hot_b")
    cuts = F.array(*[F.lit(c) for c in CUTS])
    ends = F.array_distinct(F.concat(F.filter(cuts, lambda c: c < n), F.array(n)))
    rows = entities.select("level", "b", "total_b", "owner", "hot_b", F.posexplode(F.concat(F.array(F.lit(0)), ends)).alias("depth", "start"), ends.alias("ends"))
    rows = rows.withColumn("end", F.get("ends", F.col("depth"))).filter("end IS NOT NULL")
    return rows.select(
        "level", _node(F.slice("hot_b", F.lit(1), F.col("end"))).alias("node"), F.col("depth"),
        _node(F.slice("hot_b", F.lit(1), F.col("start"))).alias("parent"), F.slice("hot_b", F.col("start") + 1, F.col("end") - F.col("start")).alias("stretch"),
        (F.col("end") == n).alias("whole"), "b", "total_b", "owner")


def _first_guesses(info_a: DataFrame, tree: DataFrame, info_b: DataFrame, k: int, owned: bool, starts: DataFrame, size_b: DataFrame) -> DataFrame:
    """Pairs of an entity with the lightest ones below each prefix of its own heavy terms: they set the bar for the search.

    Only pairs whose heavy weights allow the score that the entity has already are compared term by term.
    """
    below = _lightest(tree.select("level", "node", "b", "total_b", "owner"), k, owned)
    own = info_a.filter(F.size("hot_a") > 0).select("level", F.col("a").alias("b"), F.col("total_a").alias("total_b"), F.col("hot_a").alias("hot_b"), F.col("a").alias("owner"))
    own = _prefixes(own)
    met = own.select("level", "node", F.col("b").alias("a")).join(below.select("level", "node", "b"), ["level", "node"]).select("level", "a", "b").distinct()
    sized = met.join(starts, ["level", "a"]).join(size_b.select("level", "b", "total_b", "heavy_b"), ["level", "b"]).withColumn("shared", F.lit(0).cast(WEIGHT))
    met = sized.filter(_with_heavy(F.least("heavy_a", "heavy_b")) >= F.col("kth")).select("level", "a", "b")
    pairs = met.join(info_a, ["level", "a"]).join(info_b, ["level", "b"])
    return pairs.withColumn("shared", _weight(F.array_intersect("hot_a", "hot_b"))).filter("shared > 0").drop("hot_a", "hot_b")


def _search_prefixes(starts: DataFrame, tree: DataFrame, k: int, owned: bool) -> DataFrame:
    """(level, a, b, total_a, total_b, owner, shared) of partners through heavy terms alone that may reach the bar ``kth`` of an entity.

    The prefixes form a tree. An entity goes down a branch while the best that can still come there reaches its bar: what
    the prefix shares plus the rest of its own list, over a union of at least its own weight and what the prefix has
    besides, and of what the lightest entity below the branch needs. At a whole list the lightest ``k`` entities (plus one
    for itself) are enough, as the score falls with the partner's weight. No two entities meet but at such a list.
    """
    branches = tree.groupBy("level", "parent", "node").agg(F.first("stretch").alias("stretch"), F.min("total_b").alias("lightest"), F.bool_or("whole").alias("whole"))
    branches = cut_lineage(branches, "branches")
    members = _lightest(tree.filter("whole").select("level", "node", "b", "total_b", "owner"), k, owned)
    members = cut_lineage(members.groupBy("level", "node").agg(F.collect_list(F.struct("b", "total_b", "owner")).alias("members")), "members")  # at most k + 1
    none = F.lit(0).cast(WEIGHT)
    reach = F.round(_weight(F.col("hot_a")).cast("double") / F.col("total_a").cast("double"), 12)  # as the scores are rounded
    frontier = starts.filter((F.size("hot_a") > 0) & (reach >= F.col("kth"))).select(
        "level", "a", "total_a", "kth", "hot_a", F.md5(F.lit("")).alias("node"), none.alias("gained"), none.alias("missed"))
    frontier, found = cut_lineage(frontier, "search"), []
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "parent").join(branches, ["level", "parent"])
        common = _weight(F.array_intersect("stretch", "hot_a"))
        rest = _weight(F.filter("hot_a", lambda x: x > F.element_at("stretch", -1)))
        step = step.withColumn("common", common).withColumn("most", (F.col("gained") + F.col("common") + rest).cast(WEIGHT)).withColumn(
            "missed", (F.col("missed") + _weight(F.col("stretch")) - F.col("common")).cast(WEIGHT)).withColumn("gained", (F.col("gained") + F.col("common")).cast(WEIGHT))
        union = F.greatest(F.col("total_a") + F.col("missed"), F.col("total_a") + F.col("lightest") - F.col("most"))
        may = F.round(F.col("most").cast("double") / union.cast("double"), 12) >= F.col("kth")
        kept = step.filter((F.col("most") > 0) & may)
        frontier = cut_lineage(kept.select("level", "a", "total_a", "kth", "hot_a", "node", "gained", "missed", "whole"), "search")
        found.append(frontier.filter("whole AND gained > 0").select("level", "a", "total_a", "node", F.col("gained").alias("shared")))
        frontier = frontier.drop("whole")
    if not found:
        return members.join(starts.limit(0), "level").select("level", "a", "total_a", F.col("total_a").alias("shared"), F.inline("members"))
    return reduce(DataFrame.unionByName, found).join(members, ["level", "node"]).select("level", "a", "total_a", "shared", F.inline("members"))


def usable_entities(coverage: DataFrame, disagreements: DataFrame | None = None) -> DataFrame:
    """Entities whose score is not withheld: no unassessed direct term and no open disagreement."""
    ok = coverage.filter("direct_terms > 0 and unassessed_terms = 0").select("entity")
    return ok if disagreements is None else ok.join(disagreements.select("entity").distinct(), "entity", "left_anti")


def withheld_reasons(coverage: DataFrame, disagreements: DataFrame) -> DataFrame:
    """(entity, reason) rows: why an entity takes part in no score."""
    unassessed = coverage.filter("unassessed_terms > 0").select(
        "entity", F.format_string("%d direct term(s) lack support in the IC reference", "unassessed_terms").alias("reason")
    )
    open_ones = disagreements.groupBy("entity").agg(F.countDistinct("term").alias("terms")).select(
        "entity", F.format_string("unresolved positive/NOT disagreement for %d term(s)", "terms").alias("reason")
    )
    return unassessed.unionByName(open_ones)


def shared_weights(cards: DataFrame, expanded: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, term, ic, contribution): terms both sides of each card hold, without asking where they come from."""
    pa = expanded.select(F.col("entity").alias("a"), "term")
    pb = expanded.select(F.col("entity").alias("b"), "term")
    rows = cards.join(pa, "a").join(pb, ["b", "term"]).join(ic.select("term", "ic"), "term", "left")
    contribution = F.when(F.col("score").isNotNull(), F.coalesce("ic", F.lit(0.0)) / F.col("union_weight"))
    return rows.select("a", "b", "term", "ic", contribution.alias("contribution"))


def shared_terms(cards: DataFrame, expanded: DataFrame, direct: DataFrame, ic: DataFrame) -> DataFrame:
    """Terms both sides of each card hold, with weight, contribution, direct flags and position (IC desc, term).

    ``cards``: (a, b, score, union_weight). Cards are few per start, so both joins fan out by profile size only.
    """
    da = direct.select(F.col("entity").alias("a"), "term", F.lit(True).alias("da")).distinct()
    db = direct.select(F.col("entity").alias("b"), "term", F.lit(True).alias("db")).distinct()
    rows = shared_weights(cards, expanded, ic).join(da, ["a", "term"], "left").join(db, ["b", "term"], "left")
    return rows.select(
        "a", "b", "term", "ic", "contribution",
        F.coalesce("da", F.lit(False)).alias("direct_a"), F.coalesce("db", F.lit(False)).alias("direct_b"),
    )


def ordered_shared_terms(rows: DataFrame) -> DataFrame:
    """Position of each shared term within its card: IC descending, unknown last, then term."""
    order = Window.partitionBy("a", "b").orderBy(F.desc_nulls_last("ic"), "term")
    return rows.withColumn("pos", F.row_number().over(order))


def overlap_warnings(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per card: specific term count and the three warnings."""
    per = rows.groupBy("a", "b").agg(
        F.count("*").alias("shared_terms"), F.count_if(F.col("ic") >= SPECIFIC_IC).alias("specific_terms")
    )
    ca = coverage.select(F.col("entity").alias("a"), F.col("direct_terms").alias("direct_a"),
                         F.col("unassessed_terms").alias("un_a"))
    cb = coverage.select(F.col("entity").alias("b"), F.col("direct_terms").alias("direct_b"),
                         F.col("unassessed_terms").alias("un_b"))
    codes = F.array_compact(F.array(
        F.when(F.col("un_a") + F.col("un_b") > 0, F.lit("REFERENCE_INCOMPLETE")),
        F.when((F.col("shared_terms") > 0) & (F.col("specific_terms") == 0), F.lit("BROAD_OVERLAP_ONLY")),
        F.when(F.least("direct_a", "direct_b") < SPARSE_DIRECT_TERMS, F.lit("SPARSE_PROFILE")),
    ))
    return per.join(ca, "a").join(cb, "b").select(
        "a", "b", "shared_terms", "specific_terms", F.array_join(codes, ",").alias("warnings")
    )


def top_cards_reasons(merged: DataFrame, k: int) -> DataFrame:
    """First ``k`` cards per start with why each is listed. ``merged``: (a, b, score, feature)."""
    reasons = F.concat_ws(" and ", F.when(F.col("score").isNotNull(), "shared terms"),
                          F.when(F.col("feature"), "mechanism features"))
    return top_cards(merged, k).withColumn("reasons", reasons)


def comparison_cards(cards: DataFrame, coverage: DataFrame, facts: DataFrame) -> DataFrame:
    """Cards with a summary sentence and the counterexample that keeps them from being over-read.

    ``facts``: (entity, parent, effect). A shared parent is named before a difference in effect.
    """
    def side(s: str) -> DataFrame:
        f = facts.join(coverage.select("entity", "direct_terms"), "entity")
        return f.select(F.col("entity").alias(s), F.col("parent").alias(f"parent_{s}"), F.col("effect").alias(f"effect_{s}"),
                        F.col("direct_terms").alias(f"direct_{s}"))

    j = cards.join(side("a"), "a").join(side("b"), "b")
    same_parent = F.col("parent_a") == F.col("parent_b")
    differs = (F.col("effect_a") != F.col("effect_b")) & (F.col("score") >= 0.5)
    summary = F.concat(F.lit("Disease-baseline weighted overlap: "), score_text(F.col("score")), F.lit(" ("), "direct_a",
                       F.lit(" and "), "direct_b", F.lit(" direct terms)"))
    return j.select(
        "a", "b", summary.alias("summary"),
        F.when(F.col("score").isNotNull(), "disease_baseline").otherwise("unranked").alias("ranking_basis"), "score",
        same_parent.alias("same_parent"),
        F.when(same_parent & F.col("score").isNotNull(), "shared parent does not establish subgroup similarity")
        .when(differs, "overlap coexists with different effects").alias("counterexample"))


def pair_scores(pairs: DataFrame, weighted: DataFrame, out: str) -> DataFrame:
    """(a, b, ``out``): the weighted overlap of given pairs, null where a side has no profile of positive weight.

    ``weighted``: (entity, term, weight) of the entities whose score is not withheld. Pairs are few per start.
    """
    exact = weighted.select("entity", "term", F.col("weight").cast("decimal(28,15)").alias("weight"))
    totals = exact.groupBy("entity").agg(F.sum("weight").cast(WEIGHT).alias("total"))
    left = pairs.select("a", "b").join(exact.withColumnRenamed("entity", "a"), "a")
    shared = left.join(exact.select(F.col("entity").alias("b"), "term"), ["b", "term"]).groupBy("a", "b").agg(F.sum("weight").cast(WEIGHT).alias("shared"))
    j = pairs.select("a", "b").join(shared, ["a", "b"], "left")
    for side in "ab":
        j = j.join(totals.select(F.col("entity").alias(side), F.col("total").alias(f"total_{side}")), side, "left")
    common = F.coalesce("shared", F.lit(0).cast(WEIGHT))
    union = F.col("total_a") + F.col("total_b") - common
    return j.select("a", "b", F.round(common.cast("double") / union.cast("double"), 12).alias(out))


def unranked_candidates(profiles: DataFrame, features: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(a, b, shares, feature): pairs that may be listed without a score, for starts with fewer than ``k`` ranked partners.

    ``profiles``: (entity, level, term) with every expanded term, scored or not; ``features``: (entity, level, feature);
    ``ranked``: (a, b). Unranked partners are listed by id, and fewer than ``k`` ranked ones and the start itself can stand
    before them, so the first ``2k`` holders of each term or feature are enough for everybody.
    """
    def met(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("level", name).orderBy("entity")
        first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * k).select("level", name, F.col("entity").alias("b"))
        return rows.withColumnRenamed("entity", "a").join(full, "a", "left_anti").join(first, ["level", name]).filter("a <> b").select("a", "b").distinct()

    full = ranked.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("a")
    both = met(profiles, "term").withColumn("shares", F.lit(True)).join(met(features, "feature").withColumn("feature", F.lit(True)), ["a", "b"], "full")
    return both.join(ranked.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.coalesce("shares", F.lit(False)).alias("shares"), F.coalesce("feature", F.lit(False)).alias("feature"))


def two_level_cards(ranked: DataFrame, unranked: DataFrame, base: DataFrame, subgroup: DataFrame, contexts: DataFrame, effects: DataFrame, k: int) -> DataFrame:
    """The first ``k`` cards of each start with the scores of both levels, differences, unknowns and counterexamples.

    ``ranked``: (a, b, score) at the start's own level; ``unranked``: as from ``unranked_candidates``; ``base`` and
    ``subgroup``: weighted profiles of entities whose score is not withheld; ``contexts``: (entity, profile_level, parent);
    ``effects``: (entity, effect, evidence). Ranked cards come first, by score and partner, then the others by partner.
    """
    own = F.when(F.col("profile_level") == "subgroup", "subgroup").otherwise("disease_baseline")
    levels = contexts.select(F.col("entity").alias("a"), own.alias("basis"))
    listed = ranked.select("a", "b", "score", F.lit(None).cast("boolean").alias("shares"), F.lit(None).cast("boolean").alias("feature")).unionByName(
        unranked.select("a", "b", F.lit(None).cast("double").alias("score"), "shares", "feature"))
    order = Window.partitionBy("a").orderBy(F.col("score").isNull(), F.desc("score"), "b")
    cards = cut_lineage(listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "two-level-cards")
    j = cards.join(pair_scores(cards, base, "base_score"), ["a", "b"]).join(pair_scores(cards, subgroup, "subgroup_score"), ["a", "b"]).join(levels, "a")
    for side in "ab":
        j = j.join(contexts.select(F.col("entity").alias(side), F.col("parent").alias(f"parent_{side}")), side)
        j = j.join(effects.select(F.col("entity").alias(side), F.col("effect").alias(f"effect_{side}"), F.col("evidence").alias(f"evidence_{side}")), side, "left")
    is_ranked = F.col("score").isNotNull()
    effect = F.when(F.col("effect_a").isNull() | F.col("effect_b").isNull(), "unknown").when(F.col("effect_a") == F.col("effect_b"), "same").otherwise("different")
    why = F.when(F.when(F.col("basis") == "subgroup", F.col("subgroup_score")).otherwise(F.col("base_score")).isNull(), "a profile is missing or its score withheld").otherwise("no shared term of weight")
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("shares"), "shared disease-baseline terms"), F.when(F.col("feature"), "sourced mechanism features"))), " and ")
    unknowns = F.array_compact(F.array(
        F.when(effect == "unknown", "functional effect not recorded on both sides"),
        F.when(~is_ranked, F.concat(F.lit("not ranked at the "), F.regexp_replace("basis", "_", " "), F.lit(" level ("), why, F.lit("); listed because of "), reasons))))
    counter = F.array_compact(F.array(
        F.when((F.col("parent_a") == F.col("parent_b")) & F.col("base_score").isNotNull() & F.col("subgroup_score").isNull(),
               F.concat(F.lit("one shared parent baseline (overlap "), score_text(F.col("base_score")), F.lit(") does not establish subgroup similarity"))),
        F.when((effect == "different") & (F.col("base_score") >= 0.5), "overlap coexists with different functional effects")))
    return j.select(
        "a", "b", "rank", F.when(is_ranked, F.col("basis")).otherwise("unranked").alias("ranking_basis"), "base_score", "subgroup_score", effect.alias("effect_comparison"),
        F.array_sort(F.array_distinct(F.array_compact(F.array("evidence_a", "evidence_b")))).alias("feature_evidence"),
        F.array_compact(F.array(F.when(effect == "different", "functional effects differ"))).alias("differences"), unknowns.alias("unknowns"), counter.alias("counterexamples"),
        F.array(F.concat(F.lit("Disease-baseline weighted overlap: "), score_text(F.col("base_score"))), F.concat(F.lit("Subgroup weighted overlap: "), score_text(F.col("subgroup_score")))).alias("summary"))


def calculation_rows(cards: DataFrame, ic: DataFrame) -> DataFrame:
    """Provenance of each card with an id derived from its content."""
    size = ic.agg(F.max("total")).scalar()
    fixed = F.round("score", 6).cast("decimal(20,6)").cast("string")
    return cards.withColumn("reference_size", size).withColumn("id", stable_id(
        "calc", a=F.col("a"), b=F.col("b"), level=F.col("level"), score=fixed,
        reference_size=F.col("reference_size"), algorithm=F.lit("weighted-jaccard-1")))


def calculation_parameters(calculations: DataFrame) -> DataFrame:
    """(a, b, name, value) rows, parameters by name and a sentence about the outcome."""
    outcome = F.concat(F.lit("Weighted Jaccard overlap; result "), F.round("score", 4).cast("decimal(20,4)").cast("string"), F.lit("."))
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in (
        ("context_a", F.col("a")), ("context_b", F.col("b")),
        ("ic_reference_disease_count", F.col("reference_size")), ("outcome", outcome))])
    return calculations.select("a", "b", F.inline(entries))
