import math
import random

import pytest

from claimweave.operators import similarity as s
from claimweave.operators.graph import transitive_closure
from claimweave.session import cut_lineage
from tests.conftest import rows


def brute_top(profiles, k):
    total = {e: sum(t.values()) for e, (_, t) in profiles.items()}
    out = []
    for a, (la, ta) in profiles.items():
        scored = []
        for b, (lb, tb) in profiles.items():
            if a != b and la == lb:
                shared = sum(w for t, w in ta.items() if t in tb)
                if shared > 0:
                    scored.append((-round(shared / (total[a] + total[b] - shared), 12), b))
        out += [(a, b, round(-x, 9)) for x, b in sorted(scored)[:k]]
    return sorted(out)


@pytest.mark.parametrize("heavy,seed", [(2000, 1), (3, 2), (1, 3), (6, 4)])
def test_top_partners_match_brute_force(spark, heavy, seed):
    """Low limits push most terms through the groups of entities with equal heavy terms."""
    rng = random.Random(seed)
    weight = {f"t{i}": round(rng.uniform(0.1, 3.0), 3) for i in range(14)}
    weight |= {f"rare{i}": round(rng.uniform(2.0, 5.0), 3) for i in range(20)}
    profiles = {}
    for e in range(60):
        terms = rng.sample([f"t{i}" for i in range(14)], rng.randint(1, 5)) + rng.sample([f"rare{i}" for i in range(20)], rng.randint(0, 2))
        profiles[e] = (e % 2, {t: weight[t] for t in terms})
    data = [(e, lv, t, w) for e, (lv, ts) in profiles.items() for t, w in ts.items()]
    df = spark.createDataFrame(data, "entity bigint, level int, term string, weight double")
    got = [(r.a, r.b, round(r.score, 9)) for r in s.top_partners(df, df, 3, heavy=heavy).collect()]
    assert sorted(got) == brute_top(profiles, 3)


def test_a_term_held_by_everybody_does_not_list_all_pairs(spark):
    """All entities share one heavy term; answers come from the lightest partners."""
    data = [(e, 0, "all", 1.0) for e in range(300)] + [(e, 0, f"own{e}", 1.0 + e / 100) for e in range(300)]
    df = spark.createDataFrame(data, "entity bigint, level int, term string, weight double")
    got = s.top_partners(df, df, 3, heavy=50).collect()
    assert len(got) == 900
    assert sorted(r.b for r in got if r.a == 299) == [0, 1, 2]
    assert sorted(r.b for r in got if r.a == 1) == [0, 2, 3]


def test_distinct_sets_of_heavy_terms_are_not_compared_in_pairs(spark, monkeypatch):
    """Nearly every entity has a set of heavy terms of its own: what the search visits grows like the table, not its square."""
    rng = random.Random(6)
    terms = {f"t{i:02d}": round(0.5 + i / 8, 3) for i in range(24)}

    def visited(n):
        profiles = {e: (0, {t: terms[t] for t in rng.sample(sorted(terms), 8)}) for e in range(n)}
        df = spark.createDataFrame([(e, 0, t, w) for e, (_, ts) in profiles.items() for t, w in ts.items()], "entity bigint, level int, term string, weight double")
        seen = []
        monkeypatch.setattr(s, "cut_lineage", lambda d, name="cut": cut_lineage(d, name) if name != "search" else seen.append(cut_lineage(d, name)) or seen[-1])
        got = sorted((r.a, r.b, round(r.score, 9)) for r in s.top_partners(df, df, 3, heavy=10).collect())
        if n <= 400:
            assert got == brute_top(profiles, 3)
        return sum(d.count() for d in seen)

    few, many = visited(400), visited(1600)
    assert many < 10 * few  # 16 times as many pairs


@pytest.fixture(scope="module")
def world(spark):
    """Eleven reference diseases; the root has two children that share a leaf."""
    edges = spark.createDataFrame([("left", "root"), ("right", "root"), ("leaf", "left"), ("leaf", "right"), ("lone", "left"), ("unused", "right")],
                                  "child string, parent string")
    positive = spark.createDataFrame([(f"d{i}", "leaf" if i < 3 else "left") for i in range(10)] + [("d10", "lone"), ("d0", "left"), ("d0", "leaf")],
                                     "entity string, term string")
    closure = transitive_closure(edges)
    return closure, s.information_content(positive, closure)


def test_information_content_counts_each_disease_once(world):
    closure, ic = world
    got = {r.term: (r.n, r.total, r.ic) for r in ic.collect()}
    assert got["leaf"][:2] == (3, 11) and got["lone"][:2] == (1, 11)
    assert got["left"][0] == 11 and got["root"] == (11, 11, 0.0)
    assert math.isclose(got["leaf"][2], -math.log(3 / 11))
    assert "unused" not in got  # null after a left join, never infinite


def test_unassessed_term_withholds(spark, world):
    _, ic = world
    direct = spark.createDataFrame([("x", "leaf"), ("x", "unused"), ("y", "leaf"), ("z", "lone")], "entity string, term string")
    cover = s.reference_coverage(direct, ic)
    assert rows(cover, "entity", "direct_terms", "assessed_terms", "fraction") == [("x", 2, 1, 0.5), ("y", 1, 1, 1.0), ("z", 1, 1, 1.0)]
    open_ = spark.createDataFrame([("z", "lone")], "entity string, term string")
    assert rows(s.usable_entities(cover, open_)) == [("y",)]


def test_contributions_and_identity(spark, world):
    closure, ic = world
    direct = spark.createDataFrame([(1, 0, "leaf"), (2, 0, "leaf"), (3, 0, "lone")], "entity int, level int, term string")
    expanded = s.expanded_profile(direct, closure, ("root",))
    weighted = expanded.join(ic.filter("ic > 0").selectExpr("term", "ic as weight"), "term").select("entity", "level", "term", "weight")
    top = s.top_partners(weighted, weighted, 3)
    # Twins score 1; the third shares only a term everybody has, which weighs nothing.
    assert [(r.a, r.b, r.score) for r in top.orderBy("a").collect()] == [(1, 2, 1.0), (2, 1, 1.0)]
    cards = top.withColumn("union_weight", top.shared / top.score)
    parts = s.shared_terms(cards, expanded, direct, ic).groupBy("a", "b").sum("contribution").collect()
    assert all(math.isclose(r[2], 1.0) for r in parts)


@pytest.mark.parametrize("heavy", [1, 2, 3, 5, 2000])
def test_the_limit_never_changes_ties(spark, heavy):
    """Equal weights make exact ties; the smaller id must win whatever counts as a heavy term."""
    profiles = {1: {"H": 2.0}, 2: {"H": 2.0, "r": 1.0}, 3: {"H": 2.0, "x": 1.5}, 4: {"H": 2.0, "r": 1.0}, 5: {"g": 1 / 3, "H": 2.0}, 6: {"g": 1 / 3, "r": 1.0}}
    data = [(e, 0, t, w) for e, ts in profiles.items() for t, w in ts.items()]
    df = spark.createDataFrame(data, "entity bigint, level int, term string, weight double")
    for k in (1, 2):
        got = sorted((r.a, r.b, round(r.score, 9)) for r in s.top_partners(df, df, k, heavy=heavy).collect())
        assert got == brute_top({e: (0, t) for e, t in profiles.items()}, k)


def test_finished_entities_search_no_heavy_terms(spark, monkeypatch):
    """With enough partners through rare terms, a weak term of everybody's cannot give a better one: lists are not searched."""
    rng = random.Random(8)
    weight = {"all": 0.01} | {f"rare{i}": round(rng.uniform(2.0, 5.0), 3) for i in range(30)}
    profiles = {e: (0, {t: weight[t] for t in ["all", *rng.sample(sorted(weight)[1:], 6)]}) for e in range(60)}
    df = spark.createDataFrame([(e, 0, t, w) for e, (_, ts) in profiles.items() for t, w in ts.items()], "entity bigint, level int, term string, weight double")
    written = []
    monkeypatch.setattr(s, "cut_lineage", lambda d, name="cut": written.append(name) or cut_lineage(d, name))
    got = [(r.a, r.b, round(r.score, 9)) for r in s.top_partners(df, df, 3, heavy=30).collect()]
    assert sorted(got) == brute_top(profiles, 3)
    assert "hot-lists" in written and "hot-prefixes" not in written


def test_shared_weights_do_not_ask_for_direct_terms(spark):
    """Warnings and sums need no flags: the same rows as ``shared_terms`` without its two joins with the direct terms."""
    cards = spark.createDataFrame([(1, 2, 0.5, 4.0), (1, 3, None, None)], "a bigint, b bigint, score double, union_weight double")
    held = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "y")], "entity bigint, term string")
    ic = spark.createDataFrame([("x", 2.0)], "term string, ic double")
    plain = s.shared_weights(cards, held, ic)
    assert rows(plain) == [(1, 2, "x", 2.0, 0.5), (1, 2, "y", None, 0.0), (1, 3, "y", None, None)]
    flagged = s.shared_terms(cards, held, held.filter("entity = 1"), ic)
    assert rows(flagged.select(plain.columns)) == rows(plain)
    assert {(r.direct_a, r.direct_b) for r in flagged.collect()} == {(True, False)}
