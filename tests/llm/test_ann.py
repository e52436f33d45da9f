import re

import numpy as np

from claimweave.llm import ann


def brute(ids, vectors, queries, k):
    wide = vectors.astype(np.float64)
    norm = np.linalg.norm(wide, axis=1)
    out = {}
    for q in queries:
        score = wide @ wide[q] / (norm * norm[q])
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))
        out[ids[q]] = [(ids[i], score[i]) for i in order[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<float>, n int")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), shard_size=800).collect()
    want = brute(ids, vectors, range(0, 3000, 50), 5)
    rows = {}
    for r in got:
        rows.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in rows[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, found in rows.items():
        assert [n for n, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        for _, v, s in found:
            a, b = vectors[q].astype(np.float64), vectors[v].astype(np.float64)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(0, [1.0, 0.0]), (150, [2.0, 0.0]), (200, [1.0, 2.0, 3.0]), (250, [2.0, 4.0, 6.5]), (300, [])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    found = {q: [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert found[0] == [(k, k) for k in range(1, 6)]  # equal vectors: the smallest other ids
    assert found[150] == [(k + 1, k) for k in range(5)]
    assert found[200] == [(1, 250)] and found[250] == [(1, 200)]
    assert found[100] == [(k + 1, k) for k in range(5)] and set(found) == {0, 100, 150, 200, 250}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_pruning_keeps_diverse_edges():
    points = ann.unit(np.array([[1, 0], [1, 0.1], [1, 0.11], [1, -0.3]], np.float32))
    kept = ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, -1, 0]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]  # 2 is nearer to 1 than to 0


def test_graphs_meet_blocks_without_a_copy_each(spark):
    """Batches that a task reads stay small: a graph travels once, whatever the number of query blocks, and groups change nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index, shards = ann.build_index(df, "vec_id", "embedding", 5, 100)
    asked = df.filter("vec_id % 3 = 0").selectExpr("vec_id AS id", "embedding AS v")

    def answers(**how):
        found = {}
        for r in ann.search(index, shards, asked, 5, ann.BEAM, block=40, **how).collect():
            found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        return {q: sorted(f)[:5] for q, f in found.items()}

    plan = ann.search(index, shards, asked, 5, ann.BEAM, block=40)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"shard#\d+ = shard#\d+", plan)
    assert answers() == answers(most_groups=2) == answers(most_groups=1, held=5)
