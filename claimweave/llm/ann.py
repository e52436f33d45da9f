"""Approximate nearest neighbours on a robust-pruned directed graph, one graph per shard.

Equal vectors become one node that keeps the smallest ids it stands for. Nodes are dealt to shards of a fixed size by a
hash of the vector. In a shard points are inserted in batches: a greedy search over the graph so far proposes neighbours,
relaxed distance pruning keeps the diverse ones, and reverse edges are added and pruned the same way. Graphs are written
as one row per shard. Shards lie in groups: a task reads the graphs of a group once and answers one block of queries after
the other from all of them, so no graph is copied for a block. Every query visits every shard by a beam search, and the best
of all shards remain. Scores are cosines in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import batches_of
from claimweave.session import cut_lineage

DEGREE = 32
BEAM = 96
ALPHA = 1.2
EXPANDED = 4  # nodes of a beam that are expanded at a time
BATCH = 256
GROUPS = 64  # groups of shards, each searched by one task, as long as none has more than
HELD = 16  # shards: about 3 MB each for the search
AT_ONCE = 8  # graphs or blocks of queries in an Arrow batch: a few MB


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distances, expanded) of the ``beam`` nearest found for each query, nearest first; -1 where fewer were found.

    Distances are squared between unit vectors. All queries of a block take their steps together.
    """
    count, nodes = len(queries), len(points)
    ids = np.full((count, beam), -1, np.int64)
    distance = np.full((count, beam), np.inf, np.float32)
    expanded = np.zeros((count, beam), bool)
    ids[:, 0], distance[:, 0] = start, 2 - 2 * (queries @ points[start])
    seen = np.zeros((count, nodes), bool)
    seen[:, start] = True
    active = np.arange(count)
    while active.size:
        open_ = np.where(expanded[active] | (ids[active] < 0), np.inf, distance[active])
        chosen = np.argsort(open_, axis=1, kind="stable")[:, :EXPANDED]
        found = np.isfinite(np.take_along_axis(open_, chosen, 1))
        keep = found[:, 0]
        active, chosen, found = active[keep], chosen[keep], found[keep]
        if not active.size:
            break
        marks = expanded[active]
        np.put_along_axis(marks, chosen, np.take_along_axis(marks, chosen, 1) | found, 1)
        expanded[active] = marks
        parents = np.where(found, np.take_along_axis(ids[active], chosen, 1), 0)
        near = np.where(found[:, :, None], edges[parents], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[np.repeat(active, fresh.sum(1)), near[fresh]] = True
        gap = np.where(fresh, 2 - 2 * np.einsum("bkd,bd->bk", points[np.maximum(near, 0)], queries[active]), np.inf)
        every = np.concatenate([distance[active], gap.astype(np.float32)], 1)
        order = np.argsort(every, axis=1, kind="stable")[:, :beam]
        distance[active] = np.take_along_axis(every, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], 1), order, 1)
        expanded[active] = np.take_along_axis(np.concatenate([expanded[active], np.zeros(fresh.shape, bool)], 1), order, 1)
    return ids, distance, expanded


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the nearest candidates such that none is ``alpha`` times nearer to one already kept; -1 fills up."""
    gap = 2 - 2 * np.einsum("bkd,bd->bk", points[np.maximum(candidates, 0)], points[own])
    gap[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1)
    vectors = points[np.maximum(candidates, 0)]
    kept = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    alive = np.isfinite(gap)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, k] = candidates[some, first[some]]
        between = 2 - 2 * np.einsum("bkd,bd->bk", vectors, vectors[rows, first])
        alive &= ~(some[:, None] & (alpha * alpha * between <= gap))
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(out-edges, start node) of the graph over unit vectors."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    centre = points.mean(0)
    start = int(np.argmax(points @ centre))
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at = 0
    while at < len(order):
        batch = order[at : at + min(BATCH, max(1, at))]
        at += len(batch)
        ids, _, _ = beam_search(points, edges, start, points[batch], beam)
        edges[batch] = robust_prune(points, batch, ids, degree, alpha)
        source, target = np.repeat(batch, degree), edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.lexsort((2 - 2 * np.einsum("bd,bd->b", points[source], points[target]), target))  # nearest first
        source, target = source[by_target], target[by_target]
        nodes, first, sizes = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, sizes)
        row = np.repeat(np.arange(len(nodes)), sizes)
        new = np.full((len(nodes), min(int(sizes.max(initial=0)), 2 * degree)), -1, np.int64)
        fits = place < new.shape[1]
        new[row[fits], place[fits]] = source[fits]
        merged = np.concatenate([edges[nodes], new], 1)
        full = (merged >= 0).sum(1) > degree
        if full.any():
            edges[nodes[full]] = robust_prune(points, nodes[full], merged[full], degree, alpha)
        packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)[:, :degree]
        edges[nodes[~full]] = packed[~full]
    return edges, start


INDEX = "dim int, shard int, n int, start int, points binary, edges binary, members binary, sizes binary"


def _tasks(table: DataFrame, column: str) -> int:
    """Partitions for so many keys in all that few of them fall together."""
    keys = table.agg(F.sum(column)).first()[0] or 1
    return max(keys, min(4 * keys, 1000))


def build_index(vectors: DataFrame, vec: str, vector: str, k: int, shard_size: int) -> tuple[DataFrame, DataFrame]:
    """(index, shards): one row per shard with its graph, and (dim, shards) with the number of shards."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec).isNotNull()).select(F.col(vec).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    nodes = cut_lineage(nodes.withColumn("dim", F.size("v")), "nodes")
    shards = cut_lineage(nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_size)).cast("int").alias("shards")), "shards")
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        points = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        edges, start = build(unit(points))
        members = table.column("members").combine_chunks()
        row = [dim, shard, len(points), start, points.tobytes(), edges.astype(np.int32).tobytes(), members.flatten().to_numpy().tobytes(), members.value_lengths().to_numpy().astype(np.int32).tobytes()]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["dim", "shard", "n", "start", "points", "edges", "members", "sizes"])

    index = placed.select("dim", "shard", "v", "members").repartition(_tasks(shards, "shards"), "dim", "shard").groupBy("dim", "shard").applyInArrow(graph, INDEX)
    return cut_lineage(index, "graphs"), shards


def search(index: DataFrame, shards: DataFrame, queries: DataFrame, k: int, beam: int, block: int = 512, most_groups: int = GROUPS, held: int = HELD) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of every group of shards for every query (id, v)."""
    groups = shards.select("dim", F.greatest(F.least("shards", F.lit(most_groups)), F.ceil(F.col("shards") / held)).cast("int").alias("groups"))
    asked = queries.withColumn("dim", F.size("v")).join(groups, "dim")
    blocks = max(1, -(-queries.count() // block))
    packed = asked.groupBy("dim", "groups", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    spread = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    graphs = index.join(groups, "dim").withColumn("grp", F.col("shard") % F.col("groups")).drop("groups", "shard").withColumn("block", F.lit(-1))
    order = ["dim", "grp", "block"]  # the graphs of a group first
    work = graphs.unionByName(spread, allowMissingColumns=True).repartition(_tasks(groups, "groups"), "dim", "grp").sortWithinPartitions(*order)
    work = work.select(*order, "n", "start", "points", "edges", "members", "sizes", "asked")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                dim, grp, place, n, start = (batch.column(c)[i].as_py() for c in range(5))
                if (dim, grp) != group:
                    group, known = (dim, grp), []
                if place < 0:
                    points, edges, members, sizes = (np.frombuffer(batch.column(5 + c)[i].as_py(), t) for c, t in enumerate((np.float32, np.int32, np.int64, np.int32)))
                    known.append((points.reshape(n, dim), edges.reshape(n, -1).astype(np.int64), start, members, np.cumsum(sizes), sizes))
                    continue
                own = batch.column(9)[i].values
                names = own.field("id").to_numpy().tolist()
                asked_for = own.field("v").flatten().to_numpy().reshape(-1, dim)
                best: list[list[tuple[float, int]]] = [[] for _ in names]
                for points, edges, start, members, ends, sizes in known:
                    ids, _, _ = beam_search(unit(points), edges, start, unit(asked_for), beam)
                    for q, (name, vector, found) in enumerate(zip(names, asked_for.astype(np.float64), ids[:, : 2 * k + 2], strict=True)):
                        found = found[found >= 0]
                        near = points[found].astype(np.float64)
                        scores = near @ vector / (np.linalg.norm(near, axis=1) * np.linalg.norm(vector))
                        pairs = [(-s, m) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for m in members[ends[f] - sizes[f] : ends[f]].tolist() if m != name]
                        best[q] = sorted(best[q] + pairs)[:k]
                out = [(name, m, -s) for name, pairs in zip(names, best, strict=True) for s, m in pairs]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return work.mapInArrow(answer, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, vec: str = "vec_id", vector: str = "embedding", k: int = 5, shard_size: int = 4096, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest other rows of ``vectors`` found.

    Nearness is the cosine, ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows without an id; vectors of different lengths are not compared. Rows that repeat an id with an
    equal vector count once. Fewer than ``k`` rows come back where there are fewer candidates; empty tables give none.
    Other columns are not kept.
    """
    index, shards = build_index(vectors, vec, vector, k, shard_size)
    asked = queries.filter(usable(F.col(vector)) & F.col(vec).isNotNull()).select(F.col(vec).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    with batches_of(vectors.sparkSession, AT_ONCE):
        found = search(index, shards, asked, k, beam)
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return cut_lineage(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
