"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such points
never exceeds the Hamming distance of the fingerprints. The segments form three panels; points within distance 4 are
within distance 1 in at least one panel, so they share a grid cell of that panel or lie in cells one step apart. Every
distinct fingerprint is at home in three cells and is sent to the cells one step up; inside a cell the homes meet each
other and the visitors, and the Hamming distance decides. A batch of cells answers with a spanning forest of its links,
so a group of n near copies yields about n rows, not n squared. A cell with very many homes is cut into blocks of pairs
of chunks that many tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.graph import connected_components
from claimweave.session import cut_lineage

SEED = 42
SEGMENTS = 32
PANELS = (range(0, 11), range(11, 22), range(22, 32))
DISTANCE = 4


def fingerprint(text: str, words: int = 4) -> int:
    """The fingerprint of a text: A-Z lowered, words between ASCII white space, shingles of ``words`` words."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [line[a:b] for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and the fingerprint of every row as a signed 64-bit number."""
    kept = df.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys] + ["fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column(len(keys))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keys, "fp"])

    return kept.mapInArrow(run, schema)


def grid(fps: DataFrame) -> DataFrame:
    """(cell, fp, home): three home cells of every fingerprint and the cells one step up from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            counts = np.stack([np.bitwise_count((fp.view(np.uint64) >> np.uint64(2 * s)) & np.uint64(3)) for s in range(SEGMENTS)], 1).astype(np.int64)
            for panel, segments in enumerate(PANELS):
                weights = 3 ** np.arange(len(segments), dtype=np.int64)
                own = counts[:, segments] @ weights + (panel << 20)
                yield _rows(own, fp, True)
                for s, weight in zip(segments, weights.tolist(), strict=True):
                    up = counts[:, s] < 2
                    if up.any():
                        yield _rows(own[up] + weight, fp[up], False)

    def _rows(cell: np.ndarray, fp: np.ndarray, home: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp), pa.array(np.full(len(cell), home))], names=["cell", "fp", "home"])

    return fps.mapInArrow(run, "cell bigint, fp bigint, home boolean")


def in_blocks(rows: DataFrame, heavy: int) -> DataFrame:
    """``rows`` with a block: one per cell, or for a cell with over ``heavy`` homes one per pair of chunks."""
    crowded = rows.filter("home").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > heavy)
    crowded = crowded.select("cell", F.ceil(2 * F.col("n") / heavy).cast("int").alias("k"))
    chunk = "cast(pmod(xxhash64(fp), k) as int)"
    blocks = f"""explode(CASE
        WHEN k IS NULL THEN array(0)
        WHEN home THEN transform(sequence(0, 2 * k - 1), j -> least({chunk}, j) * 2 * k + greatest({chunk}, j))
        ELSE transform(sequence(0, k - 1), i -> i * 2 * k + k + {chunk}) END)"""
    return rows.join(crowded, "cell", "left").select("cell", F.expr(blocks).alias("block"), "home", "fp")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected to by the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        if (label[a] == label[b]).all():
            return label


def _linked(key: np.ndarray, home: np.ndarray, fp: np.ndarray, distance: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within equal keys, as two arrays of fingerprints. Rows come ordered by key, homes first."""
    names, node = np.unique(fp, return_inverse=True)
    bounds = np.flatnonzero(np.diff(key)) + 1
    ends = np.repeat(np.append(bounds, len(key)), np.diff(np.concatenate(([0], bounds, [len(key)]))))
    at = np.flatnonzero(home)
    bits = fp.view(np.uint64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kept, step = 0, 1
    while True:
        at = at[at + step < ends[at]]
        if not at.size:
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= distance]
        left.append(node[near])
        right.append(node[near + step])
        kept += near.size
        step += 1
        if kept > most:  # keep a forest in place of all links so far
            label = forest(len(names), np.concatenate(left), np.concatenate(right))
            child = np.flatnonzero(label != np.arange(len(names)))
            left, right, kept = [child], [label[child]], 0
    label = forest(len(names), np.concatenate(left), np.concatenate(right))
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def links(rows: DataFrame, distance: int = DISTANCE, buffered: int = 200_000) -> DataFrame:
    """(a, b): links that connect all fingerprints of a cell which a chain of near ones connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def answer(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(key, home, fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            key = batch.column(0).to_numpy() * (1 << 32) + batch.column(1).to_numpy()
            waiting.append((key, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()))
            size += batch.num_rows
            if size < buffered:
                continue
            key, home, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
            cut = int(np.searchsorted(key == key[-1], True))  # the last group may go on
            waiting, size = [(key[cut:], home[cut:], fp[cut:])], 0
            if cut:
                yield answer(key[:cut], home[:cut], fp[:cut])
        if waiting:
            yield answer(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    placed = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("home"))
    return placed.select("cell", "block", "home", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, heavy: int = 4096) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked (at most 5, as three panels are searched one
    step far); ``component_id`` is the smallest key reachable by links. A null or empty text has the fingerprint zero and
    is linked like any other. Rows with a null key take part and lend no name to their component, which is null if it has
    no other row. Repeated rows stay, other columns are not kept, an empty table gives no rows. ``heavy`` is the number of
    homes above which a cell is shared by several tasks; it does not change the result.
    """
    if distance > 5:
        raise ValueError("three panels searched one step far prove links of at most 5 bits")
    marked = cut_lineage(fingerprints(df, text, [key]), "fingerprints")
    named = marked.groupBy("fp").agg(F.min(key).alias("least"))
    rows = cut_lineage(grid(named.select("fp")), "grid")
    found = connected_components(links(in_blocks(rows, heavy), distance))
    grouped = named.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
