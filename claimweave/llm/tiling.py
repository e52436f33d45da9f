"""Benchmark decontamination by greedy string tiling.

Seeds of five words that a document shares with a test item propose pairs; greedy string tiling then covers the item with
the longest non-overlapping matches of the document, found by a running Karp-Rabin hash, in whatever order they stand. An
item covered for the most part marks the document, so passages whose sentences were moved around are caught too.

The documents are read once and never shuffled: a bitmap of fixed size, broadcast, says which of a document's seeds may
belong to an item, and only the words around those travel. False hits of the bitmap cost a join row and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

WORD = re.compile(r"\w+")
SEED_WORDS = 5
BITMAP_BITS = 1 << 24  # 2 MB, whatever the number of items


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def seed_hashes(words: list[str], size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, by start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(crc32, "\n".join(words).encode().split(b"\n")), np.uint64, len(words))
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def item_seeds(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, n_words, size, seed, places): the distinct seeds of every item and how often it has each; an item of fewer
    than five words is one seed of its size."""
    kept = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("_text"))
    schema = f"item {kept.schema['item'].dataType.simpleString()}, n_words int, size int, seed bigint, places bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_py())
                size = min(SEED_WORDS, len(words))
                if size:
                    seeds, places = np.unique(seed_hashes(words, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(seeds), batch.column(0).type), *(pa.array(np.full(len(seeds), x, np.int32)) for x in (len(words), size)), pa.array(seeds), pa.array(places.astype(np.int64))],
                        names=["item", "n_words", "size", "seed", "places"],
                    )

    return kept.mapInArrow(run, schema)


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit per seed hash modulo the bitmap's size: at most 2**18 words of 64 bits reach the driver."""
    place = F.pmod("seed", F.lit(BITMAP_BITS))
    words = seeds.groupBy((place / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {BITMAP_BITS}) % 64 as int))")).alias("bits"))
    table = words.toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool)


def shared_regions(docs: DataFrame, keys: list[str], text: str, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """(keys, doc, seeds, regions) of every row with a seed in the bitmap: distinct seeds, the words they cover, a row name."""
    kept = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys] + ["doc binary", "seeds array<bigint>", "regions string"])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            rows, seeds, regions = [], [], []
            for i, value in enumerate(batch.column(len(keys))):
                words = words_of(value.as_py())
                covered, found = np.zeros(len(words) + 1, np.int32), []
                for size in sizes:
                    hashes = seed_hashes(words, size)
                    at = np.flatnonzero(known[hashes & (BITMAP_BITS - 1)])
                    if at.size:
                        found.append(hashes[at])
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + size, -1)
                if not found:
                    continue
                inside = np.concatenate(([False], np.cumsum(covered[:-1]) > 0, [False]))
                edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
                rows.append(i)
                seeds.append(np.unique(np.concatenate(found)))
                regions.append("\n".join(" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)))
            if rows:
                part = batch.take(pa.array(rows))
                names = [hashlib.md5(repr([*(part.column(c)[r].as_py() for c in range(len(keys))), regions[r]]).encode()).digest() for r in range(len(rows))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(regions)], names=[*keys, "doc", "seeds", "regions"])

    return kept.mapInArrow(run, schema)


def candidates(regions: DataFrame, seeds: DataFrame, coverage: float) -> DataFrame:
    """Distinct (doc, item) that share a seed among the item's rarer ones.

    Tiles that cover ``coverage`` of an item of n words hold at least r = ceil(coverage * n / 5) of the places where its
    seeds start. Seeds of fewer than r places in all cannot be everything that a qualifying pair shares, so the most
    frequent ones, such as a phrase that all items and many documents hold, join nothing while their places stay below r.
    """
    hits = regions.select("doc", F.explode("seeds").alias("seed")).distinct()
    often = hits.groupBy("seed").agg(F.count("*").alias("df"))
    most_first = Window.partitionBy("item").orderBy(F.desc("df"), F.desc("seed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = (
        seeds.join(often, "seed")
        .withColumn("removed", F.sum("places").over(most_first))
        .withColumn("needed", F.ceil(F.lit(coverage) * F.col("n_words") / F.lit(SEED_WORDS)))
        .filter((F.col("n_words") < SEED_WORDS) | (F.col("removed") >= F.col("needed")))
    )
    return hits.join(rare.select("seed", "item"), "seed").select("doc", "item").distinct()


def tiles(pattern: Sequence[int], text: Sequence[int], least: int, start: int = 32) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of greedy tiles of at least ``least`` words, longest first.

    Running Karp-Rabin: the unmarked windows of a length are hashed in rolling fashion, equal hashes are compared word by
    word and extended. Matches much longer than the window restart the search at their length; marked words take no
    further part. Lengths fall from ``start`` to ``least``.
    """
    modulus, base = (1 << 61) - 1, 1_000_003
    used_p, used_t = [False] * len(pattern), [False] * len(text)

    def windows(words: Sequence[int], used: list[bool], size: int) -> Iterator[tuple[int, int]]:
        top, h, run = pow(base, size - 1, modulus), 0, 0
        for i, w in enumerate(words):
            if used[i]:
                h = run = 0
                continue
            if run == size:
                h = (h - words[i - size] * top) % modulus
                run -= 1
            h = (h * base + w) % modulus
            run += 1
            if run == size:
                yield i - size + 1, h

    def matches(size: int) -> list[tuple[int, int, int]]:
        table: dict[int, list[int]] = {}
        for j, h in windows(text, used_t, size):
            table.setdefault(h, []).append(j)
        best: list[tuple[int, int, int]] = []
        for i, h in windows(pattern, used_p, size):
            longest = (0, 0, 0)
            for j in table.get(h, ()):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and not used_p[i + k] and not used_t[j + k]:
                    k += 1
                if k >= size and k > longest[0]:
                    longest = (k, i, j)
            if longest[0]:
                best.append(longest)
        return best

    out: list[tuple[int, int, int]] = []
    size = max(start, least)
    while True:
        found = matches(size)
        if found and (longest := max(found)[0]) > 2 * size:
            size = longest
            continue
        marked = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(used_p[i : i + k]) and not any(used_t[j : j + k]):
                used_p[i : i + k] = used_t[j : j + k] = [True] * k
                out.append((i, j, k))
                marked = True
        if marked:
            continue  # matches that overlapped a marked one may have unmarked parts left
        if size == least:
            return out
        size = max(least, size // 2)


def covered_words(item: list[str], regions: list[list[str]]) -> tuple[int, int]:
    """(words of the item inside tiles, number of tiles)."""
    ids: dict[str, int] = {}
    pattern = [ids.setdefault(w, len(ids) + 1) for w in item]
    text: list[int] = []
    for region in regions:  # a fresh word between regions, so that no tile crosses them
        text += [ids.get(w, 0) or len(ids) + 1 for w in region] + [len(ids) + 2]
    found = tiles(pattern, text, min(SEED_WORDS, len(pattern)))
    return sum(k for _, _, k in found), len(found)


def contaminated(
    docs: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = 0.5
) -> DataFrame:
    """One row per document and test item whose tiles cover at least ``coverage`` of the item's words.

    Columns: ``keys``, ``item`` under its own name, ``n_words`` of the item, ``covered`` words, ``n_tiles``, ``coverage``.
    Words are runs of word characters, compared without case. Tiles have five words or more; an item of fewer words must
    occur whole. Null or empty texts and items match nothing, repeated rows give one row, null keys stay null, other
    columns are not kept, and empty tables give no rows.
    """
    names = list(keys)
    # names of its own for every column in use: keys may be called like anything
    renamed = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.col(text).alias("_t"))
    own = [f"_k{i}" for i in range(len(names))]
    seeds = cut_lineage(item_seeds(items, item, item_text), "item-seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most five
    regions = cut_lineage(shared_regions(renamed, own, "_t", sizes, seed_bitmap(seeds)), "regions").dropDuplicates(["doc"])
    pairs = candidates(regions, seeds, coverage)
    texts = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("item_text")).distinct()
    joined = pairs.join(regions.drop("seeds"), "doc").join(texts, "item").select(*own, "item", "item_text", "regions")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*own, "item"]] + ["n_words int, covered int, n_tiles int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, found in zip(batch.column(len(own) + 1).to_pylist(), batch.column(len(own) + 2).to_pylist(), strict=True):
                words = words_of(value)
                rows.append((len(words), *covered_words(words, [r.split(" ") for r in found.split("\n")])))
            columns = [pa.array(c, pa.int32()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own) + 1], *columns], names=[*own, "item", "n_words", "covered", "n_tiles"])

    scored = joined.mapInArrow(run, schema).withColumn("coverage", F.col("covered") / F.col("n_words"))
    found = scored.filter(F.col("coverage") >= coverage).dropDuplicates([*own, "item"])
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, names, strict=True)], F.col("item").alias(item), "n_words", "covered", "n_tiles", "coverage")
