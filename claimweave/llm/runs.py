"""Periodic runs of words, found with a run-length grammar built by recompression.

The words of some documents form one sequence of numbers with a different end mark behind each document. Its grammar is
built level by level: block compression names every maximal row of equal symbols, pair compression splits the symbols in
two classes and names every pair of a left and a right one. Equal stretches are cut alike but for the symbols at their
ends, so two positions are extended by climbing while both stand at the start of a block and descending where the symbols
first differ: a constant number of comparisons a level. All queries of a batch climb together in numpy, and levels are
built only as far as a query still climbs.

A run of period q and at least 4q words holds two equal words x and x + q for a multiple x of 3q: such grid pairs, about
n ln(n) / 3 for n words, are all candidates, and one extension to each side gives the exact run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
AT_ONCE = 300_000  # words of a batch in one grammar; a longer document has one of its own
CANDIDATES = 1_000_000  # grid pairs that are looked at together
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """A sequence of symbols and how its blocks make the next one: ``first`` child of each block and the block of each symbol."""

    def __init__(self, symbols: np.ndarray, blocks: bool) -> None:
        self.symbols, self.blocks = symbols, blocks  # what makes the next level: rows of equal symbols, or pairs
        self.first = self.up = None

    def compress(self) -> Level:
        s, n = self.symbols, len(self.symbols)
        start = np.ones(n, bool)
        if self.blocks:
            start[1:] = s[1:] != s[:-1]
        else:
            left = self._classes()
            start[1:] = ~(left[:-1] & ~left[1:])  # the second of a pair starts nothing
        self.first = np.flatnonzero(start)
        self.up = np.cumsum(start) - 1
        size = np.diff(np.append(self.first, n))
        head, width = s[self.first], int(s.max()) + 2
        key = head * np.int64(int(size.max()) + 1) + size if self.blocks else head * np.int64(width) + np.where(size == 2, s[np.minimum(self.first + 1, n - 1)] + 1, 0)
        return Level(pd.factorize(key)[0].astype(np.int64), not self.blocks)

    def _classes(self) -> np.ndarray:
        """Symbols of the left class: of four splits by bits of a hash the one with the most pairs."""
        h = (self.symbols.astype(np.uint64) + np.uint64(1)) * _ODD
        best, most = None, -1
        for bit in (63, 61, 58, 55):
            left = (h >> np.uint64(bit) & np.uint64(1)).astype(bool)
            pairs = int((left[:-1] & ~left[1:]).sum())
            if pairs > most:
                best, most = left, pairs
        return best


class Grammar:
    """Levels over a sequence in which some symbol is unique between any two positions that are compared."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = [Level(symbols, True)]

    def level(self, k: int) -> Level:
        while len(self.levels) <= k:
            self.levels.append(self.levels[-1].compress())
        return self.levels[k]

    def _ends(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last symbol of the block that each symbol of level ``k`` lies in."""
        at = self.level(k)
        if at.first is None:
            self.level(k + 1)
        last = np.append(at.first[1:], len(at.symbols)) - 1
        return at.first[at.up], last[at.up]

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from i and from j on (to the left, if ``back``) are equal; i != j, and a difference must come."""
        p, q = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        sign = -1 if back else 1
        stopped = np.zeros(len(p), np.int64)  # the level on which symbols differ
        alive, k = np.arange(len(p)), 0
        while len(alive):
            level = self.level(k)
            s = level.symbols
            first, last = self._ends(k)
            near, far = (last, first) if back else (first, last)  # the end of a block that is met first, and the other
            a, b = p[alive], q[alive]
            inside = (near[a] != a) | (near[b] != b)
            differ = s[a] != s[b]
            move = inside & ~differ
            if level.blocks:
                length = np.minimum(np.abs(far[a] - a), np.abs(far[b] - b)) + 1
            else:
                length = np.ones(len(a), np.int64)
            a, b = np.where(move, a + sign * length, a), np.where(move, b + sign * length, b)
            # after the step both stand at the start of a block, or their symbols differ
            ready = (near[a] == a) & (near[b] == b) & (s[a] == s[b])
            p[alive], q[alive] = a, b
            stopped[alive[~ready]] = k
            up = alive[ready]
            p[up], q[up] = level.up[a[ready]], level.up[b[ready]]
            alive, k = up, k + 1
        for k in range(int(stopped.max(initial=0)), 0, -1):
            below = self.levels[k - 1]
            mine = np.flatnonzero(stopped >= k)
            s = below.symbols
            first, last = below.first, np.append(below.first[1:], len(s)) - 1
            near, far = (last, first) if back else (first, last)
            a, b = near[p[mine]], near[q[mine]]
            length = np.minimum(np.abs(far[p[mine]] - a), np.abs(far[q[mine]] - b)) + 1 if below.blocks else np.ones(len(a), np.int64)
            move = s[a] == s[b]
            p[mine], q[mine] = np.where(move, a + sign * length, a), np.where(move, b + sign * length, b)
        return np.abs(p - i)


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, position, period) of the grid pairs of all documents, about ``CANDIDATES`` at a time."""
    docs = np.flatnonzero(sizes >= LEAST_LENGTH)
    most = np.maximum(sizes[docs] // LEAST_EXPONENT, 1)  # the largest period of each
    doc = np.repeat(docs, most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    n = (sizes[doc] - 1 - period) // (3 * period) + 1  # multiples x of 3q with x + q inside
    before = np.cumsum(n) - n
    cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, int(n.sum()), CANDIDATES)), len(doc)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        times, q = n[a:b], np.repeat(period[a:b], n[a:b])
        step = np.arange(len(q)) - np.repeat(before[a:b] - before[a], times)
        yield np.repeat(doc[a:b], times), np.repeat(starts[doc[a:b]], times) + 3 * q * step, q


def find_runs(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each sequence of word numbers, by start, then period."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    if not sizes.sum():
        return [np.zeros((0, 3), np.int64) for _ in docs]
    # an end mark before the first and behind every document, all different
    words = max(int(d.max()) for d in docs if len(d)) + 1
    text = np.empty(int(sizes.sum()) + len(docs) + 1, np.int64)
    text[0] = words
    starts = np.cumsum(sizes + 1) - sizes
    for n, (d, start) in enumerate(zip(docs, starts.tolist(), strict=True)):
        text[start : start + len(d)] = d
        text[start + len(d)] = words + 1 + n
    grammar, rows = Grammar(text), []
    for doc, x, q in grid(starts, sizes):
        same = text[x] == text[x + q]
        doc, x, q = doc[same], x[same], q[same]
        ahead, behind = grammar.extend(x, x + q), grammar.extend(x, x + q, back=True)
        start, length = x - behind + 1, ahead + behind - 1 + q
        keep = (length >= LEAST_LENGTH) & (length >= LEAST_EXPONENT * q)
        rows.append(np.column_stack([doc, start - starts[doc], length, q])[keep])
    found = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # of one stretch the smallest period counts
        found = found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(1))]
        found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], np.arange(len(docs) + 1))
    return [found[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def folded(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of a document; of one in ten documents, chosen by id, the rest repeats a stretch of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _answer(words: list[bytes], runs: np.ndarray) -> tuple:
    keep = np.ones(len(words) + 1, np.int64)
    if len(runs):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(cover) == 0
    collapsed = b" ".join(w for w, k in zip(words, keep.tolist(), strict=False) if k) if len(runs) else b" ".join(words)
    best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist() if len(runs) else [None, None, None]
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist())
    exponent = 1000 * best[1] // best[2] if len(runs) else None
    return len(runs), *best, exponent, runs, listed, collapsed


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", fold: bool = False) -> DataFrame:
    """The runs of every document and its text without their repeats.

    ``key``, ``n_runs``, ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest start,
    then period; nulls without a run), ``runs`` (list of start, length, period), ``runs_sha256`` (of the lines
    ``start,length,period``) and ``collapsed``, the kept words with single spaces. A run is a maximal stretch with smallest
    period q and at least max(6, 4q) words; a word goes if a run holds it behind the run's first q words. A null text has
    no words, a null key counts like any other, equal rows are answered alike, an empty table gives no rows, and other
    columns are ignored. With ``fold`` one in ten documents, chosen by its id, first has its rest replaced by repeats.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed"]
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    types = [pa.int64()] * 5 + [run_type, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = [], 0
            for at in range(batch.num_rows):
                words = (batch.column(1)[at].as_py() or "").encode("utf-8", "replace").split()
                waiting.append(folded(words, batch.column(0)[at].as_py()) if fold else words)
                size += len(words)
                if size >= AT_ONCE or at == batch.num_rows - 1:
                    yield answer(batch.column(0).slice(at + 1 - len(waiting), len(waiting)), waiting)
                    waiting, size = [], 0

    def answer(keys: pa.Array, docs: list[list[bytes]]) -> pa.RecordBatch:
        flat = [w for ws in docs for w in ws]
        ids = pd.factorize(np.array([*flat, b""], object))[0][:-1]
        ends = np.cumsum([len(ws) for ws in docs])
        found = find_runs([ids[e - len(ws) : e] for e, ws in zip(ends.tolist(), docs, strict=True)])
        parts = [_answer(ws, runs) for ws, runs in zip(docs, found, strict=True)]
        columns = [pa.array([p[k] for p in parts], pa.int64()) for k in range(5)]
        columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in p[5].tolist()] for p in parts], run_type))
        columns.append(pa.array([hashlib.sha256(p[6].encode()).hexdigest() for p in parts]))
        columns.append(pa.array([p[7].decode() for p in parts], types[-1]))
        return pa.RecordBatch.from_arrays([keys, *columns], names=names)

    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    counts = ", ".join(f"{n} bigint" for n in names[1:6])
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {counts}, runs {runs}, runs_sha256 string, collapsed string")
