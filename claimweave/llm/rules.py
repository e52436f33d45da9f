"""Quality rules: gradient-boosted trees over statistics of a document, flattened into node arrays.

Statistics are counted over whole texts where the rows lie. The trees are fitted to a bounded sample of labelled rows;
a split on a constrained statistic may only let the score fall (or rise) with it, and bounds handed down from parent to
child keep that true for the whole tree. All trees lie behind each other in numpy arrays and a batch of rows walks
through all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
AT_ONCE = 500_000  # words of a batch that are counted together; a longer text is counted alone
LEAST_WORDS, MOST_REPEATED = 50, 50  # the base rules: fewer words fail, and more repeated words than so many of a hundred
SAMPLE = 20_000  # labelled rows that the trees see at most

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic -> how the score may move with it: -1 never up, 1 never down, 0 either way.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "capital_share": -1, "digit_share": 0, "calls_per_word": -1, "bars_per_word": -1, "stops_per_word": 0, "top_word_share": -1,
    "words_per_line": 0, "longest_row_share": -1, "bare_word_share": -1, "marked_line_share": -1,
}
DIRECTIONS = np.array(list(FEATURES.values()), np.int8)

_CLASS = np.zeros((256, 6))
for _row, _bytes in enumerate((SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?", b".,;:")):
    _CLASS[list(_bytes), _row] = 1


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Row numbers in groups of about ``AT_ONCE`` words at most, told by their bytes."""
    waiting, size = [], 0
    for i, t in enumerate(texts):
        if waiting and size + len(t) > 6 * AT_ONCE:
            yield waiting
            waiting, size = [], 0
        waiting.append(i)
        size += len(t)
    if waiting:
        yield waiting


def _per_doc(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the words of each document."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts (rows x COUNTS) and statistics (rows x FEATURES) of some texts."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    ends, n, docs = np.cumsum(sizes), len(flat), np.repeat(np.arange(len(texts)), sizes)
    ids, names = pd.factorize(np.array(flat + [b""], object)[:-1]) if n else (np.zeros(0, np.int64), np.zeros(0, object))
    k = max(len(names), 1)
    bytes_of = np.zeros((len(texts), 256), np.int64)
    lines, dup, marked = (np.zeros(len(texts), np.int64) for _ in range(3))
    points = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        bytes_of[i] = np.bincount(raw, minlength=256)
        points[i] = len(t) - int(((raw & 0xC0) == 0x80).sum())
        seen = set()
        for line in t.split(b"\n"):
            bare = line.strip(WHITE)
            if bare:
                lines[i] += 1
                dup[i] += line in seen
                marks = len(bare) - len(bare.translate(None, b"#*$%&|<>!"))
                marked[i] += 5 * marks > bare.count(b" ") + 1
                seen.add(line)
    white = bytes_of[:, list(WHITE)].sum(1)
    classes = bytes_of @ _CLASS
    # windows of three words, named by the document and exact word numbers
    covered = np.zeros(n, bool)
    if n > 2:
        pair, pairs = pd.factorize(ids[:-1] * k + ids[1:])
        triple, _ = pd.factorize((pair[:-1] * np.int64(k) + ids[2:]))
        inside = docs[:-2] == docs[2:]
        window, _ = pd.factorize(triple[inside] * np.int64(len(texts)) + docs[:-2][inside])
        often = np.bincount(window, minlength=1)[window] > 1 if len(window) else np.zeros(0, bool)
        at = np.flatnonzero(inside)[often]
        for step in range(3):
            covered[at + step] = True
    repeats = _per_doc(covered.astype(np.int64), ends)
    counts = np.column_stack([sizes, points - white, classes[:, 0].astype(np.int64), dup, repeats])
    of_doc, _ = pd.factorize(docs * np.int64(k) + ids)
    often = np.bincount(of_doc, minlength=1) if n else np.zeros(1, np.int64)
    first = np.zeros(n, np.int64)
    first[np.unique(of_doc, return_index=True)[1]] = 1
    top, row = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if n:
        np.maximum.at(top, docs, often[of_doc])
        new = np.concatenate(([True], (of_doc[1:] != of_doc[:-1])))
        starts = np.flatnonzero(new)
        np.maximum.at(row, docs[starts], np.diff(np.concatenate((starts, [n]))))
    plain = np.array([w.isalnum() or any(c > 127 for c in w) or any(48 <= c < 58 or 65 <= (c & 0xDF) < 91 for c in w) for w in names], bool) if n else np.zeros(0, bool)
    bare_words = _per_doc((~plain[ids]).astype(np.int64), ends)
    w, ln = np.maximum(sizes, 1), np.maximum(lines, 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2], 1)
    stats = np.column_stack([
        np.log1p(sizes), counts[:, 1] / w, classes[:, 0] / w, dup / ln, repeats / w, _per_doc(first, ends) / w, classes[:, 1] / letters,
        classes[:, 3] / np.maximum(counts[:, 1], 1), classes[:, 4] / w, bytes_of[:, ord("|")] / w, classes[:, 5] / w, top / w, sizes / ln, row / w, bare_words / w, marked / ln,
    ])
    return counts, stats


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and statistics of whole texts; a null text is empty. Words lie between ASCII white space."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    parts = [_counted([raw[i] for i in g]) for g in _groups(raw)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: a node sends a row left where its statistic is at most ``at``; a leaf points to itself."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cutoff: float  # least score that is kept

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x``."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            rows, node = np.arange(len(part))[:, None], np.repeat(self.roots[None, :], len(part), 0)
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.at[node], self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(1)
        return out


class _Grower:
    """Grows one tree level by level on binned statistics."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], depth: int, ridge: float, least: float, step: float) -> None:
        self.bins, self.edges, self.depth, self.ridge, self.least, self.step = bins, edges, depth, ridge, least, step
        self.width = max((len(e) for e in edges), default=0) + 1

    def grow(self, g: np.ndarray, h: np.ndarray) -> tuple[list[list[float]], np.ndarray]:
        """Nodes (feature, at, left, right, value) numbered from 0, and the leaf of every row."""
        nodes, where = [[0, 0.0, 0, 0, 0.0]], np.zeros(len(g), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        level = [0]
        n_features = self.bins.shape[1]
        for node in level:
            nodes[node][4] = self._value(g.sum(), h.sum(), bounds[node])
        for _ in range(self.depth):
            fresh = []
            for node in level:
                mine = np.flatnonzero(where == node)
                best = (1e-9, None)
                total_g, total_h = g[mine].sum(), h[mine].sum()
                low, high = bounds[node]
                whole = self._gain(total_g, total_h, self._value(total_g, total_h, (low, high)))
                for f in range(n_features):
                    if not len(self.edges[f]):
                        continue
                    b = self.bins[mine, f]
                    gl, hl = (np.cumsum(np.bincount(b, weights=v[mine], minlength=self.width))[: len(self.edges[f])] for v in (g, h))
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = self._value(gl, hl, (low, high)), self._value(gr, hr, (low, high))
                    gain = self._gain(gl, hl, vl) + self._gain(gr, hr, vr) - whole
                    allowed = (hl >= self.least) & (hr >= self.least) & ((vr - vl) * DIRECTIONS[f] >= 0)
                    gain = np.where(allowed, gain, -np.inf)
                    cut = int(np.argmax(gain))
                    if gain[cut] > best[0]:
                        best = (float(gain[cut]), (f, cut, float(vl[cut]), float(vr[cut])))
                if best[1] is None:
                    continue
                f, cut, vl, vr = best[1]
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, 0.0, left, left, vl], [0, 0.0, right, right, vr]]
                nodes[node][:4] = [f, float(self.edges[f][cut]), left, right]
                where[mine] = np.where(self.bins[mine, f] <= cut, left, right)
                mid = (vl + vr) / 2
                bounds[left] = (low, mid) if DIRECTIONS[f] > 0 else (mid, high) if DIRECTIONS[f] < 0 else (low, high)
                bounds[right] = (mid, high) if DIRECTIONS[f] > 0 else (low, mid) if DIRECTIONS[f] < 0 else (low, high)
                fresh += [left, right]
            level = fresh
        for node in nodes:
            node[4] *= self.step
        return nodes, where

    def _value(self, g, h, bounds):
        return np.clip(-g / (h + self.ridge), *bounds)

    def _gain(self, g, h, v):
        return -(g * v + 0.5 * (h + self.ridge) * v * v)


def fit_trees(x: np.ndarray, good: np.ndarray, trees: int = 50, depth: int = 4, bins: int = 48, step: float = 0.25, lost: float = 0.001) -> Trees | None:
    """Boosted trees for the log odds of ``good``; none if a class is missing.

    A fifth of the rows is held out: the cutoff is the largest one up to even odds that rejects at most the share ``lost``
    of the good rows held out.
    """
    good = good.astype(float)
    held = np.arange(len(good)) % 5 == 4
    fit = ~held
    if len(good) == 0 or good[fit].min(initial=1) == good[fit].max(initial=0) or good[fit].sum() in (0, fit.sum()):
        return None
    edges = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[fit, f].max()] for f, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = good[fit].mean()
    base = float(np.log(share / (1 - share)))
    score = np.full(len(good), base)
    grower = _Grower(binned[fit], edges, depth, ridge=1.0, least=2.0, step=step)
    all_nodes, roots = [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score[fit]))
        nodes, leaf = grower.grow(p - good[fit], p * (1 - p))
        first = len(all_nodes)
        roots.append(first)
        all_nodes += [[f, at, left + first, right + first, v] for f, at, left, right, v in nodes]
        score[fit] += np.array([n[4] for n in nodes])[leaf]
        if len(nodes) == 1:
            break
    table = np.array(all_nodes)
    model = Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots), depth, base, 0.0)
    kept = np.sort(model.score(x[held & (good > 0)]))
    cutoff = min(0.0, float(kept[int(lost * len(kept))])) if len(kept) else 0.0
    return Trees(**(model.__dict__ | {"cutoff": cutoff}))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents, picked by a hash of the id.

    An id with several labels takes the lowest; of several rows with one id one is taken; null ids and labels are left out.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_good")).na.drop().groupBy("doc_id").agg(F.min("_good").alias("_good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "doc_id")  # at most ``most`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, stats = statistics(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "good", "stats"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "_good", "_text").mapInArrow(run, f"doc_id {kind}, good int, stats array<double>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("good", "stats")).alias("v"))
    table = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("v.good", "v.stats").toArrow()
    if not table.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, bool)
    return np.array(table.column("stats").to_pylist()), table.column("good").to_numpy() > 0


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``score`` (log odds of being good) and ``kept`` of every row.

    ``base_failed``: fewer than 50 words or more than half of the words in repeated windows of three. ``kept``: not failed
    and a score of at least the cutoff. A null text is empty (and fails), repeated rows and null keys are judged like any
    other, other columns are ignored, an empty table gives no rows. Without labels of both classes the base rules alone
    decide and the score is null.
    """
    model = fit_trees(*labelled_sample(docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs, labels, most, text))
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, stats = statistics(batch.column(1).to_pylist())
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            score = model.score(stats) if model else None
            kept = ~failed if model is None else ~failed & (score >= model.cutoff)
            scores = pa.nulls(len(counts), pa.float64()) if model is None else pa.array(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), scores, pa.array(kept)], names=[key, *COUNTS, "base_failed", "score", "kept"])

    fields = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {fields}, base_failed boolean, score double, kept boolean")
