"""Counts against plain Python, held-out accuracy, and monotonic scores."""

import random
import re

import numpy as np
import pytest

from claimweave.llm import rules

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, kept string, n_words int"
LABELS = "doc_id bigint, quality int, toxic int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)], n < 50 or 100 * len(repeated) > 50 * n


def odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "b", "été", "\U0001f600", "#", "|", "c d", "x!"]
    texts = [None, "", " \n\t", "a", "a b", "a b c", "\n".join(["one line"] * 4), "a\r\nb\r\na\r\n"]
    for _ in range(120):
        texts.append("".join(rng.choice(alphabet) + rng.choice([" ", " ", "\n", "\x0b", "  "]) for _ in range(rng.choice([3, 20, 200]))))
    return texts


@pytest.mark.parametrize("at_once", [1, 500_000])
def test_counts(monkeypatch, at_once):
    monkeypatch.setattr(rules, "AT_ONCE", at_once)
    texts = odd_texts()
    counts, stats = rules.statistics(texts)
    assert counts.tolist() == [plain(t)[0] for t in texts]
    assert np.isfinite(stats).all() and stats.shape == (len(texts), len(rules.FEATURES))


def test_rows_and_missing_labels(spark):
    data = [(i % 50 if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame([(i, t, "no", 0) for i, t in data], SCHEMA)
    for labels in ([], [(1, 1, 0), (None, 0, 0), (2, None, 0)]):
        got = rules.judge(df, spark.createDataFrame(labels, LABELS)).collect()
        want = [(i, *plain(t)[0], plain(t)[1], None, not plain(t)[1]) for i, t in data]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert rules.judge(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_held_out(spark):
    """Labels of one half of the documents judge the other half."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    part = labels.filter("doc_id % 2 = 0")
    rows = rules.judge(docs, part).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "base_failed", "kept", "score").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0 and not r["base_failed"]]
    assert len(good) > 50 and sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert len(bad) > 5 and sum(r["kept"] for r in bad) <= 0.15 * len(bad)
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_scores_are_monotonic():
    """Whatever the data say, the score never rises with a constrained statistic."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, len(rules.FEATURES)))
    good = (x[:, 2] + np.sin(3 * x[:, 3]) + x[:, 0] * x[:, 5] + 0.3 * rng.normal(size=3000)) > 0  # pulls against the constraints
    model = rules.fit_trees(x, good, trees=30)
    assert len(model.feature) > 100
    rows = rng.normal(size=(60, len(rules.FEATURES)))
    for f, direction in enumerate(rules.FEATURES.values()):
        steps = np.repeat(rows, 40, 0)
        steps[:, f] = np.tile(np.linspace(-4, 4, 40), 60)
        moves = np.diff(model.score(steps).reshape(60, 40), axis=1)
        if direction:
            assert (moves * direction >= -1e-12).all()
    free = rng.normal(size=3000)
    assert np.corrcoef(model.score(x), good)[0, 1] > np.corrcoef(free, good)[0, 1] + 0.2


def test_flat_arrays_walk_like_single_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(rules.FEATURES)))
    model = rules.fit_trees(x, x[:, 0] > 0.2, trees=10)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.at[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(model.score(x), [walk(r) for r in x])


def test_one_class_gives_no_trees():
    assert rules.fit_trees(np.zeros((10, len(rules.FEATURES))), np.ones(10, bool)) is None
    assert rules.fit_trees(np.zeros((0, len(rules.FEATURES))), np.zeros(0, bool)) is None
