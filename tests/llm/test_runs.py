"""Runs against a scan of every period, and the collapsed text against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from claimweave.llm import runs

SCHEMA = "doc_id bigint, text string, start int, runs string"


def brute(s):
    n, out = len(s), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and all(any(s[k] != s[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, fold):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if fold and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), " ".join(w for i, w in enumerate(words) if i not in gone))


def sequence(rng):
    n, k = rng.choice([0, 1, 5, 6, 30, 80, 200]), rng.choice([1, 2, 3, 50])
    d = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, n // 5)
            for i in range(a, min(n, a + p * rng.randint(1, 9))):
                d[i] = d[a + (i - a) % p]
    return d


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_batches(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [sequence(rng) for _ in range(rng.randint(1, 6))]
        found = runs.find_runs([np.array(d, np.int64) for d in docs])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(d) for d in docs]


def test_small_candidate_blocks(monkeypatch):
    rng = random.Random(9)
    docs = [sequence(rng) for _ in range(30)]
    monkeypatch.setattr(runs, "CANDIDATES", 7)
    found = runs.find_runs([np.array(d, np.int64) for d in docs])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(d) for d in docs]


def test_grammar_extensions():
    """Exact extensions to both sides, also over levels of the grammar."""
    rng = random.Random(3)
    for _ in range(30):
        s = [1000, *sequence(rng), 1001, *(rng.choice([1, 2]) for _ in range(rng.randint(1, 60))) , 1002]
        i = np.array([rng.randrange(1, len(s) - 1) for _ in range(50)])
        j = np.array([rng.randrange(1, len(s) - 1) for _ in range(50)])
        i, j = i[i != j], j[i != j]
        grammar = runs.Grammar(np.array(s))
        ahead, behind = grammar.extend(i, j), grammar.extend(i, j, back=True)
        for a, b, x, y in zip(i.tolist(), j.tolist(), ahead.tolist(), behind.tolist(), strict=True):
            n = next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k])
            m = next(k for k in range(len(s)) if min(a, b) - k < 0 or s[a - k] != s[b - k])
            assert (x, y) == (n, m)


def test_long_rows_stay_cheap():
    """A long repeated text needs a logarithmic number of levels."""
    s = np.tile(np.arange(7), 30_000)
    grammar = runs.Grammar(np.concatenate(([9], s, [10])))
    assert grammar.extend(np.array([1]), np.array([8]))[0] == len(s) - 7
    assert len(grammar.levels) < 60
    assert [r.tolist() for r in runs.find_runs([s])] == [[[0, len(s), 7]]]


@pytest.mark.parametrize("fold", [False, True])
def test_rows(spark, monkeypatch, fold):
    rng = random.Random(11)
    data = [(k, rng.choice([" ", "\n", "\t\r "]).join(f"w{v}" for v in sequence(rng))) for k in range(150)]
    data += [(None, None), (None, "a a a a a a"), (3, ""), (3, ""), (4, "é é " * 9), (5, "x " * 5), (6, "x y " * 4)]
    df = spark.createDataFrame([(i, t, 1, "extra") for i, t in data], SCHEMA)
    found = runs.repeated_runs(df, fold=fold)
    got = [tuple(r) for r in found.select("doc_id", "n_runs", found["start"], "length", "period", "exponent_milli", "runs_sha256", "collapsed").collect()]
    assert sorted(map(str, got)) == sorted(str(expected(i, t, fold)) for i, t in data)


def test_empty_table(spark):
    assert runs.repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0
