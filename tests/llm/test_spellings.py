"""Near words and forms against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from claimweave.llm import spellings

SCHEMA = "doc_id bigint, text string, word string, n bigint, key string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, blur):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if blur and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if c >= 2 and len(w) >= 7}
    out, form = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def variants(seed):
    rng = random.Random(seed)
    letters = "abéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 13]))) for _ in range(12)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 40, 300])
        for _ in range(8):
            v, at = w, rng.randrange(len(w))
            for _ in range(rng.choice([1, 1, 2])):
                at = min(at, len(v) - 1)
                v = {0: v[:at] + v[at + 1 :], 1: v[:at] + rng.choice(letters) + v[at:], 2: v[:at] + rng.choice(letters) + v[at + 1 :]}[rng.randrange(3)]
            words += [v.title() if rng.random() < 0.3 else v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    return [(k % 40 if k % 40 else None, rng.choice([" ", "\n", "1", "Ā"]).join(words[k::60])) for k in range(60)]


@pytest.mark.parametrize("crowded", [0, 20, 100_000])
def test_brute_force(spark, crowded):
    docs = [*variants(crowded), (7, None), (8, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in docs], SCHEMA)
    for blur in (False, True):
        got = {tuple(r) for r in spellings.spelling_groups(df, blur=blur, crowded=crowded).collect()}
        assert got == brute(docs, blur)


def test_short_words_and_ties(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "abd", "xbc"]
    got = {tuple(r) for r in spellings.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowded=0).collect()}
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if near(a, b)}
    assert got == want


def test_chain_and_tie_of_forms(spark):
    counts = [("aaaaaaa", 3), ("aaaaaab", 30), ("aaaaabb", 3000), ("aaaaaac", 30), ("zzzzzzz", 5)]
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spellings.forms(spark.createDataFrame(counts, "word string, n bigint")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaaabb", 2, 30)  # of two with 30 the smaller one
    assert got["aaaaaac"] == (None, "aaaaaac", 2, None)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 0, None)


def test_empty_table(spark):
    assert spellings.spelling_groups(spark.createDataFrame([], SCHEMA), blur=True).count() == 0


def test_a_crowded_chunk_proposes_few_pairs(spark):
    """Words with one common half: cut further, their groups stay small."""
    rng = random.Random(5)
    words = sorted({"commonhalf" + "".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(3000)})
    words += [words[0][:-1] + "z", words[5][:12] + words[5][13:]]
    got = {tuple(r) for r in spellings.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    index = set(words)
    want = set()
    for w in words:  # by deletion and replacement at every place
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in index:
                want.add((w[:i] + w[i + 1 :], w))
            want |= {tuple(sorted((w, v))) for c in "abcdefghijz" if (v := w[:i] + c + w[i + 1 :]) in index and v != w}
    assert got == want
