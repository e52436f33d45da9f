import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import repeats


def brute(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield gone


def documents():
    rnd = random.Random(5)
    stock = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    words = lambda n: " ".join(rnd.choice(stock) for _ in range(n))
    passage, line, out = words(80), words(30), []
    for k in range(48):
        text = words(rnd.randint(5, 200))
        text += passage + words(20) if k % 3 == 0 else ""
        text = f"{line}\n{text}" if k % 4 == 0 else text
        out.append(text + " abc" * rnd.randint(0, 150) * (k % 7 == 0))
    out += [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in out[:12]]
    out += [*out[:5], "", None, "x" * 700, "ab" * 99, "ab" * 100, "ab" * 101, "q" * 199, "é" * 300, out[3][:250]]
    return [(k if k != 4 else None, t) for k, t in enumerate(out)] + [(0, out[0])]


@pytest.mark.parametrize("shard_bytes", [500_000, 3_000])  # the small one splits anchors with many contexts
def test_removes_what_brute_force_removes(spark, shard_bytes):
    rows = documents()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, spans int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, shard_bytes=shard_bytes).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (k, _), t, gone in zip(rows, texts, brute(texts, 200), strict=True):
        runs = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        want.append((-1 if k is None else k, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert got == sorted(want)


def test_interval_expansion_finds_repeated_starts():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        pieces = [bytes(rnd.integers(97, 99, rnd.integers(3, 30)).tolist()) for _ in range(rnd.integers(1, 8))]
        text, starts, at = [], [], 0
        for k, p in enumerate(pieces):
            text += [*p, 256 + k]
            starts += [(at + i, p[i : i + 3]) for i in range(len(p) - 2)]
            at += len(p) + 1
        count = Counter(s for _, s in starts)
        found = repeats.repeated_starts(np.array(text), 3)
        assert set(np.flatnonzero(found).tolist()) == {i for i, s in starts if count[s] > 1}


def test_anchors_cover_every_window_once():
    rnd = random.Random(2)
    data = bytes(rnd.choice(b"ab c") for _ in range(3000)) + b"z" * 400
    key, place, first, last = repeats.anchors(data, 200)
    assert first.tolist() == [0, *(last[:-1] + 1).tolist()] and last[-1] == len(data) - 200
    assert all(a <= p <= b + 200 - repeats.GRAM for p, a, b in zip(place, last, first, strict=True))
    assert repeats.anchors(b"short", 200)[0].size == 0


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_many_equal_rows_with_one_id(spark):
    """Equal rows share one list of places: the work grows with their number, not with its square."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    df = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    df = df.unionByName(spark.createDataFrame([(1, "short"), (2, text[:150] + "#" + text[200:420])], "doc_id bigint, text string"))
    got = {tuple(r): r[4] for r in repeats.remove_repeats(df).groupBy("doc_id", "n_bytes", "n_removed", F.size("spans").alias("k")).count().collect()}
    assert got == {(None, 3000, 3000, 1, 2000): 2000, (1, 5, 0, 0, 1): 1, (2, 371, 220, 1, 1): 1}


def test_suffixes_are_in_order_whatever_repeats():
    rng = random.Random(8)
    for _ in range(300):
        text = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(1, 70))] + [300]
        for i in rng.sample(range(len(text) - 1), min(len(text) - 1, rng.randint(0, 3))):
            text[i] = 256 + i  # a separator, found once
        assert repeats.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_of_a_text_are_found_once(spark, tmp_path, monkeypatch):
    """Three passes over all texts were most of the work before."""
    seen = spark.sparkContext.accumulator(0)
    plain = repeats.anchors

    def counted(data, length):
        seen.add(1)
        return plain(data, length)

    monkeypatch.setattr(repeats, "anchors", counted)
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(i, f"{i} {shared} {'xyz'[i % 3] * 30}{i}") for i in range(12)], "doc_id bigint, text string")
    got = repeats.remove_repeats(df).collect()
    assert all(r.n_removed >= 400 for r in got)
    assert seen.value == 12
