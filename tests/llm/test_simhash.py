import random

import numpy as np
import pytest
import xxhash

from claimweave.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, fps, distance=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprint():
    rnd = random.Random(2)
    for n in [0, 1, 2, 3, 4, 5, 6, *range(7, 400, 13)]:
        text = " \n".join("".join(rnd.choice("abcÉé") for _ in range(rnd.randint(1, 6))) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(" \t\n ") == 0


def table(spark, fps):
    return spark.createDataFrame([(int(f),) for f in np.array(fps, np.uint64).view(np.int64)], "fp bigint")


@pytest.mark.parametrize("heavy", [4096, 4])
def test_links_connect_what_brute_force_connects(spark, heavy):
    rnd = random.Random(6)
    fps = {0, 1, 3, 2**64 - 1}
    for _ in range(40):
        seed = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # chains that step up to five bits at a time
            fps.add(seed)
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                seed ^= 1 << b
    dense = rnd.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    found = simhash.links(simhash.in_blocks(simhash.grid(table(spark, fps)), heavy)).collect()
    a = [int(np.int64(r.a).view(np.uint64)) for r in found]
    b = [int(np.int64(r.b).view(np.uint64)) for r in found]
    assert all(x != y for x, y in zip(a, b, strict=True))
    place = {f: i for i, f in enumerate(fps)}
    label = simhash.forest(len(fps), np.array([place[x] for x in a]), np.array([place[x] for x in b]))
    want = slow_components(list(range(len(fps))), fps)
    assert label.tolist() == want
    if heavy > 100:
        assert len(found) < 20 * len(fps)  # forests, not all pairs


def test_table_cases(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = " ".join(words)
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [(7, base), (3, near), (9, None), (8, ""), (None, base), (7, base), (5, "other"), (None, "alone"), (6, " ".join(rnd.choice(words) for _ in range(300)))]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id bigint, text string, fp int, component int")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted((str(k), f"{f:016x}", str(c)) for (k, _), f, c in zip(rows, fps, slow_components([k for k, _ in rows], fps), strict=True))
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
