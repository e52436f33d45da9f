import random

from claimweave.llm import tiling


def slow_tiles(pattern, text, least):
    """Greedy string tiling by comparing all places, longest match first, then leftmost."""
    used_p, used_t, total = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(pattern)):
            for j in range(len(text)):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and i + k not in used_p and j + k not in used_t:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        used_p |= set(range(i, i + k))
        used_t |= set(range(j, j + k))
        total.append((i, j, k))


def test_tiles_are_greedy_and_do_not_overlap():
    rnd = random.Random(1)
    for _ in range(150):
        pattern = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 40))]
        text = [rnd.randint(1, 6) for _ in range(rnd.randint(0, 20))] + pattern[rnd.randint(0, 10) : rnd.randint(10, 40)] + [rnd.randint(1, 6) for _ in range(9)]
        got = tiling.tiles(pattern, text, 3, start=8)
        assert all(pattern[i : i + k] == text[j : j + k] and k >= 3 for i, j, k in got)
        for side in (0, 1):
            places = [x for t in got for x in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        slow = slow_tiles(pattern, text, 3)
        assert max((k for _, _, k in got), default=0) == max((k for _, _, k in slow), default=0)


def sentence(rnd, n, stock):
    return " ".join(rnd.choice(stock) for _ in range(n))


def test_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    stock = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    phrase = "Answer the following question with one word:"
    items = [(i, f"{phrase} {sentence(rnd, rnd.randint(8, 40), stock)}.") for i in range(25)] + [(30, "two words"), (31, ""), (32, None), (33, "lonelyword")]
    docs = []
    for d in range(60):
        text = sentence(rnd, rnd.randint(0, 200), stock)
        if d % 3 == 0:
            text = f"{phrase} {text}"
        if d % 4 == 0:
            words = items[rnd.randrange(25)][1].split()
            cut = len(words) // 2
            parts = [words[cut:], words[:cut]] if d % 8 == 0 else [words]  # reordered, or as it stands
            text += " " + " and then ".join(" ".join(p).upper() for p in parts) + " tail"
        if d == 7:
            text += " Two, WORDS!"
        docs.append((d, text, 1))
    docs += [(None, items[0][1], 1), (70, None, 1), (71, "", 1), docs[0], docs[0]]
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string, item int"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id): (r.n_words, r.covered) for r in got.collect()}
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            words = tiling.words_of(item)
            if words:
                n, _ = tiling.covered_words(words, [tiling.words_of(text)])
                if n >= 0.5 * len(words):
                    want[d, i] = (len(words), n)
    assert found == want and len(found) == got.count()
    assert (7, 30) in found and any(k[0] == 8 for k in found) and (None, 0) in found


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert tiling.contaminated(docs, items).count() == 0
    assert tiling.contaminated(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
    assert tiling.contaminated(items.withColumnRenamed("item_id", "doc_id"), items).count() == 1


def test_items_that_repeat_phrases_against_brute_force(spark):
    rnd = random.Random(9)
    stock = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(900)]
    items, docs = [], []
    for i in range(12):
        phrases = [sentence(rnd, rnd.randint(5, 7), stock) for _ in range(1 + i % 3)]
        items.append((i, " ".join(f"{phrases[k % len(phrases)]} {sentence(rnd, 5, stock)}" for k in range(10))))
        docs.append((10 * i, items[-1][1]))  # the copy in which the item's other seeds occur
        for d in range(1, 5):
            docs.append((10 * i + d, " ".join(f"{rnd.choice(phrases)} {sentence(rnd, 3, stock)}" for _ in range(rnd.randint(6, 14)))))
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = {}
    for d, text in docs:
        for i, item in items:
            words = tiling.words_of(item)
            n, _ = tiling.covered_words(words, [tiling.words_of(text)])
            if n >= 0.5 * len(words):
                want[d, i] = n
    assert {(r.doc_id, r.item_id): r.covered for r in got.collect()} == want and any(d % 10 for d, _ in want)
