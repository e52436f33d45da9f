import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from claimweave.llm import pii, quality, tiling
from tests.llm.test_copies import components


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(4)
    stock = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    words = lambda n: " ".join(rnd.choice(stock) for _ in range(n))
    items = [(i, words(20)) for i in range(4)]
    docs = [(i, words(rnd.randint(30, 120)) + ".") for i in range(80)]
    docs += [(90, docs[3][1]), (91, docs[3][1].replace(" ", "  ")), (92, f"{words(30)} {items[1][1]} {words(20)}"), (93, "@@## %% !!" * 30), (94, f"mail bob@example.com {words(40)}")]
    near = docs[7][1].split()
    docs += [(97, " ".join([*near[:-3], "changed", *near[-2:]])), (98, " ".join([*near[:10], "far", *near[11:20], "away", *near[21:]]))]  # one within 0.8, one beyond
    docs += [(None, words(50)), (95, None), (96, ""), (5, docs[5][1]), (6, words(60))]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in C.COLUMNS) for r in df.collect())


def test_every_stage_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = C.keep_good(spark, docs, data)
    judged = quality.classify(docs.select(C.COLUMNS), spark.read.parquet(f"{data}/labels.parquet"))
    assert good.columns == C.COLUMNS and rows_of(good) == rows_of(judged.filter("keep"))
    assert 93 not in {r.doc_id for r in good.collect()} and good.count() >= 84

    single = C.drop_near_duplicates(spark, good, data)
    before = good.collect()
    groups = {}
    for r, x in zip(before, components(range(len(before)), [(r.text or "").lower() for r in before]), strict=True):
        groups.setdefault(x, []).append(r)
    assert len(groups) == len(before) - 4
    kept = single.collect()
    assert single.columns == C.COLUMNS and len(kept) == len(groups)
    ids = sorted(str(min((r.doc_id for r in g if r.doc_id is not None), default=None)) for g in groups.values())
    assert sorted(str(r.doc_id) for r in kept) == ids

    clean = C.drop_contaminated(spark, single, data)
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leak = lambda t: any(tiling.covered_words(tiling.words_of(i), [tiling.words_of(t)])[0] >= 0.5 * len(tiling.words_of(i)) for i in items)
    assert rows_of(clean) == sorted(tuple(str(r[c]) for c in C.COLUMNS) for r in kept if not leak(r.text)) and clean.count() == len(kept) - 1

    masked = C.mask_personal(spark, clean, data)
    want = [pii.masked(r.text or "", pii.scan_text(r.text or "")[1]) for r in clean.collect()]
    assert masked.columns == C.COLUMNS and sorted(r.text for r in masked.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = sorted((r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in C.encode(spark, masked, data).collect())
    assert coded == sorted((len(i), i) for i in (tokenizer.encode(t, add_special_tokens=False).ids for t in want))


def test_run_applies_all_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, data)
    assert sorted(map(str, C.run(spark, data).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert C.run(spark, folder).count() == 0


def test_copies_with_negative_ids_leave_the_smallest(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text, "en", "s", len(text)) for i in (-12, -13, 4, -5, -(1 << 63), (1 << 63) - 1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    order = [r.doc_id for r in docs.select("doc_id", C._row().alias("r")).orderBy("r").collect()]
    assert order == [-(1 << 63), -13, -12, -5, 4, (1 << 63) - 1, None]
    assert [r.doc_id for r in C.drop_near_duplicates(spark, docs.filter("doc_id > -1000"), "").collect()] == [-13]
