import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from claimweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "ab c\n\t'sx\x1c\x1f\x85  é漢字🙂́٣½!?.​"


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def texts():
    rnd = random.Random(1)
    odd = ["", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "a" * 5000, "ab" * 3000 + "é" * 999, " " * 300, "the" * 70, "\x00\x00 z"]
    return odd + ["".join(rnd.choice([*LETTERS, "<|endoftext|>", "they're", "ing"]) for _ in range(rnd.randint(0, 150))) for _ in range(800)]


def test_ids_and_text_equal_the_library():
    codec, tokenizer, sample = bpe.Codec(open(PATH).read(), cached=2000), library(), texts()
    for text, packed in zip(sample, codec.encode(sample, at_once=3000), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed) == tokenizer.decode(ids, skip_special_tokens=False)
        assert codec.encode_long(text, step=7) == packed


def test_long_and_short_pieces_have_one_rule():
    codec, rnd = bpe.Codec(open(PATH).read()), random.Random(2)
    pieces = [bytes(rnd.choice(b"thein aou\xc3\xa9") for _ in range(rnd.randint(1, 64))) for _ in range(500)]
    assert codec._many(pieces, 64) == [codec._one(p) for p in pieces]


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "a b", 0), (3, "a b", 0), (4, "word " * 60_000, 0)], "doc_id bigint, text string, ids int")
    got = bpe.encode_decode(df, PATH)
    rows = sorted((r.doc_id or -1, len(r.ids) // 4, r.decoded[:4]) for r in got.collect())
    assert rows == [(-1, 2, "a b"), (1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b"), (4, 60_001, "word")]
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
