import random
import re
from functools import cache

from claimweave.llm import secrets as S

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_base_patterns_match_plain_regular_expressions():
    rnd = random.Random(3)
    parts = ["password", "Token", "apikey", "API_KEY", "paſſword", "secret", " ", "=", ":", '"', "'", "abcdef", "AKIA", "AKIA" + "Z" * 17, "0123456789abcdef" * 2, "é", "x", "."]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert S.scan_text(text)[0] == brute(text)


def cheapest(value, words, period):
    """Minimum over all segmentations, by recursion over the first segment."""
    starts = S.segments(value, words, period)

    @cache
    def rest(i):
        if i == len(value):
            return 0.0
        found = [cost + S.SEGMENT + rest(end) for end, cost in starts[i]]
        found += [(j - i) * S.BRUTE + S.SEGMENT + rest(j) for j in range(i + 1, len(value) + 1)]
        return min(found)

    return rest(0) - S.SEGMENT


def test_guess_cost_is_the_minimum_over_all_segmentations():
    rnd = random.Random(4)
    parts = ["password", "p4ss", "qwerty", "asdf", "2019", "12-03-1999", "aaa", "xyxy", "abcd", "K", "7", "$", "zq"]
    for _ in range(400):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
        assert abs(S.guess_cost(value) - cheapest(value, S.DEFAULT_WORDS, 16)) < 1e-9
    assert S.guess_cost("") == 0
    assert S.guess_cost("password") < S.guess_cost("P@ssw0rd") < S.guess_cost("x8$kQz!mP0vr")
    assert S.guess_cost("aaaaaaaaaaaaaaaa") < 3 and S.guess_cost("qwertyuiop") < 8


def test_added_spans_keep_base_ones():
    text = 'passphrase: "correct horse x9!kQ#2z" password=hunter2hunter'
    base, every, cost = S.scan_text(text)
    assert [(text[a:b], k) for a, b, k in base] == [("password=hunter2hunter", "assign")]
    assert [text[a:b] for a, b, k in every if k == "guess"] == ["correct horse x9!kQ#2z"] and cost >= 10
    assert S.scan_text("pwd: welcome1")[1] == []  # cheap to guess


def test_table_cases(spark):
    df = spark.createDataFrame(
        [(1, None, 5), (2, "", 6), (None, "token=abcdefg", 7), (4, "token=abcdefg", 8), (4, "token=abcdefg", 8), (5, "z" * 300_000 + " secret: zzzzzz1", 9)], "doc_id bigint, text string, spans int"
    )
    got = sorted((r.doc_id or -1, r.n_assign, r.spans) for r in S.scan_secrets(df).collect())
    assert got == [(-1, 1, "assign:0:13"), (1, 0, ""), (2, 0, ""), (4, 1, "assign:0:13"), (4, 1, "assign:0:13"), (5, 1, "assign:300001:300016")]
    assert S.scan_secrets(df.limit(0)).count() == 0
    assert len(S.guess_cost.__doc__) and S.guess_cost("qw" * 20_000) > 0  # long values take linear time


def test_words_of_the_corpus_are_cheap(spark):
    texts = ["Internationalization is hard.", "internationalization (again), hard!", "an internationalization", "token: kqzxw9hard", "x kqzxw9 y", None, "once only"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, word int")
    words = S.corpus_words(df, least_docs=2)
    assert {w: r - len(S.DEFAULT_WORDS) for w, r in words.items() if w not in S.DEFAULT_WORDS} == {"internationalization": 1, "hard": 2}
    assert S.guess_cost("internationalization") == 20 and S.guess_cost("internationalization", words) < 3
    assert S.guess_cost("Internationalization2019hard", words) < 8 < S.guess_cost("kqzxwvbrtplm", words)
    assert len(S.corpus_words(df, most=1, least_docs=2)) == len(S.DEFAULT_WORDS) + 1 and S.corpus_words(df.limit(0)) == S.DEFAULT_WORDS
    rnd = random.Random(5)
    parts = ["internationalization", "hard", "Hard", "qwerty", "2019", "aaa", "zq", "7"]
    for _ in range(100):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
        assert abs(S.guess_cost(value, words) - cheapest(value, words, 16)) < 1e-9
