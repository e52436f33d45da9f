import random
import re

from claimweave.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub(r"\D", "", s)
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]


def test_base_patterns_match_plain_regular_expressions():
    rnd = random.Random(8)
    parts = ["a", "b.c", "@", ".", "x-y", "1", "25", "300", "0001", "+", " ", "-", "4111111111111111", "(5", ")", "é", "%"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert P.identifiers(text) == brute(text), text


def found(text):
    base, every = P.scan_text(text)
    assert every[: len(base)] == base
    return [(text[a:b], k) for a, b, k in every if (a, b, k) not in base]


def test_disguises_map_back_to_the_source():
    assert found("mail bob [at] example [dot] com now") == [("bob [at] example [dot] com", "email")]
    assert found("to bob at example dot com, or") == [("bob at example dot com", "email")]
    assert found("say plus one two zero two five five five zero one seven nine x") == [("plus one two zero two five five five zero one seven nine", "phone")]
    assert found("hi bоb@exаmple.com") == [("bоb@exаmple.com", "email")] or ("bоb@exаmple.com", "email") in found("hi bоb@exаmple.com")
    assert found("４１１１ １１１１ １１１１ １１１１!") == [("４１１１ １１１１ １１１１ １１１１", "card")]
    assert found("4111​1111​1111​1111 z") == [("4111​1111​1111​1111", "card")]
    assert found("10[.]0[.]0[.]255") == [("10[.]0[.]0[.]255", "ip")]


def test_more_ways_to_write_the_signs():
    for text in ("bob&#64;example&#46;com", "bob-at-example-dot-com", "bobATexampleDOTcom", "bob_at_example_dot_com", "bob(at)mail(dot)example(dot)org", "BOB AT EXAMPLE DOT COM", "bob @ example.com"):
        assert found(f"to {text}, or") == [(text, "email")], text


def test_prose_stays_clean():
    for text in ("Meet me at noon. Two dots, one at a time", "une seule, sept fois six", "I looked at it. At last", "the point at issue", "look-at-me.com", "AT&amp;T &#8211; DOTTED"):
        assert found(text) == []


def test_host_names_times_and_numbers_after_at_stay():
    for text in (
        "look at github.com for it", "Visit us at www.example.org.", "The talk is at python.org today", "at 5.30 pm we met at 10.15 sharp", "Mail us at example.com or call",
        "version 2.0 at github.com", "on 2024-05-01 at example.com", "priced at 3.50 each", "See more at docs.example.co.uk/page", "We look at v1.2 and at v2.0.", "write to me at example.org",
    ):
        assert found(text) == [] and P.masked(text, P.scan_text(text)[1]) == text, text
    for before, address in (("write to ", "bob at example.com"), ("E-mail: ", "ann at mail.example.org"), ("contact him, ", "j.smith at example.com"), ("or ", "bob_7 at example.net"), ("look, ", "bob at example dot com")):
        assert found(f"{before}{address} now") == [(address, "email")], address


def test_rewriting_returns_every_span():
    out = P.Rewriting("abcdef")
    out.replace(1, 3, "X")
    out.replace(4, 5, "")
    assert out.text() == "aXdf"
    assert out.back(0, 4) == (0, 6) and out.back(1, 2) == (1, 3) and out.back(2, 3) == (3, 4)


def test_table_cases(spark):
    df = spark.createDataFrame(
        [(1, None, "k"), (2, "", "k"), (None, "a@b.cd", "k"), (3, "x a@b.cd", "k"), (3, "x a@b.cd", "k"), (4, "1" * 200_000 + " 1.2.3.4", "k")], "doc_id bigint, text string, masked string"
    )
    got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.base_spans, r.masked[-12:]) for r in P.scan_personal(df).collect())
    assert got == [
        (-1, 1, 0, "email:0:6", "[email]"), (1, 0, 0, "", ""), (2, 0, 0, "", ""), (3, 1, 0, "email:2:8", "x [email]"), (3, 1, 0, "email:2:8", "x [email]"),
        (4, 0, 1, "ip:200001:200008", "1111111 [ip]"),
    ]
    assert P.scan_personal(df.limit(0)).count() == 0
    assert P.masked("ab cd", [(0, 4, "email"), (3, 5, "ip")]) == "[email]"


def test_disguises_beside_a_plain_fragment():
    for text in ("bоb@example.com", "john [dot] smith@example.com", "john​ny@example.com", "ann.bоlt@mail.example.com", "bob@mail.exаmple.com", "bob@mail.example [dot] com"):
        base, every = P.scan_text(f"to {text} now")
        assert (3, 3 + len(text), "email") in every and every[: len(base)] == base, text
        assert P.masked(f"to {text} now", every) == "to [email] now", text
    assert found("to bob@example.com, zero one and а") == []  # nothing is added to what a base span holds


def test_gate_passes_every_disguise(monkeypatch):
    ats = [" [at] ", "(@)", "{ arroba }", "&#64;", "&#x40;", "&#X40;", "&commat;", "_at_", " _AT_ ", " @ ", "\t@\n", " at ", " AT ", "\nat\t", "-at-", "AT"]
    dots = [".", " [dot] ", "(.)", "{point}", "<punkt>", "[ punto ]", "&#46;", "&#x2e;", "&period;", "_dot_", "-dot-", " dot ", "DOT", " . "]
    texts = [f"write to bob{a}example{d}com now" for a in ats for d in dots] + [f"to bob{a}example.com" for a in ats] + [f"10{d}0{d}0{d}255" for d in dots] + [f"bob@example{d}com" for d in dots]
    for word in P.DIGIT_WORDS:
        texts += [f"say {sep.join([word] * 16)} x" for sep in (" ", "-", ", ", ".")] + [f"(plus {' '.join([word.upper()] * 12)})", " ".join([word.replace("s", "ſ")] * 16)]
    gated = [P.scan_text(t) for t in texts]
    monkeypatch.setattr(P, "may_be_disguised", lambda text: True)
    assert gated == [P.scan_text(t) for t in texts]
    assert (9, 27, "email") in gated[texts.index("write to bob at example.com now")][1]
