import random
import re

from pyspark.sql import functions as F

from claimweave.functions import identity, text, web
from claimweave.operators import joins, quality, text_joins
from claimweave.operators.sections import paragraph_sections
from tests.conftest import rows


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first()[0]


def test_page_text(spark):
    page = "<p>One&nbsp;&amp; two</p><script>var a='</p>';</script><div>three <b>bold</b><br>x</div><ul><li>a</li><li>b</li></ul><svg>no</svg>"
    assert one(spark, text.html_text(F.col("h")), h=page) == "One & two\n\nthree bold\nx\n\na\n\nb\n"
    assert one(spark, text.html_text(F.col("h")), h="<style>p{}</style>") == ""


def test_normalize_key(spark):
    for raw, want in (("  Straße  X ", "strasse x"), ("ﬁne Ⅳ", "fine iv"), ("Plain\t TEXT\x1f2 ", "plain text 2"), ("TYPE 1", "type 1")):
        assert one(spark, text.normalize_key(F.col("t")), t=raw) == want


def test_small_functions(spark):
    assert one(spark, text.title_case(F.col("t")), t="o'neil-smith of BAR") == "O'Neil-Smith Of Bar"
    assert one(spark, web.namespace(F.col("t")), t="Orphanet:12") == "ORPHA:12"
    assert one(spark, web.namespace(F.col("t")), t="plain") == "plain"
    assert one(spark, web.curie(F.col("t")), t="http://purl.obolibrary.org/obo/HP_0001") == "HP:0001"
    assert one(spark, web.domain(F.col("t")), t="https://WWW.Example.org:8080/a/b") == "example.org:8080"
    assert one(spark, web.canonical_target(F.col("t"), ("key",)), t="https://x/y?b=2&key=s&a=1#f") == "https://x/y?a=1&b=2"
    assert one(spark, text.missing_to_null(F.col("t")), t=" NA ") is None
    assert one(spark, text.score_text(F.col("t").cast("double")), t="0.5") == "0.50"
    assert one(spark, quality.count_in_window(F.col("t"), F.lit(12)), t="of 12 patients, 112") is True
    assert one(spark, quality.count_in_window(F.col("t"), F.lit(12)), t="112 and 120") is False
    assert one(spark, identity.canonical_json(b=F.col("t"), a=F.lit(None).cast("string")), t="é\"") == '{"a":null,"b":"é\\""}'


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "\nab\ncd\n\n\nx🧬\n")], "id int, t string")
    assert rows(paragraph_sections(df, "id", "t")) == [(1, "paragraph 1", 1, 6), (1, "paragraph 2", 9, 11)]


def test_symbols_stand_alone(spark):
    docs = spark.createDataFrame([(1, "GENEAB GENEA, xGENEA"), (2, "HLA-B27 (p53)"), (3, "a é-1 ÉGENEA"), (4, "+"), (5, "C++ x"), (6, "GENEA")], "id int, t string")
    symbols = [("GENEA",), ("HLA-B27",), ("p53",), ("é-1",), ("+",), ("B27",), ("C++",), ("xyz",)]
    got = rows(text_joins.symbol_mentions(docs, spark.createDataFrame(symbols, "symbol string"), "id", "t"))
    want = []
    for i, t in [(r.id, r.t) for r in docs.collect()]:
        for (s,) in symbols:
            m = re.search(rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])", t)
            if m:
                want.append((i, s, m.start(), m.end()))
    assert got == sorted(want) and (1, "GENEA", 7, 12) in got


def test_quotes_match_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["ab", "abc", "b", "ca", "🧬x", "é", "abcab"]
    texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) + rng.choice(["", "\n", "  z"]) for _ in range(40)]
    quotes = ["ab", "b", "a", "abc b", "b ca", "ab ab ab", "a b c", "é abc", "🧬", "c ab abcab b", "b ca ab abc b ab"] + [t[2:30] for t in texts[:15]] + [t[:7] for t in texts[15:25]]
    quotes = sorted({q for q in quotes if q})
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    qs = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    got = rows(text_joins.locate_quotes(docs, qs, "id", "t"), "id", "quote_id", "occurrences", "start", "stop")
    want = []
    for i, t in enumerate(texts):
        for j, q in enumerate(quotes):
            n = len(re.findall(re.escape(q), t))
            if n:
                at = t.find(q) if n == 1 else None
                want.append((i, j, n, at, None if at is None else at + len(q)))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_ambiguous_alias_is_never_resolved(spark):
    aliases = spark.createDataFrame([
        ("g1", "gene", "Alpha", "label"), ("g2", "gene", "ALPHA ", "exact_synonym"), ("g3", "gene", "Beta", "label"), ("g4", "gene", "beta", "related_synonym"),
        ("g5", "gene", "Gamma", "label"), ("g6", "gene", "old", "broad_synonym")], "entity string, type string, alias string, alias_type string")
    ids = spark.createDataFrame([("g5", "g5"), ("alt5", "g5")], "id string, primary string")
    mentions = spark.createDataFrame([("alpha",), ("Beta",), ("GAMMA",), ("alt5",), ("ALT5",), ("old",), ("none",)], "mention string")
    got = {r.mention: (r.resolved_id, r.candidates, r.ambiguous, r.via) for r in joins.alias_lookup(mentions, ids, joins.alias_index(aliases)).collect()}
    assert got == {
        "alpha": (None, 2, True, "identity_alias"), "Beta": (None, 2, True, "identity_alias"), "GAMMA": ("g5", 1, False, "identity_alias"),
        "alt5": ("g5", 1, False, "identifier"), "ALT5": (None, 0, False, "none"), "old": (None, 1, False, "candidate_alias"), "none": (None, 0, False, "none")}


def test_obsolete_resolves_through_single_replacement_only(spark):
    terms = spark.createDataFrame([("a", False, []), ("b", True, ["a"]), ("c", True, ["a", "b"]), ("d", True, ["b"]), ("e", True, [])], "term string, is_obsolete boolean, replaced_by array<string>")
    alts = spark.createDataFrame([("alt", "b")], "alt_id string, term string")
    ids = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "alt", "zz")], "id string")
    assert dict(map(tuple, joins.resolve_ids(ids, terms, alts).collect())) == {"a": "a", "b": "a", "c": None, "d": None, "e": None, "alt": "a", "zz": None}
