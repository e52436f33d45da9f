import gzip
import json

import pytest

from claimweave.sources import annotations, captures, lines, literature, ontology, records, registries
from tests.conftest import rows

OBO = r'''format-version: 1.2
data-version: hp/releases/2026-05-05
! remark

[Term]
id: HP:9000001
name: Root

[Term]
id: HP:9000014
name: Both \"sided\"
alt_id: HP:9000099
synonym: "A \"b\"" EXACT [x:1]
synonym: "wide" BROAD []
synonym: "thin" NARROW []
synonym: "near" RELATED []
synonym: "odd" OTHER []
is_a: HP:9000002 ! Two
is_a: HP:9000003 {source="q"} ! Three
xref: UMLS:C1 {source="m"}
subset: slim x

is_obsolete: true
replaced_by: HP:9000001 ! Root

[Typedef]
id: part_of
name: ignored

[Term]
id: HP:9000003
'''


def test_obo(spark, folder):
    (folder / "a.obo").write_text(OBO)
    terms, release = ontology.read_obo(spark, str(folder / "a.obo"))
    got = {r.id: r for r in terms.collect()}
    assert set(got) == {"HP:9000001", "HP:9000014", "HP:9000003"} and release.first()[0] == "hp/releases/2026-05-05"
    t = got["HP:9000014"]
    assert [tuple(s) for s in t.synonyms] == [('A "b"', "EXACT"), ("wide", "BROAD"), ("thin", "NARROW"), ("near", "RELATED")]
    assert t.is_a == ["HP:9000002", "HP:9000003"] and t.alt_ids == ["HP:9000099"] and t.replaced_by == ["HP:9000001"]
    assert t.is_obsolete and [tuple(x) for x in t.xrefs] == [("UMLS:C1", '{source="m"}')] and t.subsets == ["slim"]
    assert got["HP:9000003"].name is None and rows(ontology.synonyms_of(terms.filter("id = 'HP:9000014'")), "text")[0] == ('A "b"',)
    assert captures.pinned(terms, release, "2026-05-05").count() == 3
    with pytest.raises(Exception, match="release does not contain"):
        captures.pinned(terms, release, "2025").collect()


def test_line_numbers_over_many_splits(spark, folder):
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 1)):
        (folder / name).write_text("\n".join(f"{name} {i}" if i % 7 else "" for i in range(1, n + 1)) + "\n")
    with gzip.open(folder / "d.txt.gz", "wt") as f:
        f.write("x\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.read_lines(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5006
    assert all(r.value in ("", "x", "y") or r.value.split()[1] == str(r.line_no) for r in got)
    assert {r.line_no for r in got if r.file.endswith("a.txt")} == set(range(1, 5001))


HPOA = """#description: demo
#version: 2026-06-06
database_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration
MIM:1\tOne\t\tHP:1\tPMID:1\tPCS\t\t1/2\t\t\tP\tme

Orphanet:2\tTwo\tNOT\tHP:1\tPMID:2\tTAS\t\t\t\t\tI\tme
"""


def test_annotations(spark, folder):
    (folder / "a.hpoa").write_text(HPOA)
    got, meta = annotations.read_annotations(spark, str(folder / "a.hpoa"))
    assert rows(got, "line_no", "database_id", "original_database_id", "qualifier", "aspect") == [(4, "OMIM:1", "MIM:1", "", "P"), (6, "ORPHA:2", "Orphanet:2", "NOT", "I")]
    assert dict(rows(meta, "key", "value")) == {"description": "demo", "version": "2026-06-06"}
    (folder / "b.hpoa").write_text(HPOA + "short\trow\n")
    with pytest.raises(Exception, match="line 7: expected 12 columns, got 2"):
        annotations.read_annotations(spark, str(folder / "b.hpoa"))[0].collect()
    (folder / "c.hpoa").write_text(HPOA.replace("aspect", "facet"))
    with pytest.raises(Exception, match="header lacks columns aspect"):
        annotations.read_annotations(spark, str(folder / "c.hpoa"))[0].collect()


def test_mappings_submissions_gaf(spark, folder):
    (folder / "m.tsv").write_text("#mapping_set_id: x\n#curie_map:\nsubject_id\tpredicate_id\tobject_id\nMONDO:1\tskos:exactMatch\tOrphanet:5\nMONDO:1\tskos:closeMatch\tMIM:6\nMONDO:2\tother\tUMLS:7\n")
    got, meta = annotations.read_mappings(spark, str(folder / "m.tsv"))
    assert rows(got, "line_no", "relation", "object_id", "original_object_id") == [(4, "exact", "ORPHA:5", "Orphanet:5"), (5, "related", "OMIM:6", "MIM:6"), (6, None, "UMLS:7", "UMLS:7")]
    assert rows(meta, "key") == [("mapping_set_id",)]
    (folder / "s.csv").write_text('sgc_id,gene_symbol,disease_title,classification_title\n1,A,"x, ""y""\nz",Limited\n2,B,q,Definitive\n3,A,r,Definitive\n')
    symbols = spark.createDataFrame([("A",)], "symbol string")
    assert rows(annotations.read_submissions(spark, str(folder / "s.csv"), symbols), "row", "disease_title") == [(1, 'x, "y"\nz'), (3, "r")]
    cells = lambda sym, q, aspect: "\t".join(["U", "1", sym, q, "GO:1", "PMID:1", "IDA", "", aspect, "", "", "protein", "9606", "2026", "Org", "", ""])
    with gzip.open(folder / "g.gaf.gz", "wt") as f:
        f.write("!gaf-version: 2.2\n" + cells("A", "NOT|involved_in", "P") + "\n" + cells("A", "x", "F") + "\nshort\n" + cells("B", "x", "P") + "\n")
    assert rows(annotations.read_gaf(spark, str(folder / "g.gaf.gz"), symbols), "line_no", "symbol", "qualifier", "assigned_by") == [(2, "A", "NOT|involved_in", "Org")]


def test_articles(spark, folder):
    (folder / "p.xml").write_text('''<?xml version="1.0" encoding="UTF-8"?>
<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">9000001</PMID><Article><Journal><JournalIssue><PubDate><Year>2025</Year></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>A <i>bold</i> title &amp; more</ArticleTitle><Abstract><AbstractText Label="BACKGROUND">First 🧬 part.</AbstractText><AbstractText>Second <sub>x</sub> part.</AbstractText></Abstract></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>9000002</PMID><Article><ArticleTitle>Only</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>''', encoding="utf-8")
    got = {r.pmid: r for r in literature.read_articles(spark, str(folder / "p.xml")).collect()}
    a = got["9000001"]
    assert a.title == "A bold title & more" and a.doi == "10.1/x" and a.year == "2025" and a.journal == "J"
    assert a.canonical_text == "A bold title & more\n\nFirst 🧬 part.\n\nSecond x part."
    assert [(s.label, a.canonical_text[s.start:s.stop]) for s in a.sections] == [("title", a.title), ("BACKGROUND", "First 🧬 part."), ("abstract part 2", "Second x part.")]
    assert got["9000002"].canonical_text == "Only" and got["9000002"].doi is None
    asked = spark.createDataFrame([("9000001",), ("9000003",)], "pmid string")
    assert rows(literature.not_returned(asked, literature.read_articles(spark, str(folder / "p.xml")))) == [("9000003",)]


def test_gene_disorders(spark, folder):
    (folder / "o.xml").write_text('''<?xml version="1.0"?><JDBOR date="2026-01-02" version="1"><DisorderList count="1"><Disorder id="1"><OrphaCode>77</OrphaCode><Name lang="en">Dis &amp; x</Name><DisorderGeneAssociationList count="2">
<DisorderGeneAssociation><SourceOfValidation>1[PMID]</SourceOfValidation><Gene id="1"><Symbol>A</Symbol><ExternalReferenceList count="2"><ExternalReference id="1"><Source>Ensembl</Source><Reference>E</Reference></ExternalReference><ExternalReference id="2"><Source>HGNC</Source><Reference>12</Reference></ExternalReference></ExternalReferenceList></Gene><DisorderGeneAssociationType id="1"><Name lang="en">T1</Name></DisorderGeneAssociationType><DisorderGeneAssociationStatus id="1"><Name lang="en">Assessed</Name></DisorderGeneAssociationStatus></DisorderGeneAssociation>
<DisorderGeneAssociation><Gene id="2"><Symbol>B</Symbol></Gene></DisorderGeneAssociation></DisorderGeneAssociationList></Disorder></DisorderList></JDBOR>''')
    path = str(folder / "o.xml")
    assert rows(literature.read_gene_disorders(spark, path), "orpha_code", "disorder_name", "gene_symbol", "gene_hgnc", "association_status") == [
        ("77", "Dis & x", "A", "HGNC:12", "Assessed"), ("77", "Dis & x", "B", None, "")]
    assert rows(literature.gene_disorder_release(spark, path)) == [("2026-01-02",)]


def test_preprint_pin_and_text_versions(spark, folder):
    doc = {"collection": [{"doi": "d", "version": v, "title": " T ", "abstract": "A", "published": p, "license": "", "server": "NA"} for v, p in (("9", "NA"), ("10", "10.1/j"))]}
    (folder / "m.json").write_text(json.dumps(doc))
    pins = spark.createDataFrame([("d", "9"), ("d", "11")], "doi string, version string")
    docs, cover = literature.read_preprints(spark, str(folder / "m.json"), pins)
    r = docs.collect()
    assert len(r) == 1 and r[0].published_doi is None and r[0].original_published == "NA" and r[0].server == "medrxiv" and r[0].canonical_text == "T\n\nA"
    assert dict(rows(cover, "version", "completion")) == {"9": "complete_for_query", "11": "partial"}


def test_trials_and_genes(spark, folder):
    study = lambda n, c: {"protocolSection": {"identificationModule": {"nctId": n, "briefTitle": "T"}, "conditionsModule": {"conditions": c, "keywords": ["G"]}}}
    (folder / "t.json").write_text(json.dumps({"studies": [study("N1", ["a", "b"]), study("N1", ["z"]), study("N2", [])]}))
    trials = registries.read_trials(spark, str(folder / "t.json"))
    assert rows(registries.trial_conditions(trials, spark.createDataFrame([("a", "D1")], "condition string, disease string"))) == [("N1", "a", "D1")]
    (folder / "bad.json").write_text(json.dumps({"studies": [study(None, [])]}))
    with pytest.raises(Exception, match="lacks an id"):
        registries.read_trials(spark, str(folder / "bad.json")).collect()
    docs = [{"hgnc_id": "H1", "symbol": "A", "name": "n", "alias_symbol": ["A1"], "prev_symbol": ["A0"]}, {"hgnc_id": "H2", "symbol": "B"}, {"hgnc_id": "H3", "symbol": "B"}]
    (folder / "g.json").write_text(json.dumps({"response": {"docs": docs}}))
    genes, aliases, cover = registries.read_genes(spark, str(folder / "g.json"), spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"))
    assert rows(genes, "hgnc_id") == [("H1",)] and dict(rows(cover, "symbol", "found")) == {"A": 1, "B": 2, "C": 0}
    assert rows(aliases, "alias", "alias_type") == [("A", "symbol"), ("A0", "previous_symbol"), ("A1", "alias_symbol"), ("n", "exact_synonym")]


def test_strict_records(spark, folder):
    (folder / "r.jsonl").write_text('{"id":"a","n":1,"tags":["x"]}\n\n{"id":"b","n":"1","tags":[]}\n{"id":"c","n":2,"tags":null,"more":1}\n{"id":3,"n":2,"tags":[]}\nnot json\n{"id":"d","tags":[]}\n')
    ok, bad = records.read_strict(spark, str(folder / "r.jsonl"), "id string, n bigint, tags array<string>")
    assert rows(ok, "line_no", "id", "n") == [(1, "a", 1)]
    got = {(r.line_no, r.problem) for r in bad.collect()}
    assert got >= {(3, "wrong type of n"), (4, "unknown keys: more"), (5, "wrong type of id"), (6, "not a JSON object"), (7, "absent keys: n")}
    assert {n for n, _ in got} == {3, 4, 5, 6, 7}
