"""One large file read by many tasks gives the rows of a serial reader."""

import csv
import io
import json
import random

import pytest

from claimweave.sources import annotations, ontology, split
from tests.conftest import rows


@pytest.fixture()
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd(rng):
    return "".join(rng.choice(["a", "b", '"', "\n", ",", " ", "{", "}", "[", "]", "\\", "é", '"\n"', "\n\n"]) for _ in range(rng.randrange(30)))


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_quoted_records(spark, folder, small_splits, seed, end):
    rng = random.Random(seed)
    table = [[odd(rng), str(i), odd(rng)] for i in range(300)]
    if seed == 3:
        table[40][0] = "x\n" * 900  # over several splits
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL).writerows([["p", "q", "r"], *table])
    text = out.getvalue()
    (folder / "t.csv").write_bytes(text.replace(f"{end}", f"{end}", 1).encode())
    df = split.quoted_records(spark, str(folder / "t.csv"))
    assert spark.read.text(str(folder / "t.csv")).rdd.getNumPartitions() > 10
    got = {r["record"]: r["value"] for r in df.collect()}
    want = [next(csv.reader([v], strict=True)) if "\n" not in v else next(csv.reader(io.StringIO(v, newline=""))) for _, v in sorted(got.items())]
    assert sorted(got) == list(range(1, 302)) and want == [["p", "q", "r"], *table]


def test_blank_lines_are_no_records(spark, folder, small_splits):
    (folder / "t.csv").write_text('a,b\n\n1,"x\n\ny"\n   \n2,z\n\n')
    assert rows(split.quoted_records(spark, str(folder / "t.csv")), "record", "value") == [(1, "a,b"), (2, '1,"x\n\ny"'), (3, "2,z")]
    (folder / "empty.csv").write_text("")
    assert split.quoted_records(spark, str(folder / "empty.csv")).count() == 0


def test_submissions_equal_the_serial_reader(spark, folder, small_splits):
    rng = random.Random(4)
    head = ["sgc_id", "gene_symbol", "disease_title", "classification_title"]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([head, *[[f"s{i}", rng.choice(["A", "B"]), f"t {odd(rng)}x", "Strong"] for i in range(200)]])
    (folder / "s.csv").write_text(out.getvalue())
    serial = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(folder / "s.csv"))
    got = annotations.read_submissions(spark, str(folder / "s.csv"))
    assert rows(got, "sgc_id", "gene_symbol", "disease_title") == rows(serial, "sgc_id", "gene_symbol", "disease_title")
    assert [r[0] for r in rows(got, "row")] == list(range(1, 201))


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_json_elements(spark, folder, small_splits, seed, indent):
    rng = random.Random(seed)
    nodes = [{"id": i, "t": odd(rng), "m": {"l": [odd(rng), {"k": odd(rng)}]}} for i in range(150)]
    if seed == 3:
        nodes[70]["t"] = '{"\\' * 900  # an element over several splits
    doc = {"graphs": [{"meta": {"version": odd(rng), "x": [{"y": 1}, {"y": [{"z": 2}]}]}, "nodes": nodes, "edges": [{"sub": odd(rng), "obj": str(i)} for i in range(100)], "none": []}]}
    (folder / "g.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=seed == 1) + "\n")
    elements, rest = split.json_elements(spark, str(folder / "g.json"), 4)
    got = [(r["array"], json.loads(r["value"])) for r in elements.collect()]
    assert sorted((v["id"] for a, v in got if a == "nodes")) == list(range(150)) and {a for a, _ in got} == {"nodes", "edges"}
    assert {v["id"]: v for a, v in got if a == "nodes"} == {v["id"]: v for v in nodes}
    assert sorted((v["obj"], v["sub"]) for a, v in got if a == "edges") == sorted((v["obj"], v["sub"]) for v in doc["graphs"][0]["edges"])
    [left] = rest.collect()
    assert json.loads(left["value"]) == {"graphs": [{**doc["graphs"][0], "nodes": [], "edges": []}]}


def test_graph_files_of_one_and_of_many_splits(spark, folder, small_splits):
    def node(i):
        return {"id": f"http://purl.obolibrary.org/obo/HP_{i}", "lbl": f"n {{{i}}}", "type": "CLASS", "meta": {"synonyms": [{"pred": "hasExactSynonym", "val": f's"{i}'}]}}

    doc = {"graphs": [{"nodes": [node(i) for i in range(80)], "edges": [{"sub": node(i)["id"], "pred": "is_a", "obj": node(i // 2)["id"]} for i in range(1, 80)],
                       "meta": {"version": "http://x/hp/releases/2026-02-02/hp.json"}}]}
    (folder / "g.json").write_text(json.dumps(doc))
    terms, edges, release = ontology.read_obographs(spark, str(folder / "g.json"))
    assert rows(terms, "id", "name") == sorted((f"HP:{i}", f"n {{{i}}}") for i in range(80))
    assert rows(edges) == sorted((f"HP:{i}", f"HP:{i // 2}") for i in range(1, 80))
    assert rows(release) == [("hp/releases/2026-02-02",)]
    assert rows(terms.selectExpr("id", "synonyms[0].text"))[0] == ("HP:0", 's"0')
