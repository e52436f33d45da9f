"""The query with an SQL twin, and the shape that every query promises."""

import duckdb
import pytest

from claimweave.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SHAPES = {
    "op1_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op4_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", SHAPES)
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    table = "pages" if "page_id" in df.columns else "documents"
    assert df.columns[: len(SHAPES[name])] == SHAPES[name]
    assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet' UNION ALL SELECT page_id + 500, url, html FROM '{FOLDER}/pages.parquet' WHERE page_id < 7")
    assert con.execute(f"SELECT count(*), count(*) FILTER (record_type = 'revisit') FROM ({SQL['op4_warc']})").fetchone()[1] == 7
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    res = con.execute(SQL["op4_warc"])
    got = QUERIES["op4_warc"](spark, FOLDER).select(*[d[0] for d in res.description])
    assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
