"""Queries that apply each operator to its whole table, with the digest columns derived from its real output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import ann, bpe, pii, quality, repeats, rules, runs, secrets, simhash, sites, spellings, tiling, warc
from claimweave.llm.common import read
from claimweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, words=secrets.corpus_words(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess", "max_log10_guesses")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", bpe.packed_length().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_personal(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sites.main_texts(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.save_archives(read(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return warc.read_archives(archives)


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; what it rejects is not among the rows."""
    judged = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.filter("keep").select("doc_id", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"), "perplexity", "threshold")


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "score")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.repeated_runs(read(spark, sf_dir, "documents"), fold=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_groups(read(spark, sf_dir, "documents"), blur=True)


SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, h, array_to_string([
  list_extract(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'], instr('0123456789abcdef', c)) FOR c IN string_split(sha1(h), '')], '') AS bits FROM p),
b AS (SELECT page_id, n, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(list_position([lpad(bin(v), 5, '0') FOR v IN range(32)], substr(bits, CAST(5 * i + 1 AS INT), 5)) AS INT), 1) FOR i IN range(32)], '') AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN last = page_id OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id OR page_id IS NULL THEN last END AS refers_to FROM b
"""
