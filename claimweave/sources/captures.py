"""Captured pages and pinned reference releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import html_text, line_endings
from claimweave.operators.sections import paragraph_sections


def page_texts(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """(page_id, canonical_text). An empty page fails the job."""
    text = line_endings(F.col("html")) if markdown else html_text(F.col("html"))
    rows = pages.select("page_id", text.alias("canonical_text"))
    return rows.withColumn("canonical_text", F.when(F.trim("canonical_text") == "", F.raise_error(
        F.format_string("page %d has no text", "page_id"))).otherwise(F.col("canonical_text")))

def web_page_sections(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """(page_id, label, start, stop) of the paragraphs of every page text."""
    return paragraph_sections(page_texts(pages, markdown), "page_id", "canonical_text")


def web_pages(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """(page_id, canonical_text, sections): page text with its number of paragraphs."""
    filled = page_texts(pages, markdown)
    counts = paragraph_sections(filled, "page_id", "canonical_text").groupBy("page_id").agg(F.count("*").alias("sections"))
    return filled.join(counts, "page_id")


def pinned(rows: DataFrame, release: DataFrame, pin: str) -> DataFrame:
    """The rows, unless the stated release does not contain the pinned one: then reading them fails."""
    stated = F.coalesce(release.agg(F.max("release")).scalar(), F.lit("unstated"))
    ok = F.when(F.contains(stated, F.lit(pin)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"release does not contain {pin}: "), stated)).cast("boolean"))
    return rows.filter(ok)
