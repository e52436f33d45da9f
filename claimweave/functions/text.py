"""Text expressions. All run inside the JVM except Unicode folding and markup parsing."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimweave.functions.vocab import BLOCK_TAGS, DROPPED_TAGS, MISSING_WORDS

WORD = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"


def fold(value: str | None) -> str | None:
    """Compatibility form, case folded, white space collapsed."""
    if value is None:
        return None
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).casefold()).strip()


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(fold)


def normalize_key(text: Column) -> Column:
    """Compatibility-normalized, case-folded text with single spaces. Only text outside ASCII crosses to Python."""
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.when(ascii_only, plain).otherwise(_fold(F.when(~ascii_only, text)))


def words_only(text: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def missing_to_null(text: Column) -> Column:
    return F.when(F.trim(text).isin(*MISSING_WORDS), F.lit(None)).otherwise(text)


def line_at(text: Column, number: Column) -> Column:
    """The 1-based line, or an empty string beyond the text."""
    lines = F.split(text, "\n", -1)
    return F.when((number > 0) & (number <= F.size(lines)), F.get(lines, number - 1)).otherwise(F.lit(""))


def whole_number_in(text: Column, number: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), number.cast("string"), F.lit(r"(?!\d)")))


def title_case(text: Column) -> Column:
    """Every run of letters capitalized, also after punctuation."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def score_text(score: Column) -> Column:
    return F.coalesce(F.round(score, 2).cast("decimal(20,2)").cast("string"), F.lit("unavailable"))


def joined_or(parts: list[Column], fallback: str, sep: str = "; ") -> Column:
    """Non-null parts joined, or a fallback sentence."""
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep)).otherwise(F.lit(fallback))


# A tag becomes a mark: dropped content opens and closes, a block breaks the line, anything else leaves no trace.
OPENS, CLOSES = "\x02", "\x03"
INNERMOST = re.compile(f"{OPENS}[^{OPENS}{CLOSES}]*{CLOSES}")
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|(?P<raw><(?P<name>script|style)\b[^>]*>.*?(?:</(?P=name)\s*>|\Z))|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)[^>]*>",
    re.DOTALL | re.IGNORECASE,
)


def _mark(found: re.Match) -> str:
    tag = (found["tag"] or "").lower()
    if tag in DROPPED_TAGS:
        return CLOSES if found["end"] else OPENS
    return "\n" if tag in BLOCK_TAGS else ""


def page_text(markup: str | None) -> str | None:
    """Lines of visible text, at most one empty line between two, or nothing at all."""
    if markup is None:
        return None
    marked = MARKUP.sub(_mark, re.sub("\r\n?", "\n", markup).replace(OPENS, "").replace(CLOSES, ""))
    while (shorter := INNERMOST.sub("", marked)) != marked:  # one nesting level at a time
        marked = shorter
    visible = marked.partition(OPENS)[0].replace(CLOSES, "")
    lines: list[str] = []
    for line in html.unescape(html.unescape(visible)).replace("\u00a0", " ").split("\n"):
        line = re.sub(r"[ \t\f\v]+", " ", line).strip()
        if line or (lines and lines[-1]):
            lines.append(line)
    text = "\n".join(lines).rstrip("\n")
    return f"{text}\n" if text else ""


@F.pandas_udf(StringType())
def html_text(markup: pd.Series) -> pd.Series:
    """Arrow batches of whole pages to text."""
    return markup.map(page_text)
