"""Content addressing: canonical JSON, hashes and identifiers derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are written, non-ASCII text stays readable."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def finite(value: Column) -> Column:
    """Fails on NaN and infinities, and turns a negative zero into zero."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("number is not finite"))).otherwise(value + F.lit(0.0))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(**fields: Column) -> Column:
    return sha256(canonical_json(**fields))


def stable_id(prefix: str, **fields: Column) -> Column:
    """``prefix:`` and the first 32 hex digits of the content hash."""
    return F.concat(F.lit(prefix + ":"), F.substring(content_hash(**fields), 1, 32))


def multiset_hash(row_hash: Column) -> list[Column]:
    """Order-free combination of row hashes in constant memory.

    Each 256-bit hash is cut into pieces of 60 bits that are summed exactly, so partial sums combine map-side and a
    table of any size never gathers its hashes in one place. The halves of a piece are summed as plain integers, which
    keeps partial sums short (2^33 rows are safe, beyond them the sum fails). Apply inside ``agg`` and hash with
    ``multiset_digest``.
    """
    pieces = []
    for i in range(4):
        piece = F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("bigint")
        high, low = F.sum(F.shiftright(piece, 30)), F.sum(piece.bitwiseAND(F.lit((1 << 30) - 1)))
        pieces.append((high.cast("decimal(27,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("string").alias(f"h{i}"))
    return [F.count(F.lit(1)).cast("string").alias("rows"), *pieces]


def multiset_digest() -> Column:
    return sha256(F.concat_ws("|", "rows", "h0", "h1", "h2", "h3"))
