"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one gives two disjoint chunks, its halves, and the other its grams of the same lengths by position. One
inserted, deleted or replaced code point leaves one half whole: the half before the edit stays where it is, the half
behind it moves by the difference of the lengths, at most one. So only grams at those places, named by length, half and
shift, meet the chunks in an equi-join, and every meeting is verified on the whole words.

A crowded chunk is not compared pair by pair. What it leaves open, the other half, is again one edit away from its
partner, so the chunk is joined by a chunk of that half, and so on until no group is crowded or nothing is left to cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 7, 2
FAR = 10  # a form is at least so many times as frequent
CROWDED = 4096  # pairs that one chunk may propose before it is cut further
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)  # greedy and from the left: whole runs only


def words_of(text: str, prefix: int, blur: bool) -> Counter[str]:
    """How often each word of at least seven code points occurs in a text; ``prefix`` is the checksum of what precedes a run."""
    found = Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode()))  # bytes lower A-Z only
    if not blur:
        return found
    out: Counter[str] = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", blur: bool = False, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times in all texts; each batch is counted before the shuffle."""
    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                total.update(words_of(value.as_py() or "", zlib.crc32(f"{name.as_py() or ''}:".encode()), blur))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _piece(start: Column, end: Column) -> Column:
    """Code points [start, end) of ``word``."""
    return F.col("word").substr(start + 1, end - start)


def _cut(rows: DataFrame, shift: Column, path: Column) -> DataFrame:
    """Two rows for each: the open part [lo, hi) of the chunk side cut in halves, one half joined to the key, the other left open.

    ``shift``: how far the half behind the edit has moved on this side; ``path``: what the key starts with.
    """
    mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    behind = F.col("hi") + shift
    before_edit = F.struct(F.concat_ws(":", path, F.lit("a"), _piece(F.col("lo"), mid)).alias("key"), mid.alias("lo"), F.col("hi").alias("hi"))
    after_edit = F.struct(F.concat_ws(":", path, F.lit("b"), _piece(mid + shift, behind)).alias("key"), F.col("lo").alias("lo"), mid.alias("hi"))
    cut = rows.select("word", "d", F.explode(F.array(before_edit, after_edit)).alias("c"))
    return cut.select("word", "d", "c.key", "c.lo", "c.hi")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): all pairs of different words of (word) that one inserted, deleted or replaced code point tells apart.

    Words of one code point or none are compared like any other. The pairs come once each, the shorter word (of equal
    lengths the smaller one) as ``a``. ``crowded`` bounds the pairs of a chunk and does not change the result.
    """
    size = F.char_length("word")
    shift = F.explode(F.array(F.lit(0), F.lit(1)))
    start = words.select("word", size.alias("n")).select("word", "n", shift.alias("d"))
    chunks = start.select("word", "d", F.lit(0).alias("lo"), F.col("n").alias("hi"), F.concat_ws(":", "n", "d").alias("key"))
    grams = start.filter("n >= d").select("word", "d", F.lit(0).alias("lo"), (F.col("n") - F.col("d")).alias("hi"), F.concat_ws(":", F.col("n") - F.col("d"), "d").alias("key"))
    found = []
    while True:
        chunks = cut_lineage(_cut(chunks, F.lit(0), F.col("key")), "chunks")
        grams = cut_lineage(_cut(grams, F.col("d"), F.col("key")), "grams")
        both = chunks.select("key", "d", F.lit(1).alias("c"), (F.col("hi") - F.col("lo")).alias("left")).unionByName(grams.select("key", "d", F.lit(0).alias("c"), (F.col("hi") - F.col("lo")).alias("left")))
        groups = both.groupBy("key", "d").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.max("left").alias("left"))
        full = cut_lineage(groups.filter((F.col("c") * (F.col("n") - F.col("c")) > crowded) & (F.col("left") > 1)).select("key"), "crowded")
        pairs = _verified(chunks.join(full, "key", "left_anti"), grams.join(full, "key", "left_anti"))
        found.append(pairs)
        if full.isEmpty():
            break
        found[-1] = cut_lineage(pairs, "pairs")
        chunks, grams = chunks.join(full, "key", "left_semi"), grams.join(full, "key", "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _verified(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    met = chunks.select("key", F.col("word").alias("a")).join(grams.select("key", F.col("word").alias("b")), "key")
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    return met.filter(ordered & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def forms(counts: DataFrame, crowded: int = CROWDED, far: int = FAR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n): ``n_near`` near words, the most frequent of them as ``form`` if it
    is at least ``far`` times as frequent (ties: the smallest), and the last form of the chain as ``root``."""
    counts = cut_lineage(counts.select("word", "n"), "words")
    pairs = cut_lineage(near_pairs(counts.select("word"), crowded), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = sides.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    judged = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= far * F.col("n"), F.col("best.other")).alias("form"), F.when(-F.col("best.less") >= far * F.col("n"), -F.col("best.less")).alias("form_n"))
    judged = cut_lineage(judged, "forms")
    # follow forms by doubling: counts grow tenfold with every step, so few rounds are needed
    to = cut_lineage(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = to.alias("x").join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = cut_lineage(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return judged.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", blur: bool = False, crowded: int = CROWDED) -> DataFrame:
    """The spelling variants among the words of whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, of at least seven code points and at least two
    occurrences. A null text has no words, a null key counts as an empty one, repeated rows count again, an empty table
    gives no rows, and other columns are ignored. ``blur`` deletes one code point of one run in 31, chosen by key and run.
    """
    return forms(word_counts(docs, text, key, blur), crowded)
