"""Records of one large quoted file, read by many tasks.

A record of a CSV file may hold line breaks inside quotes, and the elements of a JSON array may lie on one line, so neither
can be told from a piece of the file alone. Every split of the file is therefore summed up for each state it may start in
(inside or outside quotes); the sums of one row per split are added up along the file, and then every piece knows its state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, split, at, value): the pieces of the files between ``end`` marks, numbered within their split."""
    raw = spark.read.option("lineSep", end).text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return rows.select("file", "split", "at", "value")


def _before() -> Window:
    return Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


LINE_FIELDS = "file string, split bigint, at bigint, value string, odd int, inside int, n0 bigint, n1 bigint"


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running states of the lines of each split: quotes before a line (odd or even) and records begun, for both states."""
    last, inside, n0, n1 = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(3)
        odd = (pc.count_substring(value, '"').to_numpy(zero_copy_only=False) & 1).astype(np.int32)
        filled = pc.not_equal(pc.utf8_trim_whitespace(value), "").to_numpy(zero_copy_only=False)
        names = pa.array([f"{f}\n{s}" for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]).dictionary_encode()
        which = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), batch.num_rows]
        columns = [np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name = names.dictionary[int(which[a])].as_py()
            if name != last:
                last, inside, n0, n1 = name, 0, 0, 0
            total = np.cumsum(odd[a:b]) + inside
            columns[0][a:b] = (total - odd[a:b]) & 1
            columns[1][a:b] = n0 + np.cumsum(filled[a:b] & (columns[0][a:b] == 0))
            columns[2][a:b] = n1 + np.cumsum(filled[a:b] & (columns[0][a:b] == 1))
            inside, n0, n1 = int(total[-1] & 1), int(columns[1][b - 1]), int(columns[2][b - 1])
        arrays = [*batch.columns, pa.array(odd), *(pa.array(c) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in LINE_FIELDS.split(", ")])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): the records of CSV files, numbered from 1 within the file, line breaks inside quotes kept.

    Blank lines between records are no records. A record on one line stays where it was read; only the lines of longer
    ones are brought together. A quote that is never closed makes one record of the rest of its file, as in a serial
    reader. Quotes inside quotes are doubled.
    """
    lines = _pieces(spark, path, "\n").mapInArrow(_count_lines, LINE_FIELDS)
    splits = lines.groupBy("file", "split").agg(F.bit_xor("odd").alias("odd"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    states = splits.withColumn("start", F.pmod(F.coalesce(F.sum("odd").over(_before()), F.lit(0)), F.lit(2)))
    begun = F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    states = states.select("file", "split", "start", F.coalesce(F.sum(begun).over(_before()), F.lit(0)).alias("begun"))
    rows = lines.join(states, ["file", "split"])
    record = F.col("begun") + F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    rows = rows.select("file", record.alias("record"), "split", "at", "value", F.pmod(F.col("inside") + F.col("start"), F.lit(2)).alias("open"), "odd")
    plain = rows.filter((F.col("open") == 0) & (F.col("odd") == 0) & (F.trim("value") != "") & (F.trim(F.regexp_replace("value", r"\r$", "")) != ""))
    broken = rows.filter((F.col("open") == 1) | (F.col("odd") == 1)).groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    both = plain.select("file", "record", "value").unionByName(broken)
    return both.withColumn("value", F.regexp_replace("value", r"\r$", ""))


TOKENS = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.S)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)


def brackets(text: str, inside: bool) -> tuple[list[tuple[int, str, str | None]], bool]:
    """(place, bracket, string before it) of the brackets outside strings, and whether the text ends inside a string."""
    out, begin, string = [], 0, None
    if inside:
        rest = STRING_END.match(text)
        if not rest[1]:
            return out, True
        begin = rest.end()
    for token in TOKENS.finditer(text, begin):
        if text[token.start()] != '"':
            out.append((token.start(), token[0], string))
            string = None
        elif token[1] and token.end() > token.start() + 1:
            string = token[0][1:-1]
        else:
            return out, True
    return out, False


class _Pieces:
    """The pieces of a partition with the brace that stood before each but the first one of a file."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches, self.name = batches, None

    def __iter__(self) -> Iterator[tuple[bool, tuple[str, int], str, tuple]]:
        for batch in self.batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = row[:2] != self.name
                self.name = row[:2]
                yield new, self.name, row[2] if new and row[1] == 0 else "{" + row[2], row[3:]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each state it may start in: whether it ends inside a string, and by how much the depth changes."""
    found: dict[tuple[str, int], list[list[int]]] = {}
    for _, name, text, _ in _Pieces(batches):
        for state in found.setdefault(name, [[0, 0], [1, 0]]):
            marks, inside = brackets(text, bool(state[0]))
            state[0] = int(inside)
            state[1] += sum(1 if c in "{[" else -1 for _, c, _ in marks)
    if found:
        rows = [(*name, *zero, *one) for name, (zero, one) in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "split", "s0", "d0", "s1", "d1"), r, strict=True)) for r in rows])


ELEMENT_FIELDS = "file string, split bigint, kind string, array string, value string"


def _cut(depth: int):
    """Elements and, per split, the ends of elements that cross it (``head``, ``tail``), what lies between (``rest``) and the
    array that it ends in (``last``). An array named ``?`` is the one that the split starts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = None, []
        level, array, inside, kind, held, rest = 0, "?", False, None, [], []

        def close() -> None:
            if name is not None:
                if kind:  # an element that goes on in the next split
                    out.append((*name, "middle" if kind == "head" else "tail", array, "".join(held)))
                out.append((*name, "rest", None, "".join(rest)))
                out.append((*name, "last", array, None))

        for new, at, text, (start_inside, start_level) in _Pieces(batches):
            if new:
                close()
                name, level, array, inside = at, start_level, "?", bool(start_inside)
                kind, held, rest = ("head" if level > depth else None), [], []
            begin = 0
            marks, inside = brackets(text, inside)
            for place, c, key in marks:
                if c in "{[":
                    if level == depth - 1:
                        array = (key or "") if c == "[" else ""
                    elif level == depth and array:
                        between = text[begin:place]
                        rest.append("" if between.strip() == "," else between)
                        begin, kind, held = place, "element", []
                    level += 1
                else:
                    level -= 1
                    if level == depth and kind:
                        held.append(text[begin : place + 1])
                        out.append((*name, kind, array, "".join(held)))
                        begin, kind, held = place + 1, None, []
                    elif level == depth - 1:
                        array = ""
            (held if kind else rest).append(text[begin:] if kind or text[begin:].strip() != "," else "")
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        close()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "split", "kind", "array", "value"])


def json_elements(spark: SparkSession, path: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """The elements of all arrays at nesting depth ``depth`` of JSON files, and the files without them.

    Elements: (file, array, value), the key of the array and the text of the element, an object or array. Rest: (file,
    value), a document per file in which these arrays are empty; it must fit in a row. Arrays are those that open the
    ``depth``-th bracket and have a key. Files may have one line or many; elements that do not cross a split stay where
    they are read, the others are put together from their parts.
    """
    pieces = _pieces(spark, path, "{").select("file", "split", "value")
    sums = pieces.mapInArrow(_sum_up, "file string, split bigint, s0 bigint, d0 bigint, s1 bigint, d1 bigint")
    # What a split does to the state is to keep it, turn it, or (as escapes count only inside strings) to fix it. The state
    # at a split is that of the last fixed one, turned as often as splits since then turn it.
    through = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("s0") == F.col("s1")
    sums = sums.withColumn("turn", F.when(fixed, 0).otherwise(F.col("s0")))
    sums = sums.withColumn("mark", F.when(fixed, F.col("s0") + F.sum("turn").over(through)))
    state = F.coalesce(F.last("mark", ignorenulls=True).over(_before()), F.lit(0)) + F.coalesce(F.sum("turn").over(_before()), F.lit(0))
    sums = cut_lineage(sums.withColumn("inside", F.pmod(state, F.lit(2))), "split-states")
    change = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    known = sums.select("file", "split", "inside", F.coalesce(F.sum(change).over(_before()), F.lit(0)).alias("level"))
    parts = pieces.join(F.broadcast(known), ["file", "split"]).mapInArrow(_cut(depth), ELEMENT_FIELDS)  # known: a row per split
    parts = cut_lineage(parts, "elements")
    named = parts.filter("kind = 'last'").select("file", "split", F.when(F.col("array") != "?", F.col("array")).alias("last"))
    given = named.select("file", "split", F.coalesce(F.last("last", ignorenulls=True).over(_before()), F.lit("")).alias("given"))
    full = parts.filter("kind = 'element'").join(F.broadcast(given), ["file", "split"]).select("file", F.when(F.col("array") == "?", F.col("given")).otherwise(F.col("array")).alias("array"), "value")
    crossing = parts.filter("kind IN ('head', 'middle', 'tail')").join(given, ["file", "split"])
    begun = F.last(F.when(F.col("kind") == "tail", F.col("split")), ignorenulls=True)
    crossing = crossing.withColumn("of", F.when(F.col("kind") == "tail", F.col("split")).otherwise(F.coalesce(begun.over(Window.partitionBy("file").orderBy("split").rangeBetween(Window.unboundedPreceding, -1)), F.lit(-1))))
    joined = crossing.groupBy("file", "of").agg(
        F.max(F.when(F.col("kind") == "tail", F.when(F.col("array") == "?", F.col("given")).otherwise(F.col("array")))).alias("array"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda x: x["value"]), "").alias("value"))
    rest = parts.filter("kind = 'rest'").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda x: x["value"]), "").alias("value"))
    return full.unionByName(joined.select("file", "array", "value")).filter("array <> ''"), rest
