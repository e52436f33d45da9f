"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Two occurrences of a string of 200 bytes must meet in one task without sorting all suffixes of a corpus in one place. So
every window of 200 bytes names an anchor, the smallest hash among its 72-byte grams (the leftmost of equals); equal
windows name equal anchors. Neighbouring windows with the same anchor form a context, about 265 bytes long. Only contexts
whose anchor occurs twice or more travel. Equal contexts are one text with a weight; an anchor with one context needs no
more. The contexts of the other anchors are packed into shards: suffix array, transform, and a breadth-first backward
extension from the empty string that derives common prefix lengths by increasing value and stops at 200. What is then
still unset is a common prefix of 200 bytes or more.

An anchor with very many contexts is split: its windows are dealt to cells by their distance from the anchor, and every
cell is keyed by the bytes that all its windows share. The last level of cells is the window itself, so any group becomes
small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import cut_lineage, scratch_path

GRAM = 72
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHARD_BYTES = 500_000
STEPS = (48, 16, 4, 1)  # widths of the cells that an anchor with too many contexts is split into, level by level
PIECE = 1 << 22  # bytes of a text whose windows are found together


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last): anchors with the range of starts of the windows that name each."""
    found = [_anchors(data[at : at + PIECE + length - 1], length, at) for at in range(0, max(0, len(data) - length + 1), PIECE)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _anchors(data: bytes, length: int, offset: int) -> tuple[np.ndarray, ...]:
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(values)
    power, back = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:n])))
    grams = (sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    order = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)  # hash, then place
    width = length - GRAM + 1
    count = len(grams) - width + 1
    pad = -len(order) % width
    blocks = np.concatenate((order, np.full(pad, np.iinfo(np.uint64).max))).reshape(-1, width)
    falling = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    rising = np.minimum.accumulate(blocks, axis=1).ravel()
    least = np.minimum(falling[:count], rising[width - 1 : width - 1 + count])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.append(first[1:], count) - 1
    at = place[first]
    return grams[at].view(np.int64), at + offset, first + offset, last + offset


def packed(docs: DataFrame) -> DataFrame:
    """(id, th, z): rows named by id and text hash, texts compressed, as they travel twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t.as_buffer()) for t in batch.column(2)], pa.binary())], names=["id", "th", "z"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, th bigint, z binary")


def unpacked(z: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z.as_buffer())


def anchor_places(docs: DataFrame, length: int) -> DataFrame:
    """(key, id, th, place, first, last): every anchor of every document with the range of starts of the windows that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(text.as_buffer().to_pybytes(), length) for text in batch.column(2)]
            if found:
                at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                key, *where = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in where)], names=["key", "id", "th", "place", "first", "last"]
                )

    return docs.mapInArrow(run, f"key bigint, id {docs.schema['id'].dataType.simpleString()}, th bigint, place int, first int, last int")


CONTEXT = "key bigint, cid binary, id {id}, th bigint, at bigint, low int, data binary"


def context_id(data: bytes, low: int) -> bytes:
    return xxhash.xxh3_128_digest(low.to_bytes(4, "little") + data)


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """(key, cid, id, th, at, low, data): every context of a document's repeated anchors, given as (id, th, z, places).

    ``at`` is its place in the document, ``low`` the smallest distance from a window's start to the anchor. ``data`` comes
    with the first of equal contexts of a batch only.
    """
    schema = CONTEXT.format(id=rows.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[bytes] = set()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                data, asked = unpacked(batch.column(2)[i]), batch.column(3)[i].values
                name, th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for k, p, a, b in zip(*(asked.field(c).to_pylist() for c in ("key", "place", "first", "last")), strict=True):
                    part, low = data[a : b + length], p - b
                    cid = context_id(part, low)
                    out.append((k, cid, name, th, a, low, None if cid in known else part))
                    known.add(cid)
                if len(out) >= 50_000 or i == batch.num_rows - 1:
                    columns = list(zip(*out, strict=True)) or [()] * 7
                    kinds = (pa.int64(), pa.binary(), batch.column(0).type, pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "cid", "id", "th", "at", "low", "data"])
                    out = []

    return rows.mapInArrow(run, schema)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text of small numbers that ends in a number found nowhere else.

    Prefix doubling. A rank is the place of the first suffix with an equal prefix, so a suffix that is alone stays where it
    is, and only the others are sorted again: rank, rank of what follows and place, as one number.
    """
    n = len(text)
    bits = int(text.max()).bit_length()
    step = 62 // bits  # so many numbers fit in one key
    key = np.zeros(n, np.int64)
    for k in range(min(step, n)):
        key[: n - k] |= text[k:] << (bits * (step - 1 - k))
    order = np.argsort(key)
    places = np.arange(n)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    width = n.bit_length()
    mask = (1 << width) - 1
    open_ = order[~(first & np.append(first[1:], True))]  # suffixes whose prefix is not theirs alone
    while open_.size:
        own = rank[open_]
        after = open_ + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        if 3 * width < 64:
            key = (((own << width) | follow) << width) | open_
            key.sort()
            open_ = key & mask
            key >>= width
            own = key >> width
        else:
            key = own * (n + 1) + follow
            by = np.argsort(key)
            key, open_, own = key[by], open_[by], own[by]
        at = places[: len(own)]
        group = np.concatenate(([True], own[1:] != own[:-1]))
        slot = own + at - np.maximum.accumulate(np.where(group, at, 0))
        order[slot] = open_
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[open_] = slot[np.maximum.accumulate(np.where(first, at, 0))]
        open_ = open_[~(first & np.append(first[1:], True))]
        step *= 2
    return order


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """For every place of ``text`` whether the string of ``length`` numbers from there occurs at another place too.

    Numbers below 256 are bytes; each separator is a larger number that occurs once.
    """
    n = len(text)
    order = suffix_array(text)
    transform = text[order - 1]  # the number before each suffix
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    back = inverse[order - 1]  # where the suffix that is longer by one stands
    common = np.full(n + 1, -1, np.int64)  # common prefix length of a suffix with the one before it; -1: not yet known
    common[0] = common[n] = 0
    width, letter = n.bit_length(), int(text.max()).bit_length()
    mask = (1 << width) - 1
    low, high = np.array([0]), np.array([n])
    for value in range(length):  # all strings of this many numbers that end a run of equal prefixes found at this value
        sizes = high - low
        place = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        before = transform[place]
        group = np.repeat(np.arange(len(low)), sizes)
        inside = (before < 256) | (value == 0)  # a separator may end a string, but nothing goes back over it
        place, key = place[inside], (group[inside] << letter) | before[inside]
        if not place.size:
            break
        sortable = (key << width) | place
        sortable.sort()
        key, place = sortable >> width, sortable & mask
        first = np.concatenate(([True], key[1:] != key[:-1]))
        last = np.append(first[1:], True)
        start, end = back[place[first]], back[place[last]] + 1
        new = common[end] < 0
        common[end[new]] = value
        low, high = start[new], end[new]
        if not low.size:
            break
    deep = common < 0
    deep[0] = deep[n] = False
    found = np.zeros(n, bool)
    found[order] = deep[:-1] | deep[1:]
    return found


def covered(pieces: list[bytes], weights: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the byte ranges that repeated strings of ``length`` bytes cover."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
    text[ends - 1] = 256 + np.arange(len(pieces))
    starts = ends - sizes - 1
    repeated = repeated_starts(text, length)
    out = []
    for s, size, weight in zip(starts.tolist(), sizes.tolist(), weights.tolist(), strict=True):
        if weight > 1:
            out.append([(0, size)])
            continue
        own = np.concatenate(([False], repeated[s : s + size], [False]))
        edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
        out.append([(a, b - 1 + length) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


RANGES = "array<struct<a:int,b:int>>"


def expand_shards(data: DataFrame, length: int) -> DataFrame:
    """(key, cid, ranges) for the contexts (key, cid, weight, data, shard) of each shard."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        pieces = table.column("data").to_pylist()
        ranges = covered(pieces, table.column("weight").to_numpy(), length)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        values = pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], kind)
        return pa.Table.from_arrays([table.column("key"), table.column("cid"), values], names=["key", "cid", "ranges"])

    return data.groupBy("shard").applyInArrow(run, f"key bigint, cid binary, ranges {RANGES}")


def halves(data: DataFrame, length: int, step: int) -> DataFrame:
    """(key, cid, shift, new_key, new_cid, new_low, data): contexts cut at multiples of ``step`` of the distance to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, cid, low, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                high = low + len(value) - length  # the largest distance, that of the first window
                for cell in range(low // step, high // step + 1):
                    nearest, farthest = cell * step, cell * step + step - 1
                    near, far = max(low, nearest), min(high, farthest)
                    part = value[high - far : high - near + length]
                    shared = value[high - nearest : high - farthest + length]  # inside every window of the cell
                    name = int.from_bytes(xxhash.xxh3_64_digest(f"{key}:{step}:{cell}:".encode() + shared), "little", signed=True)
                    out.append((key, cid, high - far, name, context_id(part, near), near, part))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "cid", "shift", "new_key", "new_cid", "new_low", "data"])

    schema = "key bigint, cid binary, shift int, new_key bigint, new_cid binary, new_low int, data binary"
    return data.select("key", "cid", "low", "data").mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, well compressed, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(small: DataFrame, data: DataFrame, length: int, steps: tuple[int, ...], shard_bytes: int) -> DataFrame:
    """(key, cid, ranges): covered byte ranges of contexts (key, cid, weight, size), whose bytes are in ``data`` (key, cid, low, data)."""
    groups = small.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sized = small.join(groups, "key")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("size").cast("int").alias("b")))
    alone = sized.filter("n = 1 AND weight > 1").select("key", "cid", whole.alias("ranges"))
    several = stored(
        sized.filter("n > 1").join(data.groupBy("key", "cid").agg(F.first("low").alias("low"), F.first("data").alias("data")), ["key", "cid"])
        .select("key", "cid", "weight", "low", "data", (F.col("bytes") > shard_bytes).alias("hot")),
        "contexts",
    )
    found = several.agg(F.sum(F.when(~F.col("hot"), F.octet_length("data"))).alias("bytes"), F.count_if("hot").alias("hot")).first()
    hot, shards = found["hot"], max(1, -(-(found["bytes"] or 0) // shard_bytes))
    placed = several.filter("NOT hot").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    results = alone.unionByName(expand_shards(placed.select("key", "cid", "weight", "data", "shard"), length))
    if not hot:
        return results
    if not steps:
        raise ValueError("an anchor's contexts cannot be split further")  # windows that share all their bytes are one context
    crowded = several.filter("hot")
    cut = stored(halves(crowded, length, steps[0]).join(crowded.select("key", "cid", "weight"), ["key", "cid"]), "halves")
    new = cut.select(F.col("new_key").alias("key"), F.col("new_cid").alias("cid"), "weight", F.col("new_low").alias("low"), "data")
    parts = new.groupBy("key", "cid").agg(F.sum("weight").alias("weight"), F.max(F.octet_length("data")).alias("size"))
    inner = resolve(parts, new.select("key", "cid", "low", "data"), length, steps[1:], shard_bytes)
    inner = inner.select(F.col("key").alias("new_key"), F.col("cid").alias("new_cid"), F.col("ranges").alias("part"))
    moved = F.transform("part", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    back = cut.select("key", "cid", "shift", "new_key", "new_cid").join(inner, ["new_key", "new_cid"])
    return results.unionByName(back.groupBy("key", "cid").agg(F.flatten(F.collect_list(moved)).alias("ranges")))  # a few cells per context


def covered_runs(found: pa.ListArray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): maximal runs of each row's ranges, in order; touching ranges are one run.

    ``found`` lists (at, ranges) per row, or is null; ``base`` is where each row's text starts when all are laid end to end
    with a place between them, so that one pass over all rows merges them.
    """
    item = found.flatten()
    start = item.field("at").to_numpy(zero_copy_only=False) + np.repeat(base, pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    ranges = item.field("ranges")
    start = np.repeat(start, pc.list_value_length(ranges).to_numpy(zero_copy_only=False))
    a, b = (start + ranges.flatten().field(c).to_numpy(zero_copy_only=False) for c in "ab")
    if not a.size:
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
    row = np.searchsorted(base, a, "right") - 1
    return row, a - base[row], b - base[row]


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) of every row: byte ranges that repeated strings cover, and the bytes left.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, the same row
    included; overlapping occurrences count, and strings never cross rows. A null text is an empty one, texts shorter than
    ``length`` stay whole, and repeated rows repeat each other, so both lose all their bytes. Null keys stay null, other
    columns are not kept, an empty table gives no rows. ``shard_bytes`` bounds the work of a task, not the result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings need at least {2 * GRAM} bytes")
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.select("id", F.xxhash64("_t").alias("th"), F.encode("_t", "UTF-8").alias("text"))
    places = stored(anchor_places(rows, length), "places")
    often = places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")  # a join, not a window: Spark can split it where a key is in very many texts
    wanted = places.join(often, "key").groupBy("id", "th").agg(F.collect_set(F.struct("key", "place", "first", "last")).alias("places"))  # equal rows ask once
    wanted = wanted.withColumnsRenamed({"id": "_id", "th": "_th"})
    same = lambda left: left["id"].eqNullSafe(F.col("_id")) & (left["th"] == F.col("_th"))
    texts = packed(rows)
    found = texts.join(wanted, same(texts)).select("id", "th", "z", "places")
    table = stored(contexts(found, length), "occurrences")
    small = stored(table.withColumn("size", F.octet_length("data")).groupBy("key", "cid").agg(F.count("*").alias("weight"), F.max("size").alias("size")), "weights")
    ranges = resolve(small, table.filter("data IS NOT NULL").select("key", "cid", "low", "data"), length, STEPS, shard_bytes)
    removal = table.select("key", "cid", "id", "th", "at").join(ranges, ["key", "cid"]).groupBy("id", "th").agg(F.collect_set(F.struct("at", "ranges")).alias("found"))
    removal = removal.withColumnsRenamed({"id": "_id", "th": "_th"})
    joined = texts.join(removal, same(texts), "left").select("id", "z", "found")
    kind = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unpacked(z) for z in batch.column(1)]
            sizes = np.array([len(t) for t in texts], np.int64)
            base = np.cumsum(sizes + 1) - sizes - 1  # texts laid end to end, one place apart
            row, a, b = covered_runs(batch.column(2), base)
            per_row = np.bincount(row, minlength=len(texts))
            ends = np.concatenate(([0], np.cumsum(per_row)))
            total = np.concatenate(([0], np.cumsum(b - a)))
            kept = []
            for text, low, high in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if low == high:
                    kept.append(text)
                    continue
                cuts = [0, *np.stack((a[low:high], b[low:high]), axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join([text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), spans, pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"]
            )

    out = joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<a:bigint,b:bigint>>, kept binary")
    return out.withColumnRenamed("id", key)
