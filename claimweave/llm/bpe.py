"""Byte-pair encoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the ranks of a piece's adjacent pairs, the root is the leftmost lowest rank. A merge writes at
most three leaves (the pair itself, the one before, the one swallowed), each in logarithmic time, until the root says that
no pair can be merged. Pieces of one width share the steps: one array holds the trees of thousands of pieces. Longer
pieces have a tree of their own, so a run of a million letters costs n log n.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The byte-level pre-tokenizer: fixed value, part of the vocabulary's definition.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WIDTHS = (4, 8, 16, 32, 64)
NONE = np.int64(1) << 60
PAIR = 1 << 20  # more than any token id
_CODECS: dict[str, Codec] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary from the text of a tokenizer file (models whose merges are all in the vocabulary)."""

    def __init__(self, definition: str, cached: int = 500_000) -> None:
        spec = json.loads(definition)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * PAIR + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.ranks = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}
        self.cache: dict[str, bytes] = {}
        self.cached = cached

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left * PAIR + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)

    def _many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, all trees in one array; keys are rank * width + place."""
        n = len(pieces)
        rows = np.arange(n)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        places = np.arange(width)
        alive = places < size[:, None]
        ids = np.full((n, width + 2), -1, np.int64)  # a column of -1 at either end: no neighbour
        ids[:, 1:-1] = np.where(alive, self.byte_id[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 3), (n, width + 2)).copy()
        after[rows, size] = width + 1  # the last byte's neighbour is the end column
        before = np.broadcast_to(np.arange(-1, width + 1), (n, width + 2)).copy()

        def key(row: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self._rank(ids[row, place], ids[row, after[row, place]])
            return np.where(rank < NONE, rank * width + place - 1, NONE)

        tree = np.full((n, 2 * width), NONE, np.int64)
        first = self._rank(ids[:, 1:-1], ids[:, 2:])
        tree[:, width:] = np.where(first < NONE, first * width + places, NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        row = rows[tree[:, 1] < NONE]
        while row.size:
            root = tree[row, 1]
            place = root % width + 1
            swallowed = after[row, place]
            ids[row, place] = self.merged[root // width]
            alive[row, swallowed - 1] = False
            beyond = after[row, swallowed]
            after[row, place] = beyond
            before[row, beyond] = place
            previous = before[row, place]
            for leaf, value in ((swallowed, NONE), (place, key(row, place)), (previous, key(row, previous))):
                inside = leaf >= 1
                r, node = row[inside], leaf[inside] - 1 + width
                tree[r, node] = value[inside] if isinstance(value, np.ndarray) else value
                while node.size and node[0] > 1:  # all leaves lie equally deep
                    node = node // 2
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        flat = ids[:, 1:-1][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _one(self, piece: bytes) -> bytes:
        """The same for one long piece, with a tree of its own."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        width = 1 << (n - 1).bit_length()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merged, ranks = self.merged, self.ranks
        none = int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(ids[i] * PAIR + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def write(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node //= 2
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        def key(i: int) -> int:
            rank = ranks.get(ids[i] * PAIR + ids[after[i]]) if after[i] >= 0 else None
            return none if rank is None else rank * width + i

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i] = int(merged[rank])
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            write(j, none)
            write(i, key(i))
            if before[i] >= 0:
                write(before[i], key(before[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        if len(self.cache) + len(pieces) > self.cached:
            self.cache.clear()
        names = list(pieces)
        data = [p.encode() for p in names]
        classes = np.searchsorted(WIDTHS, np.fromiter(map(len, data), np.int64, len(data)))
        for k, width in enumerate((*WIDTHS, 0)):
            members = np.flatnonzero(classes == k)
            for some in np.array_split(members, max(1, len(members) // 8192)):
                chosen = [data[i] for i in some.tolist()]
                packed = self._many(chosen, width) if width and chosen else map(self._one, chosen)
                self.cache.update(zip([names[i] for i in some.tolist()], packed, strict=True))

    def _known(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of pieces; pieces not met before are encoded together."""
        fresh = set().union(*texts).difference(self.cache)
        if fresh:
            self._learn(fresh)
            if len(missing := set().union(*texts).difference(self.cache)):  # the cache was emptied meanwhile
                self._learn(missing)
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in texts]

    def _parts(self, text: str) -> Iterator[str | int]:
        """Texts between special tokens, and the ids of those tokens."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()]
            yield self.special[m.group()]
            at = m.end()
        yield text[at:]

    def encode_long(self, text: str, step: int = 100_000) -> bytes:
        """Packed ids of one text, ``step`` pieces at a time in memory."""
        out = []
        for part in self._parts(text):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
                continue
            found = (m.group() for m in PIECES.finditer(part))
            while pieces := list(islice(found, step)):
                out += self._known([pieces])
        return b"".join(out)

    def encode(self, texts: list[str], at_once: int = 1_000_000) -> Iterator[bytes]:
        """Packed ids of each text, about ``at_once`` characters of them in memory as pieces."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            plain = len(text) <= at_once and not (self.split and self.split.search(text))
            if group and (not plain or size + len(text) > at_once):
                yield from self._known(group)
                group, size = [], 0
            if plain:
                group.append(PIECES.findall(text))
                size += len(text)
            else:
                yield self.encode_long(text)
        if group:
            yield from self._known(group)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _codec(definition: Broadcast) -> Codec:
    """The codec of a worker process, built once per vocabulary."""
    text = definition.value
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(text)
    return _CODECS[name]


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``ids`` (binary: token ids as little-endian unsigned 32-bit integers) and ``decoded`` of every row.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content, a vocabulary of fixed size, is broadcast.
    Special tokens spelled out in a text are encoded as such. A null text is an empty one and has no ids. Repeated rows
    are encoded each for itself, other columns are not kept, an empty table gives no rows; texts are encoded whole.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys] + ["ids binary", "decoded string"])
    names = [*keys, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(definition)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = list(codec.encode([t or "" for t in part.column(len(keys)).to_pylist()]))
                columns = [part.column(i) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], names=names)

    return kept.mapInArrow(run, schema)


def packed_length(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")
