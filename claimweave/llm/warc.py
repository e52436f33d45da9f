"""Dictionary-compressed WARC archives, written and read back.

An archive is a sequence of Zstandard frames, one per record, after a leading skippable frame that embeds the dictionary
built from the archive's own records. Any record can be decompressed alone once the dictionary is known. Archives are
bounded in size and travel as binary values, so Spark writes and commits them like any table, to any store that it reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")  # fixed value: the skippable frame that holds a dictionary
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_record_types(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url", least_revisit: int = 0) -> DataFrame:
    """(page, url, html, n, digest, target): ``target`` is the page that a revisit refers to, null for a response.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the largest id is the response; a row
    that repeats its id is a response too. A page without an id is a revisit if another one with an id is its equal. Ids
    and counts are grouped before they meet the pages, so a payload that a third of the pages share costs one row more.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("bigint")).withColumn("digest", F.sha1("html"))
    last = rows.filter(F.col("n") >= least_revisit).groupBy("digest", "n").agg(F.max("page").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page"))
    return rows.join(last.drop("copies"), ["digest", "n"], "left").withColumn("target", F.when(revisit, F.col("last"))).drop("last")


def record(page: object, url: str | None, payload: bytes, target: object, date: str) -> bytes:
    """One record. A revisit keeps the HTTP header with the payload's length and refers to the response by its id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target is not None else http + payload
    fields = [
        VERSION,
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m.group()):02X}', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if target is not None:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{target}>"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int, samples: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from about ``samples`` bytes of records taken at even steps; archives too small to train on use one record's bytes."""
    step = max(1, sum(map(len, records)) // samples)
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8)
    except zstandard.ZstdError:
        raw = max(chosen, key=len)[:size].ljust(8, b" ")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3, dictionary_size: int = 65_536, samples: int = 2_000_000) -> bytes:
    words = build_dictionary(records, dictionary_size, samples)
    words.precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(dict_data=words, write_content_size=True).compress
    embedded = words.as_bytes()
    return b"".join([SKIPPABLE, len(embedded).to_bytes(4, "little"), embedded, *map(compress, records)])


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    if content[:4] != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    at = 8 + int.from_bytes(content[4:8], "little")
    words = zstandard.ZstdCompressionDict(content[8:at])
    reader, view = zstandard.ZstdDecompressor(dict_data=words), memoryview(content)
    while at < len(content):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + 4096]
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(page, payload bytes, payload digest, record type, page referred to) of a record; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1] or None
    target = fields["WARC-Refers-To"][len("<urn:page:") : -1] if "WARC-Refers-To" in fields else None
    return page, size, digest, kind, target


def write_archives(typed: DataFrame, bytes_each: int = 8_000_000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, n_records, content): archives of about ``bytes_each`` bytes of records, named by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(records: list[bytes]) -> pa.RecordBatch:
            content = archive(records)
            name = f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([content], pa.binary())], names=["archive", "n_records", "content"])

        waiting: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html, target in zip(*batch.columns, strict=True):
                waiting.append(record(page.as_py(), url.as_py(), html.as_py().encode(), target.as_py(), date))
                size += len(waiting[-1])
                if size >= bytes_each:
                    yield full(waiting)
                    waiting, size = [], 0
        if waiting:
            yield full(waiting)

    return typed.select("page", "url", "html", "target").mapInArrow(run, "archive string, n_records bigint, content binary")


def read_archives(archives: DataFrame, page_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of archives in a ``content`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = list(zip(*map(parse, records_of(content.as_py())), strict=True))
                if found:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = archives.select("content").mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def save_archives(pages: DataFrame, path: str, page: str = "page_id", html: str = "html", url: str = "url", least_revisit: int = 0) -> DataFrame:
    """Write ``pages`` as archives below ``path`` and return them as a table.

    A null html is an empty payload, a null url becomes about:blank, repeated rows are archived each, other columns are
    not kept, an empty table gives no archives. A record larger than an archive gets an archive of its own.
    """
    write_archives(with_record_types(pages, page, html, url, least_revisit)).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write every archive as a file of its own below ``folder`` (a URI that all executors reach); returns (archive, size).

    Files are named by their content, so a task that is run again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64())], names=["archive", "size"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, size bigint")
