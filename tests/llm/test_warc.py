import base64
import hashlib

import pytest

from claimweave.llm import warc


def test_records_come_back_one_by_one():
    records = [warc.record(k, f"http://h/{k}\r\nX: y", f"<p>page {k % 5}</p>".encode() * 20, None, "2020-01-01T00:00:00Z") for k in range(300)]
    content = warc.archive(records)
    assert content[:4] == warc.SKIPPABLE and list(warc.records_of(content)) == records
    assert warc.parse(records[7])[:2] == ("7", 13 * 20)
    assert len(content) < sum(map(len, records))
    with pytest.raises(ValueError):
        list(warc.records_of(content[:-3]))
    with pytest.raises(ValueError):
        warc.parse(records[7].replace(b"page 2", b"page 3", 1))


def test_tiny_archives():
    for records in ([b""], [b"a"], [b"abc", b"abc"]):
        assert list(warc.records_of(warc.archive(records))) == records


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, folder, least):
    rows = [(1, "u", "same text"), (5, "u", "same text"), (3, None, "same text"), (5, "u", "same text"), (2, "u", None), (4, "u", ""), (None, "u", "same text"), (None, "u", "own"), (9, "é ü", "é" * 3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id bigint, url string, html string, n int, digest int")
    archives = warc.save_archives(df, f"{folder}/archives", least_revisit=least)
    got = sorted(map(str, (tuple(r) for r in warc.read_archives(archives).collect())))
    last, want = {}, []
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            last[data] = max(page, last.get(data, page))
    for page, _, html in rows:
        data = (html or "").encode()
        target = last.get(data) if len(data) >= least and last.get(data) != page else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if target is not None else "response", target))
    assert got == sorted(map(str, want))
    files = warc.export_files(archives, f"file://{folder}").collect()
    assert all((folder / f.archive).stat().st_size == f.size for f in files)
    again = spark.read.format("binaryFile").load([f"{folder}/{f.archive}" for f in files])
    assert warc.read_archives(again).count() == len(rows)


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.save_archives(df, f"{folder}/none")).count() == 0
