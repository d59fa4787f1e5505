"""Operator 3: round trips through archives."""

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections import Counter

import pytest

from funnelkit.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, digest string"


def pages(spark):
    rows = [(1, "http://a\r\nb", None), (2, None, ""), (3, "u", "x\r\n\r\nWARC/1.1\r\n"), (5, "u", "same"), (4, "u", "same"),
            (4, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (6, "é", "é😀" * 50_000), (7, "u", "same")]
    return spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA)


def expected(rows, min_bytes=0):
    held = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for p, h in held:
        if p is not None:
            first[h] = min(p, first.get(h, p))
    times = Counter(h for _, h in held)
    out = Counter()
    for p, h in held:
        to = first.get(h) if times[h] > 1 and len(h) >= min_bytes else None
        to = None if to == p else to
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out[(p, len(h), digest, "revisit" if to is not None else "response", to)] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = pages(spark).repartition(3)
    got = warc.warc_round_trip(df, min_bytes=min_bytes).collect()
    assert Counter(map(tuple, got)) == expected(df.collect(), min_bytes)


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert Counter(map(tuple, warc.warc_round_trip(df).collect())) == expected(df.collect())
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_files_are_what_they_claim(spark, tmp_path):
    folder = f"file://{tmp_path}"
    warc.write_monolithic(pages(spark).coalesce(1), folder + "/mono")
    mono = [p for p in (tmp_path / "mono").glob("*.gz")]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in mono)
    one = zlib.decompressobj(31)
    one.decompress(mono[0].read_bytes())
    assert one.eof and not one.unused_data  # one member over all records
    index = warc.normalise(spark, folder + "/mono", folder + "/out").collect()
    archives = {r.archive for r in index}
    assert len(index) == pages(spark).count()
    joined = b""
    for a in sorted(archives):
        data = open(a.removeprefix("file://"), "rb").read()
        rows = sorted((r for r in index if r.archive == a), key=lambda r: r.offset)
        assert sum(r.length for r in rows) == len(data) and rows[0].offset == 0
        for r in rows:
            member = zlib.decompressobj(31)
            record = member.decompress(data[r.offset:r.offset + r.length])
            assert member.eof and not member.unused_data and record.startswith(b"WARC/1.1\r\n")
            joined += record
    assert joined == whole
    # doing a file again leaves the same archive and index
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    warc.normalise_file(f"file://{mono[0]}", folder + "/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    assert all(json.loads(x)["length"] > 0 for n, b in before.items() if n.endswith("json") for x in b.splitlines())


def test_stream_in_small_chunks_and_members():
    def record(body):
        return b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    data = [record(b"x" * n) for n in (0, 1, 70_000, 3)]
    packed = gzip.compress(data[0] + data[1]) + gzip.compress(b"".join(data[2:]))
    for chunk in (1, 7, 1 << 16):
        assert list(warc.records(warc.inflated(io.BytesIO(packed), chunk))) == data
    with pytest.raises(ValueError):
        list(warc.records([data[2][:500]]))
    with pytest.raises(ValueError):
        list(warc.records([b"WARC/1.1\r\nContent"]))
