import base64
import gzip
import hashlib
import io
import random

from purselight.llm import warc_chunks as wc


def rows():
    rng = random.Random(8)
    out = [(0, "u://0", ""), (1, None, None), (2, "u://2\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\n"), (3, "u", "x" * 1000), (4, "u", "x" * 1000), (9, "u", "é" * 700), (8, "u", "é" * 700), (8, "u", "é" * 700), (None, "u", "é" * 700), (None, "u", "alone")]
    return out + [(10 + i, f"u://{i}", "y" * rng.choice([0, 1, 63, 64, 65, 128, 640])) for i in range(40)]


def want(data, least):
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        of = first.get(h or "")
        again = len(raw) >= least and of is not None and i != of
        out.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", of if again else -1))
    return sorted(out)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, data string")
    for least, chunk in ((0, 64), (65, 1 << 18)):
        manifest = wc.archive(pages, least_bytes=least, chunk=chunk)
        got = wc.summary(wc.read(manifest, chunk)).collect()
        assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want(rows(), least)
        assert manifest.selectExpr("sum(records)").first()[0] == len(rows())


def test_chunk_rows_carry_data_and_digests(spark):
    pages = spark.createDataFrame([(5, "u", "0123456789" * 20), (6, "u", "")], "page_id long, url string, html string")
    got = sorted(wc.read(wc.archive(pages, chunk=64), 64, with_data=True).collect(), key=lambda r: (r.page_id, r.chunk_no))
    five = [r for r in got if r.page_id == 5]
    assert b"".join(bytes(r.data) for r in five) == b"0123456789" * 20
    assert [r.bytes_so_far for r in five] == [64, 128, 192, 200] and [r.last for r in five] == [False] * 3 + [True]
    for r in five:
        assert r.sha1_so_far == base64.b32encode(hashlib.sha1((b"0123456789" * 20)[: r.bytes_so_far]).digest()).decode()
    assert [(r.chunk_no, r.bytes_so_far, r.last) for r in got if r.page_id == 6] == [(0, 0, True)]


def test_archive_is_gzip_members(spark):
    pages = spark.createDataFrame([(5, "u", "abc"), (6, "u", "abc")], "page_id long, url string, html string").coalesce(1)
    paths = [r.path for r in wc.archive(pages).collect()]
    raw = b"".join(gzip.open(p.removeprefix("file://")).read() for p in paths)
    assert raw.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:5>" in raw
    assert len(list(wc.stream_records(io.BufferedReader(io.BytesIO(raw))))) == 2


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert wc.summary(wc.read(wc.archive(pages))).collect() == []
