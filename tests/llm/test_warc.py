import base64
import hashlib
from collections import defaultdict

import pytest
from oracle import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm import queries, warc

PAGES = [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", ""), (4, "u", None), (5, "u", "é" * 40_000), (6, "u", "é" * 40_000), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 30), (None, "u", "x"), (8, "u", "solo"), (8, "u", "solo"), (9, "u", "y" * 199), (10, "u", "\x00\ud7ff")]


def brute(pages, min_bytes=0):
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    out = []
    for h, ids in groups.items():
        raw = h.encode()
        best = max((i for i in ids if i is not None), default=None) if len(ids) > 1 and len(raw) >= min_bytes else None
        for i in ids:
            refers = best if best is not None and i != best else None
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(map(str, out))


@pytest.mark.parametrize(("segment", "archive", "least", "groups"), [(32768, 2**23, 0, 200_000), (100, 1000, 0, 0), (37, 1, 2, 5)])
def test_round_trip(spark, tmp_path, monkeypatch, segment, archive, least, groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    df = clashing(spark, PAGES)
    got = warc.round_trip(df, str(tmp_path / "w"), min_bytes=least, segment_bytes=segment, archive_bytes=archive).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(PAGES, least)
    assert all(r.complete for r in got)


def clashing(spark, pages):
    """With columns whose names are used inside."""
    names = "page_id bigint, url string, html string, id string, sha int, `unique` string, keeper bigint, group_sha binary, payload string, n int, value string, size int"
    return spark.createDataFrame([(*p, "i", 1, "u", 2, b"g", "p", 3, "v", 4) for p in pages], names)


@pytest.mark.parametrize("pages", [PAGES, [p for p in PAGES if p[0] != 8], PAGES + [(2, None, "x")] * 3 + [(6, "u", "é" * 40_000), (6, "v", "é" * 40_000)]])
def test_references_resolve(spark, tmp_path, pages):
    """Identifiers are unique, also of rows that repeat, and what a revisit refers to is the identifier of a response with that payload."""
    warc.write_archives(clashing(spark, pages), str(tmp_path / "w"), segment_bytes=20_000)
    records = [f for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(str(tmp_path / "w")).collect() for f, _ in warc.parse(bytes(r.content))]
    ids = [f["warc-record-id"] for f in records]
    assert len(ids) == len(set(ids))
    responses = {f["warc-record-id"]: f["warc-payload-digest"] for f in records if f["warc-type"] == "response"}
    revisits = [f for f in records if f["warc-type"] == "revisit"]
    assert len(revisits) >= 3 and all(responses[f["warc-refers-to"]] == f["warc-payload-digest"] for f in revisits)
    assert {f["warc-segment-origin-id"] for f in records if f["warc-type"] == "continuation"} <= set(responses)
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=False).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(pages) and all(r.complete for r in got)


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=500)
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    assert got and all(texts[i] == p for i, p in got.items())


def test_damaged_segments(spark, tmp_path):
    records = list(warc.page_records(1, 0, "u", b"a" * 900, None, 200)) + list(warc.page_records(2, 1, "u", b"b" * 900, None, 200)) + list(warc.page_records(3, 2, "u", b"c" * 50, None, 10_000))
    lost = records[:2] + records[3:]  # a middle segment of page 1
    (tmp_path / "w").mkdir()
    import gzip

    (tmp_path / "w" / "x.gz").write_bytes(b"".join(gzip.compress(r + warc.END) for r in lost))
    got = {r.page_id: (r.complete, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {1: (False, None), 2: (True, 900), 3: (True, 50)}


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_chunks(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_broken_chunks():
    for body in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(body)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(df, str(tmp_path / "w")).count() == 0


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op7_warc(spark, SF)) == sql_rows(connect(SF), queries.OP7_SQL)
