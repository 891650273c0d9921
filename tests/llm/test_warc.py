import base64
import hashlib

import pytest

from logyield.llm import warc
from logyield.llm.common import kept_table
from logyield.session import new_table_path

SPOOF = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nWARC/1.0\r\n\r\nWARC/1.0"
PAYLOADS = [
    None, "", "x", "é" * 9000, SPOOF, "WARC/1.0\r\nWARC-Type: response", SPOOF * 40, "\r\n\r\n", "\r\n", "line\n" * 3000, "x", "x",
    "\x00\x1f", "ends\r\n\r\nWARC/1.0", "WARC/1.0" * 50,
]


def expected(rows, least):
    out = []
    for page_id, payload in rows:
        body = (payload or "").encode()
        same = [i for i, p in rows if (p or "") == (payload or "")]
        best = max((i for i in same if i is not None), default=None)
        revisit = len(body) >= least and page_id != best
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, chunk_bytes", [(0, 64 << 10), (2, 100), (0, 7)])
def test_round_trip(spark, least, chunk_bytes):
    rows = [(i, p) for i, p in enumerate(PAYLOADS)] + [(None, "x"), (None, "only null"), (None, "only null"), (11, "x"), (50, "y"), (50, "y")]
    pages = spark.createDataFrame([(i, p, "http://h/\r\nx" if i == 3 else None, "x") for i, p in rows],
                                  "page_id bigint, html string, url string, payload_digest string")
    got = warc.round_trip(pages.repartition(3), least_bytes=least, chunk_bytes=chunk_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows, least)


def test_chunks_carry_running_digests_and_rebuild_the_payload(spark):
    payload = (SPOOF * 30).encode()
    pages = spark.createDataFrame([(1, payload.decode(), "u")], "page_id bigint, html string, url string")
    rows = sorted(warc.chunk_rows(pages, chunk_bytes=64).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in rows] == list(range(len(rows))) and {r.chunks for r in rows} == {len(rows)}
    at = 0
    for r in rows:
        at += len(r.data)
        assert len(r.data) <= 64
        assert bytes(r.running_digest) == hashlib.sha1(payload[:at]).digest()
        assert not bytes(r.data).startswith(warc.VERSION) and warc.END + warc.VERSION not in bytes(r.data)
    assert b"".join(bytes(r.data) for r in rows) == payload

    path = new_table_path(spark, "warc-test")
    warc.write_archives(pages, path, chunk_bytes=64)
    back = sorted(warc.read_chunks(spark, path).collect(), key=lambda r: r.chunk)
    assert b"".join(bytes(r.data) for r in back) == payload
    assert {r.record_type for r in back} == {"response", "continuation"} and len({r.record_id for r in back}) == 1


def test_cuts():
    for payload in [(p or "").encode() for p in PAYLOADS]:
        for size in (3, 9, 100):
            ends = warc.cuts(payload, size)
            parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
            assert b"".join(parts) == payload and ends[-1] == len(payload)
            for part in parts:
                assert len(part) <= size and not part.startswith(warc.VERSION) and warc.END + warc.VERSION not in part


def test_damage_is_an_error():
    def record(data, **changes):
        fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "Payload-Length": len(data), "Content-Length": len(data),
                  "WARC-Payload-Digest": "sha1:" + warc.base32(hashlib.sha1(data).digest()),
                  "WARC-Block-Digest": "sha1:" + warc.base32(hashlib.sha1(data).digest())}
        return warc.header(list((fields | changes).items())) + data

    assert warc.parse_record(record(b"abc"))["data"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record(b"abc")[:-1])
    with pytest.raises(ValueError):
        warc.parse_record(record(b"abc")[:-1] + b"d")
    with pytest.raises(ValueError):
        warc.parse_record(record(b"abc", **{"Content-Length": 2}))


def test_lost_chunk_fails_the_read(spark):
    path = new_table_path(spark, "warc-lost")
    pages = spark.createDataFrame([(1, "abcdefgh", None)], "page_id bigint, html string, url string")
    chunks = warc.classified(kept_table(warc.chunk_rows(pages, chunk_bytes=3), "chunks"), "bigint", 0).where("chunk <> 1")
    lines = warc.records(chunks).selectExpr("cast(value AS string) AS value")
    lines.write.option("lineSep", warc.END.decode()).text(path)
    with pytest.raises(Exception, match="no place"):
        warc.read_archives(spark, path).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, html string, url string")
    assert warc.round_trip(pages).collect() == []
