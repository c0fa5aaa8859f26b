from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import pytest

from orogena.llm.warc import BrokenRecord, Written, page_outcomes, page_record, page_records, read_warc, record, records, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=1000):
    last, out = {}, []
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        lead = last.get(h or "")
        later = len(data) >= least and lead is not None and (i is None or i < lead)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", lead if later else None))
    return Counter(out)


BIG, OTHER = "<p>" + "é" * 600 + "</p>", "".join(random.Random(1).choice("abc \r\n") for _ in range(400_000))
ROWS = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (9, "http://a/9", BIG),
    (3, "http://a/3", "small"),
    (4, "http://a/4", "small"),
    (5, None, None),
    (6, "http://a/é?q=1 2\r\nX-Evil: 1", ""),
    (7, "", OTHER),
    (8, "http://b/8", OTHER),
    (None, "http://c", BIG),
    (None, "http://d", "n" * 2000),
    (None, "http://d", "n" * 2000),
    (10, "http://a/10", "\r\n\r\n" * 300),
    (11, "http://a/10", "x" * 1000),
    (12, "http://a/10", "x" * 1000),
    (13, "http://a/10", "x" * 999),
    (14, "http://a/10", "x" * 999),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in warc_round_trip(pages).collect()) == brute(ROWS)
    repeated = [*ROWS, (9, "http://a/9", BIG), (1, "http://a/1", BIG)]
    assert Counter(tuple(r) for r in warc_round_trip(spark.createDataFrame(repeated, SCHEMA)).collect()) == brute(repeated)


def test_no_pages_and_other_columns(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'a' AS payload", "'b' AS type", "'c' AS id", "'d' AS last", "1 AS record_id")
    assert Counter(tuple(r) for r in warc_round_trip(more).collect()) == brute(ROWS)


def test_archives_are_gzip_members_with_whole_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write_warc(page_records(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)), path, roll="1000")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) > 3 and all(n.endswith(".warc.gz") for n in names)
    n, whole = 0, []
    for name in names:
        data = (tmp_path / "out" / name).read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while data:
            d = zlib.decompressobj(31)
            text, data, n = d.decompress(data), d.unused_data, n + 1
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nX-Evil" not in text
    back = read_warc(spark, path)
    assert n == back.count() == len(ROWS) + len(names)
    whole = Counter((r.row_key, r.payload.decode()) for r in back.where("type = 'response'").collect())
    told = brute(ROWS)
    assert sum(whole.values()) == sum(c for k, c in told.items() if k[3] == "response")
    assert all(text == {str(i): h or "" for i, _, h in ROWS}.get(key, text) for key, text in whole)
    one = read_warc(spark, f"{path}/{names[0]}", payload=False)
    assert one.where("payload IS NOT NULL").count() == 0 and one.count() >= 2
    # archives are added to those that are there
    write_warc(page_records(spark.createDataFrame(ROWS[3:4], SCHEMA)), path)
    assert read_warc(spark, path, payload=False).where("type <> 'warcinfo'").count() == len(ROWS) + 1


def archive(**change):
    row = {"record_id": "<urn:x>", "type": "response", "target": "u", "row_key": "1", "refers_to": None, "payload": b"abc" * 50_000, "payload_digest": hashlib.sha1(b"abc" * 50_000).hexdigest(), "payload_bytes": 150_000}
    return page_record(row | change, "2000-01-01T00:00:00Z")


def read(data, step=7):
    f = io.BytesIO(data)
    return list(records(lambda n: f.read(min(n, step))))


def test_reads_in_small_steps():
    got = read(archive() + archive(record_id="<urn:y>", payload=b"", payload_digest=hashlib.sha1(b"").hexdigest()))
    assert [(r["record_id"], r["payload_bytes"]) for r in got] == [("<urn:x>", 150_000), ("<urn:y>", 0)]
    assert got[0]["payload"] == b"abc" * 50_000


def member(text):
    return gzip.compress(text)


@pytest.mark.parametrize(
    "bad",
    [
        archive()[:-30],
        archive() + b"tail of another kind",
        archive(payload_digest="00" * 20),
        member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
        member(b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabc\r\n\r\n"),
        member(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"),
        member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore"),
        member(b"WARC/1.1\r\nno colon\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        member(b"WARC/1.1\r\n\r\nabc\r\n\r\n"),
        member(b"HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        member(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:AAAA\r\n\r\nabc\r\n\r\n"),
        member(b"x" * 200_000),
    ],
)
def test_broken_archives_are_refused(bad):
    with pytest.raises(BrokenRecord):
        read(bad, 1000)


def test_plain_records_and_foreign_headers():
    block = b"k: v\r\n"
    got = read(record("metadata", "<urn:m>", block, {"Content-Type": "application/warc-fields", "X-Other": "1"}))
    assert got[0]["type"] == "metadata" and got[0]["payload"] == block and got[0]["payload_digest"] == hashlib.sha1(block).hexdigest()


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    rows = page_records(spark.createDataFrame(ROWS, SCHEMA))
    bad = rows.withColumn("payload_digest", rows["payload_digest"].substr(1, 7))  # not hex of whole bytes
    with pytest.raises(Exception, match="fromhex|hexadecimal"):
        write_warc(bad, f"file://{tmp_path}/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_revisit_needs_its_response(spark, tmp_path):
    rows = page_records(spark.createDataFrame(ROWS, SCHEMA)).where("type = 'revisit'")
    write_warc(rows, f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="no payload for the revisit"):
        page_outcomes(read_warc(spark, f"file://{tmp_path}/out", payload=False)).collect()


def test_commit_messages_travel():
    assert Written(["a"]).names == ["a"]
