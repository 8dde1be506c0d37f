"""Archives: pages written and read back, and ranges against reading from the beginning."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm.warc import MAGIC, archives, fetch, index_warc, judged, member, record, round_trip, stored, with_revisited, write_warc

PAGES = "page_id long, url string, html string"


def by_hand(rows):
    """What each row of (page_id, url, html) becomes, as a sorted list."""
    groups = defaultdict(list)
    for at, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append(((page is None, page or 0, at), page))
    out = []
    for body, members in groups.items():
        members.sort()
        for i, (_, page) in enumerate(members):
            revisit = len(body) >= 100 and i > 0
            out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", members[0][1] if revisit else None))
    return sorted(out, key=repr)


def awkward():
    long = "<p>" + "é\n\r\n\x00" * 60
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nWARC-Type: bad", "x" * 99), (4, "u", "x" * 99), (7, "u", "x" * 100), (5, "u", "x" * 100), (6, None, "x" * 100), (5, "u", "x" * 100)]
    rows += [(9, "u", long), (8, "u", long), (None, "u", long), (None, "v", "only without id " * 9), (None, "v", "only without id " * 9), (10, "u", "WARC/1.1\r\n\r\n" * 20)]
    return rows


def test_awkward_pages_come_back(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, PAGES)
    for c in ("file", "row", "at", "first", "n", "payload_digest", "record_type", "offset"):
        df = df.withColumn(c, F.lit("own"))
    got = round_trip(df)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == by_hand(rows)
    assert got.where("NOT sound").count() == 0


def test_no_pages(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_many_copies_and_small_ranges(spark):
    rows = [(i, f"http://h/{i}", ("hot " * 40) if i % 3 == 0 else random.Random(i).randbytes(300).hex() * (i % 5)) for i in range(900)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    shared = spark.conf.get("spark.checkpoint.dir")
    files = write_warc(judged(stored(df)), f"{shared}/small-{random.random()}", most=20_000)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == 900
    for step in (700, 1 << 20):
        got = index_warc(files.select("file", "bytes"), step=step)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == by_hand(rows)
    # each archive is a gzip file as any tool reads it, and its members lie side by side
    one = got.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).join(files, "file").collect()
    assert all(r["n"] == r["m"] == r["bytes"] for r in one)
    path = one[0]["file"].removeprefix("file:").replace("///", "/")
    assert gzip.open(path).read().count(b"WARC-Record-ID") == one[0]["records"]
    pages = {(r["page_id"], bytes(r["payload"]).decode()) for r in with_revisited(fetch(got)).collect()}
    assert pages == {(i, html) for i, _, html in rows}


def stored_member(data):
    deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def plain_record(name, payload):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Type: application/octet-stream\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("step", [37, 500, 1 << 20])
def test_ranges_find_what_reading_from_the_beginning_finds(spark, tmp_path, step):
    """Members with the magic bytes in them by chance, archives stored as payloads, junk between members, an end cut off."""
    rng, data, want = random.Random(5), b"", []
    for i in range(60):
        inner = b"".join(stored_member(plain_record(f"inner-{i}-{j}", rng.randbytes(40))) for j in range(3))
        payload = (rng.randbytes(rng.randrange(80)), MAGIC * 20 + b"\x1f\x1f\x8b", inner, b"", MAGIC[:2] + inner[:-9])[i % 5]
        make = stored_member if i % 2 else member
        want.append((len(data), f"<r{i}>", len(payload), hashlib.sha256(payload).hexdigest()))
        data += make(plain_record(f"r{i}", payload))
        if i == 30:
            data += b"junk" + MAGIC + b"\x00junk" + member(b"no record at all")
    data += member(plain_record("cut", b"x" * 500))[:-5]
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = index_warc(archives(spark, str(tmp_path)), step=step).select("offset", "record_id", "payload_bytes", "payload_digest")
    assert sorted(map(tuple, got.collect())) == want


def test_damaged_payload_is_told(spark, tmp_path):
    row = {"record_type": "response", "html": b"y" * 200, "payload_bytes": 200, "record_id": "<a>", "url": None, "page_id": 1, "payload_digest": "0" * 64, "refers_record": None, "refers_to": None}
    (tmp_path / "a.warc.gz").write_bytes(member(record(row, "2024-01-01T00:00:00Z")))
    got = index_warc(archives(spark, str(tmp_path))).first()
    assert not got["sound"] and got["payload_digest"] == hashlib.sha256(b"y" * 200).hexdigest()
