import hashlib
import random

import pytest

from seine.llm import op08_warc as w
from seine.llm.common import Workspace


def rec(i, html, **k):
    data = html.encode()
    return w.record(i, f"http://x.org/{i}", data, hashlib.sha256(data).hexdigest(), **k)


def whole(data, zipped):
    found = list(w.salvaged(data))
    assert [a for a, _, _ in found] == [0, *(b for _, b, _ in found)][:-1] and found[-1][1] == len(data)  # no byte is unaccounted for
    return [x["page_id"] for _, _, x in found if isinstance(x, dict)], [x for _, _, x in found if isinstance(x, str)]


@pytest.mark.parametrize("zipped", [False, True])
def test_damage_loses_only_the_damaged_record(zipped):
    records = [rec(i, f"<p>page {i} " + "é WARC/1.1 \r\n\r\n x" * (i * 7)) for i in range(12)]
    parts = [w.member(r) if zipped else r for r in records]
    assert whole(b"".join(parts), zipped) == (list(range(12)), [])
    rng = random.Random(5)
    for k in range(12):
        hurt = bytearray(parts[k])
        for _ in range(3):
            hurt[rng.randrange(12, len(hurt))] ^= 0x55
        ids, gaps = whole(b"".join([*parts[:k], bytes(hurt), *parts[k + 1 :]]), zipped)
        assert set(range(12)) - {k} <= set(ids) and (gaps or k in ids or not zipped)  # a plain head has no checksum
    ids, gaps = whole(b"".join(parts[:5])[:-9] + b"junk" * 50 + b"".join(parts[5:]), zipped)
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11] and gaps
    assert whole(b"noise" + parts[0], zipped)[0] == [0] if not zipped else True
    assert whole(b"".join(parts)[:-3], zipped)[0] == list(range(11))


def test_write_and_read(spark, tmp_path):
    long = "x" * 120
    rows = [(3, "u3", long), (1, "u1", long), (2, None, "short"), (4, "u4", "short"), (5, "u 5\n", None), (None, "n", long), (6, "", "é" * 50), (7, "", "é" * 50), (1, "u1", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first_id")
    for zipped in (True, False):
        work = Workspace(spark, "t8")
        got = sorted(tuple(r) for r in w.read_warc(w.write_warc(pages, work, work.path("warc"), zipped=zipped)).selectExpr("coalesce(page_id, -1)", "record_type", "coalesce(refers_to, -1)", "payload_bytes", "cast(payload as string)").collect())
        e = "é" * 50
        assert got == sorted([(3, "revisit", 1, 120, ""), (1, "response", -1, 120, long), (1, "response", -1, 120, long), (2, "response", -1, 5, "short"), (4, "response", -1, 5, "short"), (5, "response", -1, 0, ""), (-1, "response", -1, 120, long), (6, "response", -1, 100, e), (7, "revisit", 6, 100, "")])
    work = Workspace(spark, "t8")
    assert w.read_warc(w.write_warc(pages.limit(0), work, work.path("warc"))).count() == 0


def standard():
    """Five records as other writers make them."""
    import base64

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode()
    rows = [
        ("warcinfo", "application/warc-fields", b"software: test\r\n", ""), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", ""),
        ("response", "application/http; msgtype=response", http + b"<p>one</p>", f"WARC-Payload-Digest: sha1:{sha1}\r\n"), ("response", "application/http; msgtype=response", http + b"<p>two</p>", ""),
        ("metadata", "application/warc-fields", b"via: x\r\n", "WARC-Block-Digest: SHA-256:" + hashlib.sha256(b"via: x\r\n").hexdigest() + "\r\n"),
    ]
    return [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: {form}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for i, (kind, form, block, more) in enumerate(rows)]


def test_standard_records():
    records = standard()
    kinds = ["warcinfo", "request", "response", "response", "metadata"]
    for data in (b"".join(records), b"".join(map(w.member, records)), w.member(b"".join(records))):
        found = [x for _, _, x in w.salvaged(data)]
        assert [x["record_type"] for x in found] == kinds and [x["payload"] for x in found][2:4] == [b"<p>one</p>", b"<p>two</p>"]
    records[2] = records[2].replace(b"<p>one", b"<p>two")
    for data in (b"".join(records), b"".join(map(w.member, records)), w.member(b"".join(records))):
        found = [x for _, _, x in w.salvaged(data)]
        assert [x if isinstance(x, str) else x["record_type"] for x in found][2].endswith("digest") and sum(isinstance(x, dict) for x in found) == 4


def test_quarantine(spark):
    work = Workspace(spark, "t8")
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 50) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    shards = w.write_warc(pages, work, work.path("warc"))
    uris = [r["uri"].removeprefix("file:") for r in shards.collect()]
    spans = {r["page_id"]: (r["uri"].removeprefix("file:"), r["start"]) for r in w.read_warc(shards).collect()}
    uri, start = spans[4]
    with open(uri, "r+b") as f:
        f.seek(start + 30)
        f.write(b"damage")
    found = work.write(w.read_warc(shards, with_payload=False), "found")
    assert sorted(r["page_id"] for r in found.where("gap is null").collect()) == [0, 1, 2, 3, 5, 6, 7, 8] and uri in uris
    (gap,) = w.quarantine(found, work).collect()
    assert (gap["uri"].removeprefix("file:"), gap["start"]) == (uri, start) and gap["end"] > start and gap["gap"]
